"""Source trees: a row per file with its text where it is to be read, from a tracked listing or a walk.

The listing and git are the driver's, and the files are read by path, so a tree is one that all machines see under the
same path (one machine, or a mounted store). ``operators.repo`` takes any table of files.
"""

from __future__ import annotations

import json
import os
import re
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T

#: Files of this many bytes or more are sized but not read.
MOST_BYTES = 400_000
#: The tree's own list of files that findings leave out.
IGNORE_FILE = ".millraceignore"
SCHEMA = "path string, size bigint, content string, digest string, is_changed boolean"
#: Folders that one read lists.
_AT_ONCE = 20_000


def _git(repo: str, *args: str, seconds: int) -> list[str] | None:
    try:
        done = subprocess.run(["git", "-C", repo, *args], capture_output=True, timeout=seconds, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout.decode("utf-8", "replace").split("\0") if done.returncode == 0 else None


def tracked(repo: str) -> list[str]:
    """Paths of a local tree: those tracked, else those found by a walk that leaves out folders of builds and caches."""
    listed = [p for p in _git(repo, "ls-files", "-z", seconds=60) or () if p]
    if not listed:
        for folder, folders, names in os.walk(repo):
            folders[:] = [d for d in folders if d not in T.JUNK_FOLDERS]
            listed += [os.path.relpath(os.path.join(folder, n), repo) for n in names]
    return sorted(p for p in listed if os.path.isfile(os.path.join(repo, p)))


def changed(repo: str) -> set[str]:
    """Paths that are changed and not committed; of a renamed file the new path."""
    out, skip = set(), False
    for entry in _git(repo, "status", "--porcelain", "-z", "-uall", seconds=30) or ():
        if skip or len(entry) < 4:
            skip = False
            continue
        out.add(entry[3:])
        skip = entry[0] in "RC"
    return out


def ignore_list(repo: str) -> list[str]:
    """Shell patterns of the tree's own ignore file, one a line, # for comments."""
    try:
        with open(os.path.join(repo, IGNORE_FILE), encoding="utf-8", errors="replace") as f:
            lines = [x.strip() for x in f]
    except OSError:
        return []
    return [x for x in lines if x and not x.startswith("#")]


def package_references(repo: str) -> list[str]:
    """Path-like tokens of a package file's scripts and programs; they are run, so what they name is used."""
    try:
        with open(os.path.join(repo, "package.json"), encoding="utf-8", errors="replace") as f:
            held = json.load(f)
    except (OSError, ValueError):
        return []
    if not isinstance(held, dict):
        return []
    values = []
    for field in ("scripts", "bin"):
        own = held.get(field)
        values += [v for v in own.values() if isinstance(v, str)] if isinstance(own, dict) else [own] if isinstance(own, str) else []
    return [t for v in values for t in re.findall(T.TOKEN, v) if "/" in t and "." in t.rsplit("/", 1)[-1]]


def tree(spark: SparkSession, repo: str, most: int = MOST_BYTES) -> DataFrame:
    """``SCHEMA`` of a local tree. Only text files under ``most`` bytes have content; the reader prunes it for the others."""
    paths = tracked(repo)
    if not paths:
        return spark.createDataFrame([], SCHEMA)
    root = os.path.abspath(repo)
    uncommitted = changed(repo)
    suffixes = tuple(T.SOURCE_SUFFIXES + T.DOC_SUFFIXES + T.DATA_SUFFIXES)
    sized = [(p, os.path.getsize(os.path.join(root, p)), p in uncommitted) for p in paths]
    texts = {p for p, n, _ in sized if 0 < n < most and p.lower().endswith(suffixes)}
    known = lambda inside: spark.createDataFrame([r for r in sized if (r[0] in texts) == inside], "path string, size bigint, is_changed boolean")
    # folders are listed, not files one by one; what is in them but isn't tracked falls out of the join
    folders = sorted({os.path.dirname(os.path.join(root, p)) for p in texts})
    read = None
    for a in range(0, len(folders), _AT_ONCE):
        escaped = [re.sub(r"([\\{}\[\]*?])", r"\\\1", "file://" + f) for f in folders[a : a + _AT_ONCE]]
        part = spark.read.format("binaryFile").load(escaped)
        part = part.where((F.col("length") < most) & (F.col("length") > 0) & F.lower("path").rlike(f"({T.any_of(list(suffixes))})$"))
        decoded = F.make_valid_utf8(F.col("content").cast("string"))
        part = part.select(F.regexp_replace("path", f"^file:/*{re.escape(root)}/", "").alias("path"), decoded.alias("content"), T.digest_of(F.col("content")).alias("digest"))
        read = part if read is None else read.unionAll(part)
    rest = known(False).select("path", "size", F.lit(None).cast("string").alias("content"), F.lit(None).cast("string").alias("digest"), "is_changed")
    if read is None:
        return rest
    # the listing, which the driver holds anyway, goes to the contents, so that they are read and looked at where they are
    return read.join(F.broadcast(known(True)), "path").select("path", "size", "content", "digest", "is_changed").unionAll(rest)
