"""Session logs: a folder per project with a JSON-lines file per session, read schema-on-read.

Lines are parsed once, to VARIANT; events drift, so each access is guarded. Blank and malformed lines and lines that
aren't objects are skipped. Two known differences from a strict parser: text after a closing brace is ignored, and a
line with NaN is malformed. Repeated keys take the last value where the session allows repeated keys in variants.
"""

from __future__ import annotations

import os
import re
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the names of logs.
LOGS = "*.jsonl"
TURN_SCHEMA = (
    "session_id string, seq bigint, role string, ts string, git_branch string, cwd string, permission_mode string, "
    "input_tokens bigint, output_tokens bigint, cache_read_tokens bigint, cache_creation_tokens bigint, "
    "tool_calls array<struct<name:string,file_path:string,command:string>>, tool_errors bigint, tool_result_chars array<bigint>, "
    "is_compaction boolean, is_sidechain boolean, text_chars bigint, thinking_chars bigint"
)


def default_root() -> str:
    """Where sessions are kept: the configured folder's `projects`, else the one in the home folder."""
    home = os.environ.get("CLAUDE_CONFIG_DIR") or os.path.join(os.path.expanduser("~"), ".claude")
    return os.path.join(home, "projects")


def project_folder(cwd: str) -> str:
    """The folder name that a working directory's sessions are kept under."""
    return cwd.replace("/", "-")


def decoded_path() -> Column:
    """The path of the file that a row is of, as it is named in the store; the file metadata have it encoded."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")


def literal_path(path: str) -> str:
    """A path that a reader takes as it stands, without patterns."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def _listed(spark: SparkSession, root: str, since: float | None = None, logs: str = LOGS) -> DataFrame:
    """path, session_id, project, size and mtime of each log; only the listing is read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", logs)
    if since is not None:
        reader = _modified_after(reader, since)
    meta = reader.load(f"{root.rstrip('/')}/*").select(decoded_path().alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    return meta.withColumns({"session_id": stem(F.col("path")), "project": F.element_at(F.split("path", "/"), -2)})


def _modified_after(reader, since: float):  # noqa: ANN001, ANN202
    """The reader without files older than a time, in seconds since 1970. It compares whole seconds, so one is left over."""
    return reader.option("modifiedAfter", time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime(since - 1))).option("timeZone", "UTC")


def listing(spark: SparkSession, root: str, project: str | None = None, limit: int | None = None, since_days: float | None = None, logs: str = LOGS) -> DataFrame:
    """Logs, of which ``limit`` takes the newest, then by path. ``project`` is a path: its folder name, or its last part, must be in the log's.

    A limit of 0 or None takes all.
    """
    since = None if since_days is None else time.time() - since_days * 86400
    out = _listed(spark, root, since, logs)
    if project:
        full = os.path.abspath(project)
        out = out.where(F.contains("project", F.lit(project_folder(full))) | F.contains("project", F.lit(os.path.basename(full))))
    if since is not None:
        out = out.where(F.unix_timestamp("mtime") >= F.lit(since))
    if limit:
        out = out.orderBy(F.col("mtime").desc(), "path").limit(limit)
    return out


def load(spark: SparkSession, root: str, project: str | None = None, limit: int | None = None, since_days: float | None = None, logs: str = LOGS) -> tuple[DataFrame, DataFrame]:
    """The listing, and the events of its logs alone.

    A limit bounds the paths that come to the driver, and a project the folders; those are all that is read. Old logs are
    left out by the reader.
    """
    chosen = listing(spark, root, project, limit, since_days, logs)
    since = None if since_days is None else time.time() - since_days * 86400
    paths = None
    if limit:
        paths = sorted(r.path for r in chosen.select("path").collect())
        chosen = listing_of(spark, paths)
    elif project:
        folders = chosen.select(F.regexp_replace("path", "/[^/]*$", "").alias("path")).distinct()
        paths = sorted(r.path for r in folders.collect())
    return chosen, events(spark, root, paths, since, logs)


def listing_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The listing of logs that are known by their paths."""
    if not paths:
        return spark.createDataFrame([], "path string, size bigint, mtime timestamp, session_id string, project string")
    files = spark.read.format("binaryFile").load([literal_path(p) for p in paths])
    meta = files.select(decoded_path().alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    return meta.withColumns({"session_id": stem(F.col("path")), "project": F.element_at(F.split("path", "/"), -2)})


def by_project(logs: DataFrame, n: int = 20) -> DataFrame:
    """project and transcripts, their number, of the first ``n`` projects by name."""
    return logs.groupBy("project").agg(F.count("*").alias("transcripts")).orderBy("project").limit(n)


def has_logs(root: str) -> bool:
    """Whether a local root has a project with a log; other stores are taken to have."""
    if "://" in root:
        return True
    return os.path.isdir(root) and any(f.name.endswith(".jsonl") for d in os.scandir(root) if d.is_dir() for f in os.scandir(d.path))


def events(spark: SparkSession, root: str, paths: list[str] | None = None, since: float | None = None, logs: str = LOGS) -> DataFrame:
    """path, session_id, seq (file order) and event (VARIANT) of every line that is an object.

    ``paths``: the logs, or folders of logs, that are read instead of all under ``root``; ``since``: seconds since 1970
    before which a log's last change leaves it out.
    """
    reader = spark.read.option("pathGlobFilter", logs)
    if since is not None:
        reader = _modified_after(reader, since)
    if paths is not None and not paths:
        lines = spark.createDataFrame([], "value string, path string, block bigint")
    else:
        read = reader.text([literal_path(p) for p in paths] if paths else f"{root.rstrip('/')}/*")
        lines = read.select("value", decoded_path().alias("path"), F.col("_metadata.file_block_start").alias("block"))
    # within a file, splits are ordered by where they start and lines within a split by their id
    return parsed(lines.withColumn("line", F.monotonically_increasing_id()))


def parsed(lines: DataFrame) -> DataFrame:
    """lines: value, path, block, line. The events of those lines that are JSON objects."""
    text = F.trim(F.make_valid_utf8("value"))
    out = lines.where(text != "").select("path", stem(F.col("path")).alias("session_id"), F.struct("block", "line").alias("seq"), F.try_parse_json(text).alias("event"))
    return out.where(F.schema_of_variant("event").startswith("OBJECT"))


def _text(event: Column, path: str) -> Column:
    """A string field; null unless it is one, and not empty."""
    value = F.try_variant_get(event, path, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.nullif(F.try_variant_get(event, path, "string"), F.lit("")))


def _number(event: Column, path: str) -> Column:
    """An integer of whatever was written, 0 where there is none."""
    return F.coalesce(F.try_variant_get(event, path, "bigint"), F.lit(0).cast("bigint"))


def _truthy(event: Column, path: str) -> Column:
    """Whether a field is there and isn't false, 0, empty or null."""
    value = F.try_variant_get(event, path, "variant")
    as_text = F.try_variant_get(event, path, "string")
    return F.coalesce(~F.is_variant_null(value) & ~as_text.isin("false", "0", "", "0.0", "[]", "{}"), F.lit(False))


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit(""))


def _length(block: Column, path: str) -> Column:
    return F.coalesce(F.length(_text(block, path)), F.lit(0)).cast("bigint")


def keys_of(df: DataFrame) -> list[str]:
    """What tells sessions apart: a log's path, since names repeat between projects, or the id where there is no path."""
    return ["path"] if "path" in df.columns else ["session_id"]


def session_attributes(found: DataFrame) -> DataFrame:
    """What is folded over all events of a session: first directory and version, last branch, first and last time in file order."""
    e = F.col("event")
    keys = keys_of(found)
    name = [F.any_value("session_id").alias("session_id")] if keys != ["session_id"] else []
    rows = found.select(*dict.fromkeys([*keys, "session_id"]), "seq", _text(e, "$.cwd").alias("cwd"), _text(e, "$.gitBranch").alias("branch"), _text(e, "$.version").alias("version"), _text(e, "$.timestamp").alias("ts"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    return rows.groupBy(*keys).agg(*name, first("cwd").alias("repo"), last("branch").alias("branch"), first("version").alias("version"), first("ts").alias("started"), last("ts").alias("ended"))


def turns(found: DataFrame) -> DataFrame:
    """A row per user or assistant event with a message, in the shape of ``TURN_SCHEMA`` after the path, if there is one (seq orders a session's turns)."""
    e = F.col("event")
    role = F.try_variant_get(e, "$.type", "string")
    message = F.try_variant_get(e, "$.message", "variant")
    own = found.where(role.isin("assistant", "user") & _kind(message).startswith("OBJECT"))
    used = lambda name: F.when(role == "assistant", _number(e, f"$.message.usage.{name}")).otherwise(F.lit(0).cast("bigint"))
    content = F.try_variant_get(e, "$.message.content", "variant")
    blocks = F.filter(F.coalesce(F.try_variant_get(e, "$.message.content", "array<variant>"), F.array().cast("array<variant>")), lambda b: _kind(b).startswith("OBJECT"))
    of_kind = lambda kind: F.filter("blocks", lambda b: F.try_variant_get(b, "$.type", "string") == kind)

    def result_chars(b: Column) -> Column:
        inner = F.try_variant_get(b, "$.content", "variant")
        parts = F.filter(F.coalesce(F.try_variant_get(b, "$.content", "array<variant>"), F.array().cast("array<variant>")), lambda x: _kind(x).startswith("OBJECT"))
        summed = F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, x: a + _length(x, "$.text"))
        return F.when(_kind(inner) == "STRING", F.length(F.try_variant_get(b, "$.content", "string")).cast("bigint")).when(_kind(inner).startswith("ARRAY"), summed)

    call = lambda b: F.struct(F.coalesce(_text(b, "$.name"), F.lit("unknown")).alias("name"), _text(b, "$.input.file_path").alias("file_path"), _text(b, "$.input.command").alias("command"))
    total = lambda kind, path: F.aggregate(of_kind(kind), F.lit(0).cast("bigint"), lambda a, b: a + _length(b, path))
    shaped = own.select(
        *dict.fromkeys([*keys_of(found), "session_id"]), "seq", role.alias("role"), _text(e, "$.timestamp").alias("ts"), _text(e, "$.gitBranch").alias("git_branch"), _text(e, "$.cwd").alias("cwd"), _text(e, "$.permissionMode").alias("permission_mode"),
        used("input_tokens").alias("input_tokens"), used("output_tokens").alias("output_tokens"), used("cache_read_input_tokens").alias("cache_read_tokens"), used("cache_creation_input_tokens").alias("cache_creation_tokens"),
        F.coalesce((_text(e, "$.subtype") == "compact_boundary") | _truthy(e, "$.isCompactSummary"), _truthy(e, "$.isCompactSummary")).alias("is_compaction"), _truthy(e, "$.isSidechain").alias("is_sidechain"),
        F.when(_kind(content) == "STRING", F.length(F.try_variant_get(e, "$.message.content", "string"))).otherwise(0).cast("bigint").alias("bare_chars"), blocks.alias("blocks"),
    )
    return shaped.select(
        *[c for c in shaped.columns if c not in ("bare_chars", "blocks")],
        F.transform(of_kind("tool_use"), call).alias("tool_calls"),
        F.size(F.filter(of_kind("tool_result"), lambda b: _truthy(b, "$.is_error"))).cast("bigint").alias("tool_errors"),
        F.filter(F.transform(of_kind("tool_result"), result_chars), lambda x: x.isNotNull()).alias("tool_result_chars"),
        (F.col("bare_chars") + total("text", "$.text")).alias("text_chars"), total("thinking", "$.thinking").alias("thinking_chars"),
    )
