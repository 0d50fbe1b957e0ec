"""Trees and runs that are read as files, and the artifacts of the command line: small ones of fixed content, made for each query."""

from __future__ import annotations

import contextlib
import io
import os
import shutil
import subprocess
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import cli
from millrace.operators import experiments, repo
from millrace.plans.report_queries import _values
from millrace.plans.source_queries import shared_folder
from millrace.report import repo as report
from millrace.sources import experiments as runs
from millrace.sources import files
from millrace.sources.tables import table

QUERIES, SQL = {}, {}


def query(name: str, sql: str):  # noqa: ANN201
    def keep(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return keep


#: The files of the tree, and of each its class (by the numbers of ``operators.repo``) and whether it is changed and not committed.
_TREE = [
    ("package.json", '{"scripts": {"go": "node tools/go.js --fast", "test": "jest"}, "bin": {"x": "bin/cli.js"}}', repo.TARGET, False),
    ("tools/go.js", "go();\n", repo.TARGET, False), ("bin/cli.js", "cli();\n", repo.TARGET, False), ("lib/lost.ts", "export const lost = 1;\n", repo.TARGET, False),
    ("lib/new work.ts", "export const fresh = 2;\n", repo.TARGET, True), ("lib/used.ts", "export const used = 1;\n", repo.TARGET, False), ("lib/user.ts", "import './used'\n", repo.TARGET, False),
    ("own/skip.ts", "export const skip = 1;\n", repo.IGNORED, False), ("run.log", "noise", repo.JUNK, False), ("yarn.lock", "x", repo.IGNORED, False),
    (".millraceignore", "# ours\n\nown/*\n", repo.UNREAD, False), ("pic.bin", "b" * 2000, repo.UNREAD, False), ("empty.py", "", repo.UNREAD, False),
    ("big.py", "a = 1\n" * 70_000, repo.UNREAD, False), ("README.md", "See lib/used.\n", repo.TARGET, False),
]


def tree(spark: SparkSession) -> str:
    """A committed tree with one file changed since, and one folder that is never walked."""
    root = os.path.join(shared_folder(spark).removeprefix("file://"), f"tree-{uuid.uuid4().hex}")
    git = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=x", "-c", "user.email=x@example.com", *a], check=True, capture_output=True)
    for path, text, _, is_changed in _TREE:
        full = os.path.join(root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w", encoding="utf-8") as f:
            f.write("old\n" if is_changed else text)
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "x")
    for path, text, _, is_changed in _TREE:
        if is_changed:
            with open(os.path.join(root, path), "w", encoding="utf-8") as f:
                f.write(text)
    os.makedirs(os.path.join(root, "node_modules/dep"))
    with open(os.path.join(root, "node_modules/dep/index.js"), "w", encoding="utf-8") as f:
        f.write("no();\n")
    return root


@query("files_read", _values([(p, len(t), c, ch) for p, t, c, ch in _TREE], "path, size, class, is_changed").replace("SELECT *", "SELECT path, size::BIGINT AS size, class, is_changed"))
def files_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracked files, sized, read where they are texts and not too long, and told apart by class with the tree's own list."""
    root = tree(spark)
    found = repo.classified(files.tree(spark, root), files.ignore_list(root))
    return found.select("path", "size", "class", "is_changed")


@query("files_walked", _values([(p,) for p, *_ in _TREE], "path"))
def files_walked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without git the tree is walked, and folders of builds and caches are left out."""
    root = tree(spark)
    shutil.rmtree(os.path.join(root, ".git"))
    before = os.environ.get("GIT_CEILING_DIRECTORIES")
    os.environ["GIT_CEILING_DIRECTORIES"] = os.path.dirname(root)
    try:
        return spark.createDataFrame([(p,) for p in files.tracked(root)], "path string")
    finally:
        os.environ.pop("GIT_CEILING_DIRECTORIES") if before is None else os.environ.update(GIT_CEILING_DIRECTORIES=before)


@query("package_references", _values([("bin/cli.js",), ("tools/go.js",)], "token"))
def package_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(t,) for t in sorted(files.package_references(tree(spark)))], "token string")


@query("files_unreferenced", _values([("lib/lost.ts", False), ("lib/user.ts", False)], "path, is_script"))
def files_unreferenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the package file runs, what is changed and what is ignored are no orphans."""
    root = tree(spark)
    return report.scan(files.tree(spark, root), files.ignore_list(root), files.package_references(root)).orphans


_ARTIFACTS = ["CLAUDE.md", "out/budget.json", "out/bundle.json", "out/digest.md", "out/repo_report.json", "out/report.md", "out/shards/repo-junk-artifacts.json", "out/shards/repo-orphan-modules.json"]


@query("artifacts", _values([(a, 0) for a in _ARTIFACTS], "artifact, code"))
def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an analysis and a map of the tree write, with their exit code; a grade that is too bad would give 1."""
    root = tree(spark)
    with contextlib.redirect_stdout(io.StringIO()), contextlib.redirect_stderr(io.StringIO()):
        code = cli.main(["analyze", "--mode", "repo", "--repo", root, "--out", f"{root}-out/out", "--fail-under", "F"])
        code += cli.main(["map", "--repo", root, "--out", f"{root}-out"])
    made = [os.path.relpath(os.path.join(d, f), f"{root}-out") for d, _, names in os.walk(f"{root}-out") for f in names]
    return spark.createDataFrame([(a, code) for a in sorted(made)], "artifact string, code int")


@query(
    "runs_read",
    """WITH r AS (SELECT p_brand AS task, CASE WHEN p_size % 2 = 0 THEN 'baseline' ELSE 'optimized' END AS config, p_partkey + 100 AS n, p_size % 3 <> 0 AS ok FROM part WHERE p_partkey % 5 <> 0),
m AS (SELECT task, avg(n) FILTER (config = 'baseline') AS base_tokens, avg(n) FILTER (config = 'optimized') AS opt_tokens, avg(ok::INT) FILTER (config = 'baseline') AS base_ok, avg(ok::INT) FILTER (config = 'optimized') AS opt_ok FROM r GROUP BY task)
SELECT task, round(base_tokens, 6) AS base_tokens, round(opt_tokens, 6) AS opt_tokens, round(base_ok, 6) AS base_ok, round(opt_ok, 6) AS opt_ok FROM m WHERE base_tokens IS NOT NULL AND opt_tokens IS NOT NULL""",
)
def runs_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs in JSON lines, of which those with an error are left out, paired by task."""
    part, path = table(spark, sf_dir, "part"), f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    rows = part.select(
        F.col("p_brand").alias("task"), F.when(F.col("p_size") % 2 == 0, "baseline").otherwise("optimized").alias("config"), F.lit(0).alias("rep"), (F.col("p_partkey") + 100).alias("total_tokens"),
        (F.col("p_size") % 3 != 0).alias("success"), F.when(F.col("p_partkey") % 5 == 0, "broke").alias("error"),
    )
    rows.write.json(path)
    pairs = experiments.paired(runs.runs(spark, path, "bench").where("error is null"))
    return pairs.select("task", *[F.round(c, 6).alias(c) for c in ("base_tokens", "opt_tokens", "base_ok", "opt_ok")])
