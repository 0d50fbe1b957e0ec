"""What the command line and the reports decide: grades, gates, budgets, numbers as shown, and what kind of file a path is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import findings
from millrace.plans.source_queries import log_lines
from millrace.report import bundle, formats, render
from millrace.report.budget import Budget, cap_for
from millrace.sources import transcripts
from millrace.sources.tables import table

QUERIES, SQL = {}, {}


def query(name: str, sql: str):  # noqa: ANN201
    def keep(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return keep


def _values(rows: list[tuple], names: str) -> str:
    shown = lambda v: "NULL" if v is None else ("'" + v.replace("'", "''") + "'") if isinstance(v, str) else str(v).lower()
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}) t({names})"


_LETTERS = ["A", "B", "C", "D", "F", "·", "b+", ""]


@query(
    "grade_gate",
    """WITH g AS (SELECT unnest(['A', 'B', 'C', 'D', 'F', '·', 'b+', '']) AS x), r AS (SELECT x, CASE upper(left(x, 1)) WHEN 'A' THEN 5 WHEN 'B' THEN 4 WHEN 'C' THEN 3 WHEN 'D' THEN 2 WHEN 'F' THEN 1 ELSE 0 END AS n FROM g)
SELECT a.x AS grade, b.x AS wanted, CASE WHEN a.n > 0 AND a.n < b.n THEN 1 ELSE 0 END AS code FROM r a, r b""",
)
def grade_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exit code of each grade under each that is wanted."""
    return spark.createDataFrame([(a, b, bundle.gate(a, b)) for a in _LETTERS for b in _LETTERS], "grade string, wanted string, code int")


@query(
    "budget_ledger",
    """WITH c AS (SELECT unnest(['tokens', 'repo', 'both', 'own']) AS mode, unnest([200000, 200000, 400000, 900]) AS cap), s AS (SELECT *, CASE WHEN 1001 <= cap THEN 1001 ELSE 0 END AS a FROM c),
t AS (SELECT *, a + CASE WHEN a + 150000 <= cap THEN 150000 ELSE 0 END AS spent FROM s) SELECT mode, cap::BIGINT AS cap, spent::BIGINT AS spent, (cap - spent)::BIGINT AS remaining, floor((cap - spent) * 0.65)::BIGINT AS allowance FROM t""",
)
def budget_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4,004 characters and 150,000 tokens charged to the budget of each mode and to a small one."""
    rows = []
    for mode, own in (("tokens", None), ("repo", None), ("both", None), ("own", 900)):
        b = Budget(cap_for(mode, own))
        b.charge_chars(4004, "digest")
        b.charge(150_000)
        rows.append((mode, b.cap_tokens, b.spent_tokens, b.remaining, b.allowance()))
    return spark.createDataFrame(rows, "mode string, cap bigint, spent bigint, remaining bigint, allowance bigint")


_SHOWN = [
    ("percent", 0.4567, "46%"), ("money", 1234.5, "$1,234.50"), ("human", 999.0, "999"), ("human", 12345.0, "12K"), ("human", 4.6e6, "5M"), ("human_tokens", 1500.0, "1.5K"), ("human_tokens", 2.5e9, "2.5B"),
    ("size", 10.0, "10B"), ("size", 2048.0, "2.0KB"), ("size", 5.5 * 2**20, "5.5MB"),
]


@query("numbers_shown", _values([(k, x, want) for k, x, want in _SHOWN], "kind, x, shown").replace("SELECT *", "SELECT kind, x::DOUBLE AS x, shown"))
def numbers_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k, x, getattr(formats, k)(x)) for k, x, _ in _SHOWN], "kind string, x double, shown string")


@query("glyphs", "WITH s AS (SELECT p_size, count(*) AS n FROM part WHERE p_size <= 12 GROUP BY 1), m AS (SELECT min(n) AS low, max(n) - min(n) AS span FROM s) SELECT p_size, CASE WHEN span = 0 THEN 0 ELSE floor((n - low) / span * 7) END::INT AS level, CAST(round_even(24.0 * n / (low + span), 0) AS INT) AS blocks FROM s, m")
def glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The levels of a sparkline's glyphs and the blocks of bars."""
    rows = table(spark, sf_dir, "part").where("p_size <= 12").groupBy("p_size").agg(F.count("*").alias("n")).orderBy("p_size").collect()
    line, most = render.sparkline([r.n for r in rows]), max((r.n for r in rows), default=0)
    made = [(r.p_size, ord(g) - ord("▁"), render.bar(r.n, most).count("█")) for r, g in zip(rows, line)]
    return spark.createDataFrame(made, "p_size int, level int, blocks int")


@query(
    "shard_budget",
    """WITH a AS (SELECT p_partkey AS k, p_size AS cost, sum(p_size) OVER (ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) AS spent FROM part WHERE p_size < 25), taken AS (SELECT * FROM a WHERE spent <= 3000),
b AS (SELECT p_partkey AS k, p_size AS cost, (SELECT coalesce(max(spent), 0) FROM taken) + sum(p_size) OVER (ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) AS spent FROM part WHERE p_size >= 25)
SELECT 0 AS list, k, spent::BIGINT AS spent FROM taken UNION ALL SELECT 1, k, spent::BIGINT FROM b WHERE spent <= 3000""",
)
def shard_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ranked lists under one allowance: the second goes on from what the first has spent."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("cost"))
    both = findings.within_one_budget([parts.where("cost < 25"), parts.where("cost >= 25")], "cost", [F.col("k")], 3000)
    return both.select("list", "k", F.col("spent").cast("bigint").alias("spent"))


#: Paths with what is said of them: junk, ignored (with the pattern `own/*` of the tree's own), vendored, test, config, in a script folder.
_PATHS = [
    ("a/.DS_Store", True, False, False, False, True, False), ("a/b.pyc", True, False, False, False, False, False), ("logs/x.LOG", True, False, False, False, False, False),
    ("yarn.lock", False, True, False, False, False, False), ("a/package-lock.json", False, True, False, False, False, False), ("web/app.min.js", False, True, False, False, False, False),
    ("a/vendor/x.py", False, True, False, False, False, False), ("own/x.py", False, True, False, False, False, False), ("a/own/x.py", False, False, False, False, False, False),
    ("types.d.ts", False, True, False, False, False, False), (".claude/skills/s/a.py", False, False, True, False, False, True), ("p/.cursor/r.ts", False, False, True, False, False, False),
    ("a/x.test.ts", False, False, False, True, False, False), ("a/x.spec.tsx", False, False, False, True, False, False), ("tests/x.py", False, False, False, True, False, False), ("a/x_test.go", False, False, False, True, False, False),
    ("app/page.tsx", False, False, False, False, True, False), ("vite.config.ts", False, False, False, False, True, False), ("a/.hidden.ts", False, False, False, False, True, False),
    ("a/bin/run.ts", False, False, False, False, False, True), ("tools/run.py", False, False, False, False, False, True), ("binary/run.py", False, False, False, False, False, False), ("lib/a.py", False, False, False, False, False, False),
]
_FLAGS = ("junk", "ignored", "vendored", "test", "config", "scripts")


@query("path_flags", _values(_PATHS, "path, " + ", ".join(f"is_{x}" for x in _FLAGS)))
def path_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    said = (T.is_junk(p), T.is_ignored(p, ["own/*"]), T.is_vendored(p), T.is_test(p), T.is_config(T.stem_of(p)), T.is_script_area(p))
    return spark.createDataFrame([(r[0],) for r in _PATHS], "path string").select("path", *[x.alias(f"is_{n}") for x, n in zip(said, _FLAGS)])


_FOLDERS = [("/home/my app/x", "-home-my app-x"), ("/", "-"), ("", "")]


@query("project_folders", _values(_FOLDERS, "cwd, folder"))
def project_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(c, transcripts.project_folder(c)) for c, _ in _FOLDERS], "cwd string, folder string")


@query("project_counts", "SELECT '-home-my app%' || conv_id % 2 AS project, count(DISTINCT conv_id) AS transcripts FROM conversations WHERE turn IS NOT NULL GROUP BY 1 ORDER BY 1 LIMIT 20")
def project_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the doctor shows: logs by project."""
    logs = log_lines(spark, sf_dir).select("path").distinct()
    return transcripts.by_project(logs.select(F.element_at(F.split("path", "/"), -2).alias("project")))
