"""The repository scan over a tree made of the part table: 16 kinds of files, so that each rule has files that it is about."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import repo, rules, surface
from millrace.report.repo import Scan, scanned
from millrace.sources.tables import table

QUERIES, SQL = {}, {}


def query(name: str, sql: str):  # noqa: ANN201
    def keep(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return keep


#: Of each kind of file, by the part's number k and its group b = k // 64: the path and the text, as SQL that both sides run.
_KINDS = [
    ("'lib/near' || k || '.ts'", "'// v' || k || '{n}import a from ''a''{n}' || repeat('export function part_' || b || '(a)' || repeat(' ', (k % 3 + 1)::INT) || '{ return 1 }{n}', 30)"),
    ("'lib/copy' || k || '.py'", "repeat('value = ' || b || '{n}', 40)"),
    ("'docs/d' || k || '.md'", "repeat('Words of ' || b || '.{n}', 30)"),
    ("'logs/x' || k || '.log'", "'line ' || k"),
    ("'src/c' || k || '.py'", "repeat('# y = call(1){n}', (k % 23)::INT) || 'x = ' || k || '{n}'"),
    ("'src/l' || k || '.py'", "repeat('z = 1{n}', (600 + k % 300)::INT) || 'y = ' || k"),
    ("'d' || k || '/util' || k % 96 || '.ts'", "'export const util' || k || ' = 1{n}'"),
    ("'tests/t' || k || '.test.ts'", "'it(){n}'"),
    ("'app' || k || '/page.tsx'", "'export default function Page' || k || '() {}{n}'"),
    ("'.cursor/v' || k || '.ts'", "'export const v = 1{n}'"),
    ("'gen/g' || k || '.ts'", "'// @generated{n}import ''../lib/' || CASE WHEN k % 32 = 10 THEN 'copy' ELSE 'none' END || (k - 9) || '''{n}'"),
    ("'big/u' || k || '.py'", "CAST(NULL AS STRING)"),
    ("'tools/s' || k || '.ts'", "'#!/usr/bin/env node{n}go(){n}'"),
    ("'scripts/o' || k || '.ts'", "'run(' || k || '){n}'"),
    ("'web/i' || k || '.ts'", "CASE k % 64 WHEN 14 THEN 'import ''./web/j' || (k + 1) || '''{n}' WHEN 30 THEN 'spawn(\"j' || (k + 1) || '.js\"){n}' ELSE 'alone(' || k || '){n}' END"),
    ("'web/j' || k || '.ts'", "'go(' || k || '){n}'"),
]


def _case(which: int, n: str) -> str:
    return "CASE k % 16 " + " ".join(f"WHEN {i} THEN {pair[which].replace('{n}', n)}" for i, pair in enumerate(_KINDS)) + " END"


_KEYS = "SELECT CAST(p_partkey AS BIGINT) AS k, CAST(floor(p_partkey / 64) AS BIGINT) AS b FROM {}"
_NEWLINE = "' || chr(10) || '"
_TREE = f"""keys AS ({_KEYS.format('part')}), texts AS (SELECT k, b, k % 16 AS kind, {_case(0, _NEWLINE)} AS path, {_case(1, _NEWLINE)} AS content FROM keys),
tree AS (SELECT *, CASE WHEN kind = 11 THEN 500000 ELSE octet_length(encode(content)) END AS size, k % 11 = 0 AS changed, split_part(path, '/', 1) AS area,
  CASE kind WHEN 3 THEN 0 WHEN 11 THEN 2 WHEN 10 THEN 3 WHEN 9 THEN 4 ELSE 5 END AS class, kind NOT IN (2, 3, 9, 10, 11) AS source FROM texts)"""
_ORPHANS = """orphans AS (SELECT path, kind = 13 AS is_script FROM tree t WHERE NOT changed AND (kind IN (0, 4, 5, 6, 13, 14)
  OR (kind = 1 AND NOT EXISTS (SELECT 1 FROM keys g WHERE g.k = t.k + 9 AND g.k % 32 = 10)) OR (kind = 15 AND k % 64 NOT IN (15, 31))))"""
_COPIES = """copies AS (SELECT sha1(content) AS digest, count(*) AS n, min(size) AS size, min(path) AS first, kind = 2 AS is_doc FROM tree WHERE kind IN (1, 2) GROUP BY content, kind HAVING count(*) > 1)"""
_NEAR = """near AS (SELECT b, count(*) AS n, min(path) AS first FROM tree WHERE kind = 0 GROUP BY b HAVING count(*) > 1)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree as ``sources.files`` would read it."""
    keys = table(spark, sf_dir, "part").selectExpr("CAST(p_partkey AS BIGINT) AS k", "CAST(floor(p_partkey / 64) AS BIGINT) AS b")
    made = keys.selectExpr("k", f"{_case(0, _NEWLINE)} AS path", f"{_case(1, _NEWLINE)} AS content")
    size = F.when(F.col("content").isNull(), 500_000).otherwise(F.octet_length("content")).cast("bigint")
    return made.select("path", size.alias("size"), "content", T.digest_of(F.encode("content", "utf-8")).alias("digest"), (F.col("k") % 11 == 0).alias("is_changed"))


def scan(spark: SparkSession, sf_dir: str) -> Scan:
    """As the report does it: the content is read once, and what comes of it held."""
    return scanned(repo.features(files(spark, sf_dir)).persist())


@query("tree_classes", f"WITH {_TREE} SELECT area, class, CASE kind WHEN 8 THEN '.tsx' ELSE regexp_extract(path, '[.][a-z]+$') END AS suffix, count(*) AS files, sum(size)::BIGINT AS bytes FROM tree WHERE kind <> 7 GROUP BY ALL")
def tree_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repo.classified(files(spark, sf_dir)).where("area <> 'tests'")
    return found.groupBy("area", "class", "suffix").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query("tree_copies", f"WITH {_TREE}, {_COPIES} SELECT digest, n, size, first, is_doc FROM copies")
def tree_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir).copies


@query("tree_near_copies", f"WITH {_TREE}, {_NEAR} SELECT '.ts' AS suffix, sha1(rtrim(repeat('export function part_' || b || '(a) {{ return 1 }}' || chr(10), 30), chr(10))) AS norm, n, first FROM near")
def tree_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir).near


@query("tree_group_members", f"WITH {_TREE}, {_COPIES} SELECT c.first, array_to_string(list_sort(list(path))[1:3], ' ') AS paths FROM copies c JOIN tree t ON sha1(t.content) = c.digest GROUP BY c.first")
def tree_group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark, sf_dir)
    return repo.members(found.files, found.copies, ["digest"]).select("first", F.array_join("paths", " ").alias("paths"))


@query("tree_scattered", f"WITH {_TREE} SELECT CASE kind WHEN 8 THEN 'page' ELSE 'util' || k % 96 END AS stem, count(*) AS folders FROM tree WHERE kind IN (6, 8) GROUP BY ALL HAVING count(*) >= 4")
def tree_scattered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repo.scattered(repo.features(files(spark, sf_dir)))


@query("tree_notable", f"WITH {_TREE} SELECT path, CASE kind WHEN 4 THEN k % 23 + 2 ELSE 601 + k % 300 END AS lines, CASE kind WHEN 4 THEN k % 23 ELSE 0 END AS dead_run FROM tree WHERE (kind = 4 AND k % 23 >= 10) OR (kind = 5 AND 601 + k % 300 >= 700)")
def tree_notable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repo.notable(repo.features(files(spark, sf_dir))).select("path", F.col("lines").cast("bigint").alias("lines"), F.col("dead_run").cast("bigint").alias("dead_run"))


@query("tree_orphans", f"WITH {_TREE}, {_ORPHANS} SELECT path, is_script FROM orphans")
def tree_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir).orphans


@query(
    "tree_references",
    f"""WITH {_TREE} SELECT stem, norm FROM (SELECT 'j' || (k + 1) AS stem, 'web/j' || (k + 1) AS norm FROM tree WHERE kind = 14 AND k % 64 = 14
UNION ALL SELECT CASE WHEN k % 32 = 10 THEN 'copy' ELSE 'none' END || (k - 9), 'lib/' || CASE WHEN k % 32 = 10 THEN 'copy' ELSE 'none' END || (k - 9) FROM tree WHERE kind = 10
UNION ALL SELECT 'env', 'usr/bin/env' WHERE EXISTS (SELECT 1 FROM tree WHERE kind = 12))""",
)
def tree_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, _ = repo.references(repo.features(files(spark, sf_dir)))
    return refs


@query("tree_bare_references", f"WITH {_TREE} SELECT 'j' || (k + 1) AS stem FROM tree WHERE kind = 14 AND k % 64 = 30")
def tree_bare_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repo.references(repo.features(files(spark, sf_dir)))[1]


_SUMMARY = f"""{_TREE}, {_COPIES}, {_ORPHANS}, c AS (SELECT count(*) AS files, sum(size)::BIGINT AS bytes, count_if(kind = 3)::BIGINT AS junk, coalesce(sum(size) FILTER (kind = 3), 0)::BIGINT AS junk_bytes,
  count_if(kind = 10)::BIGINT AS excluded_generated, count_if(source)::BIGINT AS scanned_source, max(size)::BIGINT AS largest_bytes FROM tree),
g AS (SELECT count(*) AS duplicate_groups, coalesce(sum((n - 1) * size), 0)::BIGINT AS copied FROM copies), o AS (SELECT count_if(NOT is_script)::BIGINT AS orphan_candidates FROM orphans)"""


@query(
    "tree_summary",
    f"""WITH {_SUMMARY} SELECT files, bytes, junk, junk_bytes, excluded_generated, scanned_source, largest_bytes, duplicate_groups, orphan_candidates, junk + duplicate_groups AS junk_count, junk_bytes + copied AS reclaimable_bytes,
round_even(greatest(0.0::DOUBLE, 100.0::DOUBLE - least(30.0, 4 * (junk + duplicate_groups)) - least(18.0, 1.5 * orphan_candidates) - least(16.0, 3 * duplicate_groups) - least(12.0::DOUBLE, 100 * (junk_bytes + copied)::DOUBLE / bytes)), 1) AS health_score FROM c, g, o""",
)
def tree_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir).summary()


@query("tree_areas", f"WITH {_TREE} SELECT area, sum(size)::BIGINT AS bytes FROM tree GROUP BY area ORDER BY bytes DESC, area LIMIT 12")
def tree_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repo.size_by_area(repo.classified(files(spark, sf_dir)), 12)


@query("tree_largest", f"WITH {_TREE} SELECT path, size FROM tree ORDER BY size DESC, path LIMIT 1")
def tree_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repo.largest(repo.classified(files(spark, sf_dir))).select("path", "size")


@query(
    "tree_findings",
    f"""WITH {_TREE}, {_COPIES}, {_NEAR}, {_ORPHANS}, stems AS (SELECT kind, k % 96 AS x FROM tree WHERE kind = 6 GROUP BY ALL HAVING count(*) >= 4 UNION ALL SELECT 8, 0 FROM tree WHERE kind = 8 HAVING count(*) >= 4),
f AS (SELECT 0 AS pos, 'junk-artifacts' AS id, CASE WHEN count(*) > 5 THEN 'high' ELSE 'medium' END AS severity, count(*) AS n, 10 AS most, min(path) AS first, true AS autofixable FROM tree WHERE kind = 3
UNION ALL SELECT 1, 'duplicate-code', 'medium', count(*), 8, min(first), false FROM copies WHERE NOT is_doc
UNION ALL SELECT 2, 'duplicate-docs', 'low', count(*), 8, min(first), false FROM copies WHERE is_doc
UNION ALL SELECT 3, 'near-duplicate-code', 'low', count(*), 8, min(first), false FROM near
UNION ALL SELECT 4, 'orphan-modules', CASE WHEN count(*) > 3 THEN 'medium' ELSE 'low' END, count(*), 12, min(path), false FROM orphans WHERE NOT is_script
UNION ALL SELECT 5, 'unreferenced-scripts', 'info', count(*), 12, min(path), false FROM orphans WHERE is_script
UNION ALL SELECT 6, 'oversized-files', 'low', count(*), 8, arg_min(path || ' (' || (601 + k % 300) || ' lines)', (-(k % 300), path)), false FROM tree WHERE kind = 5 AND 601 + k % 300 >= 700
UNION ALL SELECT 7, 'commented-out-code', 'low', count(*), 8, min(path), true FROM tree WHERE kind = 4 AND k % 23 >= 10
UNION ALL SELECT 8, 'ambiguous-basenames', 'info', count(*), 0, NULL, false FROM stems)
SELECT row_number() OVER (ORDER BY CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END DESC, least(n, most) DESC, pos) AS rank, id, severity, least(n, most) AS places, first, autofixable FROM f WHERE n > 0""",
)
def tree_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark, sf_dir).findings()
    ranked = found.withColumn("rank", F.row_number().over(Window.orderBy(*rules.by_locations())))
    return ranked.select(F.col("rank").cast("bigint").alias("rank"), "id", "severity", F.size("locations").cast("bigint").alias("places"), F.get("locations", F.lit(0)).alias("first"), "autofixable")


@query(
    "tree_modules",
    f"""WITH {_TREE}, m AS (SELECT path, kind = 7 AS is_test, CASE kind WHEN 0 THEN 'v' || k WHEN 7 THEN 'test suite' WHEN 12 THEN '!/usr/bin/env node' ELSE '' END AS summary,
  CASE kind WHEN 0 THEN '`part_' || b || '`' WHEN 6 THEN '`util' || k || '`' WHEN 8 THEN '`Page' || k || '`' ELSE '' END AS symbols, kind IN (12, 13) AS later, length(path) - length(replace(path, '/', '')) AS depth FROM tree WHERE kind IN (0, 6, 7, 8, 12))
SELECT path, is_test, summary, symbols, greatest(0, (SELECT count(*) FROM m) - 40) AS truncated FROM m ORDER BY later, is_test, depth, path LIMIT 40""",
)
def tree_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = surface.listed(surface.modules(repo.classified(files(spark, sf_dir))).persist())
    return found.select("path", "is_test", "summary", F.array_join("symbols", ", ").alias("symbols"), "truncated")


_LANGUAGES = {
    "go_surface": (".go", "concat('// Types of ', m, '.\\npackage m\\n', 'type ', n, ' struct{}\\nfunc (t *', n, ') Run', k, '() {}\\nfunc low', k, '() {}\\n')", "'`' || n || '`, `Run' || k || '`'"),
    "rust_surface": (".rs", "concat('/* Types of ', m, ' */\\npub async fn go_', k, '() {}\\n  pub struct ', n, ';\\nfn low() {}\\npub trait ', n, '\\n')", "'`go_' || k || '`, `' || n || '`'"),
}


def _language(name: str, suffix: str, text: str, symbols: str) -> None:
    """A module per part, in a language that expressions read."""

    @query(name, f"WITH p AS (SELECT p_partkey AS k, p_brand AS m, regexp_replace(p_type, '[^A-Za-z]+', '_', 'g') AS n FROM part) SELECT k, 'Types of ' || m AS summary, {symbols} AS symbols FROM p")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("m"), F.regexp_replace("p_type", "[^A-Za-z]+", "_").alias("n"))
        found = parts.select("k", surface.expression_symbols(F.expr(text), F.lit(suffix)).alias("s"))
        return found.select("k", "s.summary", F.array_join("s.symbols", ", ").alias("symbols"))


for _name, _of in _LANGUAGES.items():
    _language(_name, *_of)

#: Sources with what they offer, by the rules: self and cls aren't shown, a default is, records show their fields, private names are left out.
_MODULES = [
    ('"""Ports. More."""\nimport os\nLIMIT = 3\n', "Ports. More", ""),
    ('"""\n  Gauges of a mill...\n"""\nclass Gauge:\n    def read(self, unit="bar", /, *, raw): ...\n    async def reset(self): ...\n    def _own(self): ...\n', "Gauges of a mill", "`Gauge`: `read(unit=..., raw)`, `reset()`"),
    ("import dataclasses as d\n@d.dataclass(slots=True)\nclass Lot:\n    sku: str\n    n: int = 0\n    def pack(self, *boxes, **how): ...\n", "", "`Lot(sku, n=...)`: `pack(*boxes, **how)`"),
    ("class Shape:\n    sides: int\nclass Bare(Shape): pass\nclass _Own: pass\n", "", "`Shape(sides)`, `Bare`"),
    ("class Wide:\n" + "".join(f"    f{i}: int\n" for i in range(11)), "", "`Wide(f0, f1, f2, f3, f4, f5, f6, f7, f8, f9, ...)`"),
    ("def pour(a, b=1, *c, d, e=None, **f): ...\nasync def stir(cls, x): ...\ndef _no(): ...\n", "", "`pour(a, b=..., *c, d, e=..., **f)`, `stir(x)`"),
    ("def broken(:\n", "", ""),
    ("", "", ""),
]


@query("python_modules", "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{said}', '{symbols}')" for i, (_, said, symbols) in enumerate(_MODULES)) + ") t(module, summary, symbols)")
def python_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, text) for i, (text, _, _) in enumerate(_MODULES)], "module int, text string")
    return rows.select("module", surface.python_symbols(F.col("text")).alias("s")).select("module", "s.summary", F.array_join("s.symbols", ", ").alias("symbols"))


#: Trees with the scripts of their package file, whether their project file speaks of pytest, and how they are tested.
_TREES = [
    (["package.json", "a.py"], ["build", "test"], False, "npm test"),
    (["go.mod"], ["lint"], False, "npm run lint"),
    (["Cargo.toml", "go.mod"], [], False, "cargo test"),
    (["go.mod", "m/a.py"], [], False, "go test ./..."),
    (["m/conftest.py"], [], False, "pytest -q"),
    (["m/a.py"], [], True, "pytest -q"),
    (["m/a.py", "tests/test_a.py"], [], False, "python3 -m unittest discover -s tests -t . -q"),
    (["m/a.py"], [], False, "python3 -m unittest -q"),
    (["Makefile", "README.md"], [], False, "make test"),
    (["README.md"], [], True, ""),
]


@query("verify_commands", "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{want}')" for i, (*_, want) in enumerate(_TREES)) + ") t(tree, command)")
def verify_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for i, (paths, scripts, speaks, _) in enumerate(_TREES):
        one = surface.verify_command(spark.createDataFrame([(p,) for p in paths], "path string"), scripts, speaks).select(F.lit(i).alias("tree"), "command")
        out = one if out is None else out.unionAll(one)
    return out
