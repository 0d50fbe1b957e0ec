"""Source-tree hygiene queries: documents stand for files (source is the area, the id the path), pages for files with references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import findings, repo, rules
from millrace.sources.tables import table

QUERIES, SQL = {}, {}


def query(name: str, sql: str):  # noqa: ANN201
    def keep(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return keep


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").withColumns({"digest": T.digest_of(F.encode("text", "utf-8")), "size": F.octet_length("text").cast("bigint")})


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Python files, whole, in the shape that ``operators.repo`` takes."""
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".py"))
    return files(spark, sf_dir).select(path.alias("path"), "size", F.col("text").alias("content"), "digest", F.lit(False).alias("is_changed"))


def held(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repo.features(sources(spark, sf_dir)).select("path", "size", "digest", "class", "suffix", "stem", "folder", "area", "norm", "lines").persist()


_MARKED = " OR ".join(f"contains(lower(substring(text, 1, {T.HEAD_CHARS})), '{m}')" for m in T.GENERATED_MARKS)
_FILES = "files AS (SELECT *, sha1(text) AS digest, octet_length(encode(text)) AS size, coalesce(source, 'none') || '/d' || doc_id || '.py' AS path FROM documents WHERE text IS NOT NULL)"
_TARGETS = f"""{_FILES}, heads AS (SELECT doc_id, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM (SELECT doc_id, string_split(substring(text, 1, 4000), chr(10)) AS l FROM files)),
minified AS (SELECT doc_id, list_max(list_transform(l, lambda x: length(x))) > 2000 OR list_sum(list_transform(l, lambda x: length(x)))::DOUBLE / greatest(1, len(l)) > 350 AS minified FROM heads),
targets AS (SELECT f.* FROM files f JOIN minified USING (doc_id) WHERE length(text) > 0 AND NOT coalesce(minified, false) AND NOT ({_MARKED}))"""
_EXACT = "exact AS (SELECT digest, count(*) AS n, min(size)::BIGINT AS size, min(path) AS first FROM targets WHERE size >= 200 GROUP BY digest HAVING count(*) > 1)"


@query("exact_dup_groups", f"WITH {_TARGETS}, {_EXACT} SELECT digest, n, size, first, false AS is_doc FROM exact")
def exact_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repo.copies(held(spark, sf_dir))


@query("dup_reclaimable", f"WITH {_TARGETS}, {_EXACT} SELECT count(*) AS groups, coalesce(sum((n - 1) * size), 0)::BIGINT AS reclaimable_bytes FROM exact")
def dup_reclaimable(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = held(spark, sf_dir)
    nothing = spark.createDataFrame([], "path string, is_script boolean")
    return rules.summary(found, repo.copies(found), nothing).select(F.col("duplicate_groups").alias("groups"), "reclaimable_bytes")


_NORMAL = r"""lines AS (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
kept AS (SELECT doc_id, i, lower(regexp_replace(trim(line, ' ' || chr(9)), '\s+', ' ', 'g')) AS line FROM lines WHERE trim(line, ' ' || chr(9)) <> '' AND NOT regexp_matches(trim(line, ' ' || chr(9)), '^(//|#|\*|/\*|import |export \{|from )')),
norm AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS norm FROM kept GROUP BY doc_id)"""


@query(
    "near_dup_groups",
    f"""WITH {_TARGETS}, {_EXACT}, {_NORMAL} SELECT '.py' AS suffix, sha1(norm) AS norm, count(*) AS n, min(t.path) AS first FROM norm JOIN targets t USING (doc_id) LEFT JOIN exact d ON t.digest = d.digest
WHERE t.size >= 800 GROUP BY norm.norm HAVING count(*) > 1 AND NOT bool_and(d.digest IS NOT NULL)""",
)
def near_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, by their whole normal form."""
    found = held(spark, sf_dir)
    return repo.near_copies(found, repo.copies(found))


@query("normal_source_groups", f"WITH {_NORMAL} SELECT sha1(norm) AS norm, count(*) AS n, min(doc_id) AS first FROM norm GROUP BY norm HAVING count(*) > 1")
def normal_source_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = files(spark, sf_dir).select("doc_id", T.normal_source(F.col("text")).alias("norm")).where("norm <> ''")
    return own.groupBy(F.sha1(F.encode("norm", "utf-8")).alias("norm")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query(
    "dead_run_length",
    """WITH lines AS (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS line, len(l) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
own AS (SELECT * FROM lines WHERE NOT (i = n - 1 AND line = '')), islands AS (SELECT doc_id, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM own WHERE length(line) <= 80),
runs AS (SELECT doc_id, count(*) AS run FROM islands GROUP BY doc_id, g) SELECT d.doc_id, coalesce(max(run), 0)::BIGINT AS dead_run FROM documents d LEFT JOIN runs USING (doc_id) WHERE d.text IS NOT NULL GROUP BY d.doc_id""",
)
def dead_run_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = T.longest_run(T.lines_of(F.col("text")), lambda x: F.length(x) <= 80)
    return files(spark, sf_dir).select("doc_id", run.cast("bigint").alias("dead_run"))


@query("line_counts_big", "SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS lines FROM documents WHERE length(text) - length(replace(text, chr(10), '')) + 1 >= 50")
def line_counts_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", T.line_count(F.col("text")).cast("bigint").alias("lines")).where("lines >= 50")


@query(
    "minified_flag",
    """WITH l AS (SELECT doc_id, string_split(substring(text, 1, 4000), chr(10)) AS l FROM documents WHERE length(text) > 0),
own AS (SELECT doc_id, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM l), m AS (SELECT doc_id, list_max(list_transform(l, lambda x: length(x))) AS longest, list_sum(list_transform(l, lambda x: length(x)))::DOUBLE / greatest(1, len(l)) AS mean FROM own)
SELECT doc_id, longest > 2000 AS has_long_line, mean > 350 AS has_long_lines FROM m WHERE longest > 2000 OR mean > 350""",
)
def minified_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.substring("text", 1, T.SAMPLE_CHARS)
    flags = files(spark, sf_dir).where(T.is_minified(F.col("text"))).select("doc_id", (T.longest_line(head) > T.LONG_LINE).alias("has_long_line"), (T.mean_line(head) > T.MEAN_LINE).alias("has_long_lines"))
    return flags


@query("generated_flag", "SELECT source, count_if(regexp_matches(lower(substring(text, 1, 1500)), 'license|licence|copyright|rights reserved'))::BIGINT AS marked, count(*) AS files FROM documents WHERE text IS NOT NULL GROUP BY source")
def generated_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = T.has_mark(F.col("text"), ("license", "licence", "copyright", "rights reserved"))
    return files(spark, sf_dir).groupBy("source").agg(F.count_if(marked).alias("marked"), F.count("*").alias("files"))


@query("size_by_area", f"WITH {_FILES} SELECT split_part(path, '/', 1) AS area, sum(size)::BIGINT AS bytes FROM files GROUP BY ALL ORDER BY bytes DESC, area LIMIT 12")
def size_by_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repo.size_by_area(repo.classified(sources(spark, sf_dir)), 12)


@query("largest_file", f"WITH {_FILES} SELECT path, size FROM files ORDER BY size DESC, path LIMIT 1")
def largest_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repo.largest(repo.classified(sources(spark, sf_dir)))


@query("ambiguous_names", "SELECT p_name AS stem, count(DISTINCT p_brand) AS folders FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) >= 4")
def ambiguous_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("stem")).agg(F.count_distinct("p_brand").alias("folders")).where("folders >= 4")


@query(
    "link_refs",
    r"""WITH t AS (SELECT page_id, trim(unnest(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS token FROM pages),
n AS (SELECT page_id, nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(token, '^(\./|\.\./)+', ''), '^@+', ''), '^/+', ''), '\.(ts|tsx|js|jsx|mjs|cjs|css|scss|json)$', ''), '') AS norm FROM t WHERE contains(token, '/'))
SELECT norm, count(*) AS refs, count(DISTINCT page_id) AS pages FROM n WHERE norm IS NOT NULL GROUP BY norm""",
)
def link_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("token"))
    norm = tokens.select("page_id", T.normal_reference(F.col("token")).alias("norm")).where("norm is not null")
    return norm.groupBy("norm").agg(F.count("*").alias("refs"), F.count_distinct("page_id").alias("pages"))


@query("url_parts", r"SELECT page_id, regexp_replace(string_split(string_split(string_split(url, '://')[2], '?')[1], '#')[1], '/+$', '') AS path, CASE WHEN contains(regexp_replace(string_split(string_split(string_split(url, '://')[2], '?')[1], '#')[1], '/+$', ''), '/') THEN string_split(string_split(url, '://')[2], '/')[1] ELSE '.' END AS area FROM pages")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "^[^:]*://", ""), "[?#].*$", ""), "/+$", "")
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path")).withColumn("area", T.area_of(F.col("path")))


@query("normalized_cmd", r"SELECT doc_id, substring(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 160) AS command FROM documents WHERE text IS NOT NULL")
def normalized_cmd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", T.normal_command(F.col("text")).alias("command"))


@query("changed_exclusion", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def changed_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id", "source")


@query("prefix_budget", "SELECT doc_id, cost, spent FROM (SELECT doc_id, coalesce(n_chars, 0) // 4 AS cost, sum(coalesce(n_chars, 0) // 4) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS spent FROM documents) WHERE spent <= 130000")
def prefix_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.coalesce("n_chars", F.lit(0)) / 4).alias("cost"))
    return findings.prefix_sums(rows, "cost", "doc_id").where("spent <= 130000")
