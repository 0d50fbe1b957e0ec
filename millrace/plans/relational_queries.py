"""Anti joins, pairing of arms, merging and ranking over orders, parts and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import experiments, findings
from millrace.sources.tables import table

QUERIES, SQL = {}, {}


def query(name: str, sql: str):  # noqa: ANN201
    def keep(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return keep


@query("orphan_parts", "SELECT p_partkey, p_size FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity >= p.p_size)")
def orphan_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, lines = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity")
    return p.join(lines, (F.col("p_partkey") == F.col("l_partkey")) & (F.col("l_quantity") >= F.col("p_size")), "left_anti").select("p_partkey", "p_size")


@query("orphan_customers", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')")
def orphan_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").startswith("1")).select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(used, "c_custkey", "left_anti").select("c_custkey", "c_name")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as runs: the supplier's last digits are the task, the return flag the arm, its success whether it shipped in full lots."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 50).cast("string").alias("task"), F.when(F.col("l_returnflag") == "N", "baseline").when(F.col("l_returnflag") == "A", "optimized").otherwise("other").alias("config"),
        F.floor("l_extendedprice").cast("bigint").alias("total_tokens"), (F.col("l_quantity") >= 10).alias("success"),
        F.col("l_linestatus").alias("status"), (F.col("l_linenumber") % 3).alias("rep"), F.concat(F.lit("T"), F.col("l_linenumber").cast("string")).alias("tier"), "l_orderkey", "l_linenumber",
    )


_RUNS = """runs AS (SELECT CAST(l_suppkey % 50 AS VARCHAR) AS task, CASE l_returnflag WHEN 'N' THEN 'baseline' WHEN 'A' THEN 'optimized' ELSE 'other' END AS config,
  CAST(floor(l_extendedprice) AS BIGINT) AS total_tokens, l_quantity >= 10 AS success, CASE WHEN l_linestatus = 'O' THEN 'A' ELSE 'C' END AS arm, l_linenumber % 3 AS rep, 'T' || l_linenumber AS tier, l_orderkey * 10 + l_linenumber AS pos FROM lineitem)"""
_PAIRS = f"""{_RUNS}, m AS (SELECT task, avg(total_tokens) FILTER (config = 'baseline') AS b, avg(total_tokens) FILTER (config = 'optimized') AS o,
  avg(success::INT) FILTER (config = 'baseline') AS bok, avg(success::INT) FILTER (config = 'optimized') AS ook FROM runs GROUP BY task), pairs AS (SELECT * FROM m WHERE b IS NOT NULL AND o IS NOT NULL)"""


@query("ab_pairing", f"WITH {_PAIRS} SELECT task, round(b, 6) AS base_tokens, round(o, 6) AS opt_tokens, round(100 * (b - o) / b, 6) AS save_pct, round(bok, 6) AS base_ok, round(ook, 6) AS opt_ok FROM pairs")
def ab_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(experiments.paired(runs(spark, sf_dir)), "base_tokens", "opt_tokens", "save_pct", "base_ok", "opt_ok")


@query("ab_overall", f"WITH {_PAIRS} SELECT round(sum(b), 4) AS base_tokens, round(sum(o), 4) AS opt_tokens, round(100 * (sum(b) - sum(o)) / sum(b), 4) AS save_pct, NOT bool_or(ook < bok) AS quality_held FROM pairs")
def ab_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(experiments.overall(experiments.paired(runs(spark, sf_dir))), "base_tokens", "opt_tokens", "save_pct", places=4)


def _round(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


def _ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs(spark, sf_dir)
    return rows.select("tier", "task", F.when(F.col("status") == "O", "A").otherwise("C").alias("arm"), "rep", F.col("success").alias("ok"), F.col("total_tokens").alias("tokens"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))


_LIFT = f"""{_RUNS}, last AS (SELECT tier, task, rep, arm, arg_max(success, (pos, success)) AS ok FROM runs GROUP BY ALL),
pair AS (SELECT a.tier, count_if(NOT a.ok AND c.ok) AS rescued, count_if(a.ok AND NOT c.ok) AS damaged FROM last a JOIN last c ON a.tier = c.tier AND a.task = c.task AND a.rep = c.rep AND a.arm = 'A' AND c.arm = 'C' GROUP BY a.tier),
t AS (SELECT tier, sum(success::INT) FILTER (arm = 'A') AS ra, count(*) FILTER (arm = 'A') AS na, sum(success::INT) FILTER (arm = 'C') AS rc, count(*) FILTER (arm = 'C') AS nc,
  sum(total_tokens) FILTER (arm = 'A') AS ta, sum(total_tokens) FILTER (arm = 'C') AS tc FROM runs GROUP BY tier HAVING count(*) FILTER (arm = 'A') > 0 AND count(*) FILTER (arm = 'C') > 0),
lift AS (SELECT tier, ra / na AS acc_a, rc / nc AS acc_c, rc / nc - ra / na AS lift, coalesce(rescued, 0)::BIGINT AS rescued, coalesce(damaged, 0)::BIGINT AS damaged, ta / na AS tokens_a, tc / nc AS tokens_c FROM t LEFT JOIN pair USING (tier))"""


@query("arm_lift", f"WITH {_LIFT} SELECT tier, round(acc_a, 6) AS acc_a, round(acc_c, 6) AS acc_c, round(lift, 6) AS lift, rescued, damaged, round(tokens_a, 4) AS tokens_a, round(tokens_c, 4) AS tokens_c FROM lift")
def arm_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_round(experiments.lift(_ladder(spark, sf_dir)), "acc_a", "acc_c", "lift"), "tokens_a", "tokens_c", places=4)


@query("cap_tier", f"WITH {_LIFT} SELECT min(tier) FILTER (lift <= 0 OR damaged >= rescued) AS cap_tier FROM lift")
def cap_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.cap_tier(experiments.lift(_ladder(spark, sf_dir)))


@query(
    "pareto_vs_baseline",
    """WITH a AS (SELECT o_orderpriority AS arm, avg((o_orderstatus = 'F')::INT) AS accuracy, avg(CAST(floor(o_totalprice) AS BIGINT)) AS mean_tokens FROM orders GROUP BY 1), b AS (SELECT max(mean_tokens) AS base FROM a WHERE arm = '1-URGENT')
SELECT arm, round(accuracy, 6) AS accuracy, round(mean_tokens, 4) AS mean_tokens, round(CASE WHEN base > 0 THEN 100 * (mean_tokens - base) / base END, 6) AS delta_pct FROM a, b""",
)
def pareto_vs_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("arm"), (F.col("o_orderstatus") == "F").alias("ok"), F.floor("o_totalprice").cast("bigint").alias("tokens"))
    return _round(_round(experiments.against_baseline(rows, "1-URGENT"), "accuracy", "delta_pct"), "mean_tokens", places=4)


@query("fanout_totals", f"WITH {_RUNS} SELECT arm, rep, sum(total_tokens)::BIGINT AS tokens, bool_and(success) AS ok FROM runs GROUP BY arm, rep")
def fanout_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.arm_totals(_ladder(spark, sf_dir).select("arm", F.col("rep").cast("bigint").alias("rep"), "tokens", "ok")).withColumn("rep", F.col("rep").cast("int"))


@query(
    "upsert_merge",
    """WITH base AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS title, o_totalprice AS impact_usd, 0 AS side, o_orderkey AS pos FROM orders),
extra AS (SELECT CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey + 1000000 ELSE o_orderkey END AS VARCHAR) AS id, 'updated' AS title, o_totalprice * 2 AS impact_usd, 1 AS side, o_orderkey AS pos FROM orders WHERE o_orderpriority LIKE '2%'),
b AS (SELECT * FROM base UNION ALL SELECT * FROM extra)
SELECT id, arg_max(title, (side, pos)) AS title, arg_max(impact_usd, (side, pos)) AS impact_usd, arg_min(side, (side, pos)) AS side, arg_min(pos, (side, pos)) AS pos FROM b GROUP BY id""",
)
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    base = orders.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("title"), F.col("o_totalprice").alias("impact_usd"), F.col("o_orderkey").alias("pos"))
    key = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") + 1000000).otherwise(F.col("o_orderkey")).cast("string")
    extra = orders.where(F.col("o_orderpriority").startswith("2")).select(key.alias("id"), F.lit("updated").alias("title"), (F.col("o_totalprice") * 2).alias("impact_usd"), F.col("o_orderkey").alias("pos"))
    return findings.upserted(base, extra)


@query(
    "finding_rank",
    """WITH f AS (SELECT o_orderpriority || '/' || o_orderstatus AS id, CASE o_orderstatus WHEN 'F' THEN 'high' WHEN 'O' THEN 'low' ELSE 'weird' END AS s, CAST(sum(floor(o_totalprice)) AS DOUBLE) AS impact_usd FROM orders GROUP BY ALL),
c AS (SELECT id, CASE WHEN s IN ('high', 'medium', 'low', 'info') THEN s ELSE 'info' END AS severity, impact_usd FROM f)
SELECT id, severity, impact_usd, row_number() OVER (ORDER BY CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END DESC, impact_usd DESC, id) AS rank FROM c""",
)
def finding_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    severity = F.when(status == "F", "high").when(status == "O", "low").otherwise("weird")
    found = table(spark, sf_dir, "orders").groupBy(F.concat_ws("/", "o_orderpriority", status).alias("id"), severity.alias("severity")).agg(F.sum(F.floor("o_totalprice")).cast("double").alias("impact_usd"))
    return findings.ranked(findings.coerced(found)).withColumn("rank", F.col("rank").cast("bigint"))


@query("max_modules_cap", "SELECT p_partkey, p_name, (SELECT greatest(0, count(*) - 40) FROM part) AS truncated FROM part ORDER BY p_size, p_name, p_partkey LIMIT 40")
def max_modules_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    return findings.capped(rows, [F.col("p_size"), F.col("p_name"), F.col("p_partkey")], 40).drop("p_size")


@query("brand_sets", "SELECT p_brand FROM part WHERE p_size < 5 INTERSECT SELECT p_brand FROM part WHERE p_size > 45")
def brand_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return parts.where("p_size < 5").select("p_brand").intersect(parts.where("p_size > 45").select("p_brand"))
