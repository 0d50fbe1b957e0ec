"""Usage, cost, score and grade queries.

lineitem stands for turns: an order is a session, its lines are turns, with token counters made from its numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import usage
from millrace.operators import findings, sessions
from millrace.sources.tables import table

QUERIES, SQL = {}, {}


def query(name: str, sql: str):  # noqa: ANN201
    def keep(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return keep


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = lambda x: F.floor(x).cast("bigint")
    price = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("seq"), whole(price).alias("input_tokens"), whole(F.col("l_quantity") * 10).alias("output_tokens"),
        whole(price * F.col("l_discount") * 20).alias("cache_read_tokens"), whole(F.col("l_tax") * 1000).alias("cache_creation_tokens"), (F.col("l_returnflag") == "R").alias("is_error"),
        (F.col("l_linestatus") == "F").alias("is_compaction"), "l_shipdate", "l_suppkey",
    )


TURNS = """turns AS (SELECT l_orderkey AS session_id, CAST(floor(l_extendedprice) AS BIGINT) AS i, CAST(floor(l_quantity * 10) AS BIGINT) AS o,
  CAST(floor(l_extendedprice * l_discount * 20) AS BIGINT) AS r, CAST(floor(l_tax * 1000) AS BIGINT) AS w, l_returnflag = 'R' AS is_error, l_linestatus = 'F' AS is_compaction FROM lineitem)"""
#: Costs in units of 1e-8 USD are whole numbers at the default prices; half_even rounds them to 1e-4.
SUMS = f"""{TURNS}, sums AS (SELECT session_id, sum(i)::BIGINT AS i, sum(o)::BIGINT AS o, sum(r)::BIGINT AS r, sum(w)::BIGINT AS w, count(*) AS turns,
  count_if(is_error) AS errors, count_if(is_compaction) AS compactions FROM turns GROUP BY 1),
exact AS (SELECT *, CASE WHEN i + r + w = 0 THEN 0.0 ELSE r::DOUBLE / (i + r + w) END AS ratio, 300 * i + 1500 * o + 30 * r + 375 * w AS cost8, 270 * i AS miss8 FROM sums),
costs AS (SELECT *, round_even(ratio, 4) AS ratio4, cost8 // 10000 + CASE WHEN cost8 % 10000 > 5000 OR (cost8 % 10000 = 5000 AND (cost8 // 10000) % 2 = 1) THEN 1 ELSE 0 END AS cost4,
  CASE WHEN ratio < 0.55 THEN miss8 // 10000 + CASE WHEN miss8 % 10000 > 5000 OR (miss8 % 10000 = 5000 AND (miss8 // 10000) % 2 = 1) THEN 1 ELSE 0 END ELSE 0 END AS waste4 FROM exact)"""


def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir)
    sums = rows.groupBy("session_id").agg(
        *[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")],
        F.count("*").alias("turns"), F.count_if("is_error").alias("errors"), F.count_if("is_compaction").alias("compactions"),
    )
    return sessions.with_costs(sums)


@query("token_cost", f"WITH {SUMS} SELECT session_id, i AS input_tokens, o AS output_tokens, r AS cache_read_tokens, w AS cache_creation_tokens, cost4 / 10000.0 AS est_cost_usd FROM costs")
def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return costs(spark, sf_dir).select("session_id", "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", F.col("est_cost_usd").cast("double").alias("est_cost_usd"))


@query("cache_ratio_waste", f"WITH {SUMS} SELECT session_id, ratio4 AS cache_hit_ratio, waste4 / 10000.0 AS cache_waste_usd FROM costs")
def cache_ratio_waste(spark: SparkSession, sf_dir: str) -> DataFrame:
    return costs(spark, sf_dir).select("session_id", "cache_hit_ratio", F.col("cache_waste_usd").cast("double").alias("cache_waste_usd"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = costs(spark, sf_dir).withColumn("denial_ratio", usage.rounded(usage.ratio(F.col("errors"), F.col("turns")), 4))
    extra = F.greatest(F.lit(0), F.col("turns") - 4)
    score = usage.waste_score(F.col("cache_hit_ratio"), extra, F.when(F.col("output_tokens") > 1500, 1).otherwise(0), F.lit(0), F.col("denial_ratio"), F.col("compactions"))
    return rows.withColumn("waste_score", score)


SCORED = f"""{SUMS}, denied AS (SELECT *, round_even(errors::DOUBLE / turns, 4) AS denial FROM costs),
scored AS (SELECT *, round_even(least(100.0, (CASE WHEN ratio4 < 0.55 THEN 34.0 * (1 - ratio4 / 0.55) ELSE 0.0 END) + least(20, 6 * greatest(0, turns - 4))
  + least(16, 8 * (CASE WHEN o > 1500 THEN 1 ELSE 0 END)) + 0 + (CASE WHEN denial > 0.04 THEN least(10.0, 200 * denial) ELSE 0.0 END) + least(6, 3 * greatest(0, compactions - 1))), 1) AS waste_score FROM denied)"""


@query("waste_score_topk", f"WITH {SCORED} SELECT session_id, waste_score, ratio4 AS cache_hit_ratio, denial AS denial_ratio, cost4 / 10000.0 AS est_cost_usd FROM scored ORDER BY waste_score DESC, session_id LIMIT 12")
def waste_score_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.worst(scored(spark, sf_dir), 12).select("session_id", "waste_score", "cache_hit_ratio", "denial_ratio", F.col("est_cost_usd").cast("double").alias("est_cost_usd"))


@query("waste_scores", f"WITH {SCORED} SELECT session_id, waste_score, CASE WHEN waste_score >= 30 THEN 'high' WHEN waste_score >= 15 THEN 'medium' ELSE 'low' END AS role FROM scored")
def waste_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("session_id", "waste_score", usage.waste_role(F.col("waste_score")).alias("role"))


@query(
    "global_totals",
    f"""WITH {SUMS}, t AS (SELECT count(*) AS sessions, sum(i)::BIGINT AS i, sum(o)::BIGINT AS o, sum(r)::BIGINT AS r, sum(w)::BIGINT AS w, sum(cost4)::BIGINT AS c, sum(waste4)::BIGINT AS m FROM costs)
SELECT sessions, i AS input_tokens, o AS output_tokens, r AS cache_read_tokens, w AS cache_creation_tokens, round_even(r::DOUBLE / (i + r + w), 4) AS overall_cache_hit_ratio,
  (c // 100 + CASE WHEN c % 100 > 50 OR (c % 100 = 50 AND (c // 100) % 2 = 1) THEN 1 ELSE 0 END) / 100.0 AS est_total_cost_usd,
  (m // 100 + CASE WHEN m % 100 > 50 OR (m % 100 = 50 AND (m // 100) % 2 = 1) THEN 1 ELSE 0 END) / 100.0 AS reclaimable_cache_usd FROM t""",
)
def global_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.totals(costs(spark, sf_dir))


@query("grade_sessions", f"WITH {SCORED}, g AS (SELECT CASE WHEN 100 - waste_score >= 90 THEN 'A' WHEN 100 - waste_score >= 78 THEN 'B' WHEN 100 - waste_score >= 62 THEN 'C' WHEN 100 - waste_score >= 45 THEN 'D' ELSE 'F' END AS grade FROM scored) SELECT grade, count(*) AS sessions FROM g GROUP BY grade")
def grade_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select(usage.grade(100 - F.col("waste_score")).alias("grade")).groupBy("grade").agg(F.count("*").alias("sessions"))


@query("cost_trend_last40", "SELECT o_orderkey AS session_id, o_orderdate AS started, o_totalprice AS cost FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n <= 40 AND (SELECT count(*) FROM orders) >= 3")
def cost_trend_last40(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_orderdate").alias("started"), F.col("o_totalprice").alias("cost"))
    return findings.latest(rows, "started", "session_id", 40)


@query(
    "savings_projection",
    f"""WITH {SUMS}, again AS (SELECT DISTINCT l_orderkey AS session_id FROM lineitem GROUP BY l_orderkey, l_suppkey % 10 HAVING count(*) >= 3),
s AS (SELECT count(*) AS n, count(a.session_id) AS e, sum(i + r + w)::BIGINT AS ctx, coalesce(sum(CASE WHEN a.session_id IS NOT NULL THEN i + r + w END), 0)::BIGINT AS ectx,
  coalesce(sum(CASE WHEN a.session_id IS NOT NULL THEN cost4 END), 0)::BIGINT / 10000.0 AS cost FROM costs LEFT JOIN again a USING (session_id)),
t AS (SELECT *, CAST(round_even(ectx * 0.41::DOUBLE, 0) AS BIGINT) AS lo, CAST(round_even(ectx * 0.47::DOUBLE, 0) AS BIGINT) AS hi FROM s)
SELECT n AS total_sessions, e AS map_eligible_sessions, ctx AS total_context_tokens, ectx AS eligible_context_tokens, lo AS map_tokens_low, hi AS map_tokens_high,
  round_even(cost * 0.41::DOUBLE, 2) AS map_usd_low, round_even(cost * 0.47::DOUBLE, 2) AS map_usd_high, round_even(lo::DOUBLE / ctx, 4) AS pct_low, round_even(hi::DOUBLE / ctx, 4) AS pct_high FROM t""",
)
def savings_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    again = sessions.repeats(turns(spark, sf_dir).select("session_id", (F.col("l_suppkey") % 10).cast("string").alias("file")), ["session_id"], "file", usage.REREAD_COUNT)
    files = sessions.counted(again, "session_id", "file", "reread_files")
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    rows = costs(spark, sf_dir).join(files, "session_id", "left").withColumn("reread_files", F.coalesce("reread_files", empty))
    return sessions.savings(rows)


@query("efficiency_grade", f"WITH {SUMS}, e AS (SELECT session_id, 100 * (0.6::DOUBLE * ratio4 + 0.4::DOUBLE * (1 - least(1.0, CASE WHEN cost4 = 0 THEN 0.0 ELSE (waste4 / 10000.0)::DOUBLE / (cost4 / 10000.0) END))) AS s FROM costs) SELECT session_id, round_even(s, 1) AS score, CASE WHEN s >= 90 THEN 'A' WHEN s >= 78 THEN 'B' WHEN s >= 62 THEN 'C' WHEN s >= 45 THEN 'D' ELSE 'F' END AS grade FROM e")
def efficiency_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = usage.context_tokens(F.col("input_tokens"), F.col("cache_read_tokens"), F.col("cache_creation_tokens"))
    score = usage.efficiency_score(F.when(context.isNotNull(), F.col("cache_hit_ratio")), F.col("cache_waste_usd").cast("double"), F.col("est_cost_usd").cast("double"))
    return costs(spark, sf_dir).select("session_id", usage.rounded(score, 1).alias("score"), usage.grade(score).alias("grade"))


@query("session_rollup", "SELECT user_id AS session_id, count(*) AS tool_calls, count_if(event_type = 'error')::BIGINT AS tool_errors, round_even(count_if(event_type = 'error')::DOUBLE / count(*), 4) AS denial_ratio, min(ts) AS started, max(ts) AS ended FROM events GROUP BY user_id")
def session_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.col("event_type") == "error"
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("session_id")).agg(F.count("*").alias("tool_calls"), F.count_if(error).alias("tool_errors"), F.min("ts").alias("started"), F.max("ts").alias("ended"))
    return rows.withColumn("denial_ratio", usage.rounded(usage.ratio(F.col("tool_errors"), F.col("tool_calls")), 4))


@query("tool_histogram", "SELECT session_id, string_agg(event_type || '=' || n, ',' ORDER BY n DESC, event_type) AS histogram FROM (SELECT user_id AS session_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY session_id")
def tool_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), "event_type")
    counted = sessions.counted(sessions.repeats(rows, ["session_id"], "event_type", 1), "session_id", "event_type", "h")
    return counted.select("session_id", F.array_join(F.transform(F.map_entries("h"), lambda e: F.concat(e.key, F.lit("="), e.value)), ",").alias("histogram"))


def _repeated(spark: SparkSession, sf_dir: str, least: int) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), "event_type", F.get_json_object("props", "$.k").alias("item"))
    return sessions.repeats(rows, ["session_id", "event_type"], "item", least)


_REPEATED = "SELECT user_id AS session_id, event_type, json_extract_string(props, '$.k') AS item, count(*) AS n FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY ALL HAVING count(*) >= {}"


@query("repeated_actions", _REPEATED.format(2))
def repeated_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repeated(spark, sf_dir, usage.REPEATED_COMMANDS)


@query("reread_keys", _REPEATED.format(3))
def reread_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repeated(spark, sf_dir, usage.REREAD_COUNT)


@query("first_last_event", "SELECT user_id AS session_id, arg_min(event_type, (ts, event_id)) AS first_type, arg_max(event_type, (ts, event_id)) AS last_type, min(event_id) FILTER (event_type = 'click') AS first_click FROM events GROUP BY user_id")
def first_last_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.struct("ts", "event_id")
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("session_id")).agg(F.min_by("event_type", at).alias("first_type"), F.max_by("event_type", at).alias("last_type"), F.min(F.when(F.col("event_type") == "click", F.col("event_id"))).alias("first_click"))


@query("big_values", "SELECT source, count_if(n_chars >= 5000)::BIGINT AS big_outputs, count(*) AS outputs FROM documents GROUP BY source")
def big_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(F.col("n_chars") >= 5000).alias("big_outputs"), F.count("*").alias("outputs"))


@query("denial_ratio_filter", "SELECT session_id, r AS denial_ratio FROM (SELECT user_id AS session_id, round_even(count_if(event_type = 'error')::DOUBLE / count(*), 4) AS r FROM events GROUP BY 1) WHERE r > 0.04")
def denial_ratio_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_rollup(spark, sf_dir).where(F.col("denial_ratio") > usage.HIGH_DENIAL_RATIO).select("session_id", "denial_ratio")


@query("top2_per_group", "SELECT session_id, supp, n FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, supp) AS k FROM (SELECT l_orderkey AS session_id, l_suppkey % 10 AS supp, count(*) AS n FROM lineitem GROUP BY ALL)) WHERE k <= 2")
def top2_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).groupBy("session_id", (F.col("l_suppkey") % 10).alias("supp")).agg(F.count("*").alias("n"))
    return findings.top_per_group(rows, ["session_id"], [F.col("n").desc(), F.col("supp")], 2)


@query("conv_text_chars", "SELECT conv_id, count(*) AS turns, sum(length(coalesce(text, '')))::BIGINT AS text_chars, CAST(round_even(sum(length(coalesce(text, ''))) / 4.0, 0) AS BIGINT) AS est_tokens FROM conversations GROUP BY conv_id")
def conv_text_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = F.sum(F.length(F.coalesce("text", F.lit("")))).alias("text_chars")
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), chars)
    return rows.withColumn("est_tokens", usage.tokens_of_chars(F.col("text_chars")))


@query("conv_role_filter", "SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations FROM conversations WHERE role IN ('assistant', 'user') GROUP BY role")
def conv_role_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where(F.col("role").isin("assistant", "user"))
    return rows.groupBy("role").agg(F.count("*").alias("turns"), F.count_distinct("conv_id").alias("conversations"))


@query("conv_tokens_est", "SELECT conv_id, turn, CAST(round_even(length(text) / 4.0, 0) AS BIGINT) AS est_tokens FROM conversations WHERE text IS NOT NULL")
def conv_tokens_est(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", usage.tokens_of_chars(F.length("text")).alias("est_tokens"))


@query("content_blocks_explode", "SELECT conv_id, turn, unnest(range(len(parts))) AS pos, unnest(parts) AS block FROM (SELECT conv_id, turn, string_split(text, '. ') AS parts FROM conversations WHERE text IS NOT NULL)")
def content_blocks_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("text is not null")
    return rows.select("conv_id", "turn", F.posexplode(F.split("text", r"\. ")).alias("pos", "block")).withColumn("pos", F.col("pos").cast("bigint"))
