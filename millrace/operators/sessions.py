"""Session metrics from turns, totals over sessions, and the findings that they give.

Grouped sums have partial sums before the shuffle; maps are collected only after the threshold that keeps them small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import usage
from millrace.functions.text import normal_command

MAP = "map<string,bigint>"


def repeats(rows: DataFrame, keys: list[str], item: str, least: int) -> DataFrame:
    """keys, item and n of the items that come ``least`` times or more within their keys."""
    return rows.where(F.col(item).isNotNull()).groupBy(*keys, item).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def counted(rows: DataFrame, key: str, item: str, name: str, extra: bool = False) -> DataFrame:
    """key and a map from items to their n, most first then by item; with ``extra`` also what is beyond the first of each."""
    order = lambda a, b: F.when(a.n > b.n, -1).when(a.n < b.n, 1).when(a.item < b.item, -1).when(a.item > b.item, 1).otherwise(0)
    entries = F.array_sort(F.collect_list(F.struct(F.col(item).alias("item"), "n")), order)
    aggs = [F.map_from_entries(F.transform(entries, lambda x: F.struct(x.item, x.n))).alias(name)]
    if extra:
        aggs.append(F.sum(F.col("n") - 1).alias(f"{name}_extra"))
    return rows.groupBy(key).agg(*aggs)


def token_sums(turns: DataFrame, keys: list[str]) -> DataFrame:
    names = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")
    return turns.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names])


def with_costs(rows: DataFrame, price: usage.Price = usage.Price()) -> DataFrame:
    """Adds the cache ratio, cost and cache waste of four token counts, rounded to four places; the waste gate is on the unrounded ratio."""
    i, o, r, w = (F.col(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens"))
    exact = usage.ratio(r, usage.context_tokens(i, r, w))
    waste = F.when(exact < usage.LOW_CACHE_RATIO, usage.cache_miss_cost_usd(i, price)).otherwise(F.lit(0).cast("decimal(38,12)"))
    return rows.withColumns({"cache_hit_ratio": usage.rounded(exact, 4), "est_cost_usd": F.bround(usage.cost_usd(i, o, r, w, price), 4).cast("decimal(18,4)"), "cache_waste_usd": F.bround(waste, 4).cast("decimal(18,4)")})


def session_metrics(turns: DataFrame, attributes: DataFrame, price: usage.Price = usage.Price()) -> DataFrame:
    """A row per session that has turns. turns and attributes: as ``sources.transcripts`` gives them, both by path or both by session_id."""
    key = "path" if "path" in turns.columns else "session_id"
    big = F.filter("tool_result_chars", lambda x: x >= usage.BIG_OUTPUT_CHARS)
    sums = turns.groupBy(key).agg(
        F.count("*").alias("turns"), F.count_if(F.col("role") == "assistant").alias("assistant_turns"),
        *[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "tool_errors")],
        F.sum(F.size("tool_calls")).alias("tool_calls"), F.count_if("is_compaction").alias("compactions"), F.sum(F.size(big)).alias("big_outputs"),
    )
    calls = turns.select(key, F.inline("tool_calls"))
    reads = calls.where("name = 'Read'").select(key, "file_path")
    commands = calls.where("name = 'Bash' and command is not null").select(key, normal_command(F.col("command")).alias("command"))
    out = sums
    for part in (
        counted(repeats(reads, [key], "file_path", usage.REREAD_COUNT), key, "file_path", "reread_files", True),
        counted(repeats(commands, [key], "command", usage.REPEATED_COMMANDS), key, "command", "repeated_cmds", True),
        counted(repeats(calls, [key], "name", 1), key, "name", "tool_histogram"),
        attributes,
    ):
        out = out.join(part, key, "left")
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    out = with_costs(out, price).withColumns(
        {
            "denial_ratio": usage.rounded(usage.ratio(F.col("tool_errors"), F.col("tool_calls")), 4),
            **{c: F.coalesce(c, empty) for c in ("reread_files", "repeated_cmds", "tool_histogram")},
            **{c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("reread_files_extra", "repeated_cmds_extra")},
        }
    )
    score = usage.waste_score(F.col("cache_hit_ratio"), F.col("reread_files_extra"), F.col("big_outputs"), F.col("repeated_cmds_extra"), F.col("denial_ratio"), F.col("compactions"))
    return out.withColumn("waste_score", score)


def totals(metrics: DataFrame) -> DataFrame:
    """One row over all sessions; costs are sums of the sessions' rounded ones."""
    sums = metrics.agg(
        F.count("*").alias("sessions"),
        *[F.coalesce(F.sum(c), F.lit(0).cast("bigint")).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")],
        *[F.coalesce(F.sum(c), F.lit(0).cast("decimal(28,4)")).alias(c) for c in ("est_cost_usd", "cache_waste_usd")],
    )
    i, r, w = (F.col(c) for c in ("input_tokens", "cache_read_tokens", "cache_creation_tokens"))
    return sums.select(
        "sessions", "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens",
        usage.rounded(usage.ratio(r, usage.context_tokens(i, r, w)), 4).alias("overall_cache_hit_ratio"),
        F.bround("est_cost_usd", 2).cast("double").alias("est_total_cost_usd"), F.bround("cache_waste_usd", 2).cast("double").alias("reclaimable_cache_usd"),
    )


def worst(metrics: DataFrame, n: int, tie: list[Column] | None = None) -> DataFrame:
    """The sessions of highest waste score; ties by ``tie``, or session id."""
    return metrics.orderBy(F.col("waste_score").desc(), *(tie or [F.col("session_id")])).limit(n)


#: The share of context that a map saves, from and to.
SAVED_LOW, SAVED_HIGH = 0.41, 0.47


def savings(metrics: DataFrame, low: float = SAVED_LOW, high: float = SAVED_HIGH) -> DataFrame:
    """What a map of the tree would save: a band of rates on sessions that read files again, as a share of all context."""
    context = usage.context_tokens(F.col("input_tokens"), F.col("cache_read_tokens"), F.col("cache_creation_tokens"))
    again = F.size("reread_files") > 0
    sums = metrics.agg(
        F.count("*").alias("total_sessions"), F.count_if(again).alias("map_eligible_sessions"), F.coalesce(F.sum(context), F.lit(0)).alias("total_context_tokens"),
        F.coalesce(F.sum(F.when(again, context)), F.lit(0)).alias("eligible_context_tokens"), F.coalesce(F.sum(F.when(again, F.col("est_cost_usd"))), F.lit(0)).cast("double").alias("cost"),
    )
    tokens = lambda rate: F.bround(F.col("eligible_context_tokens") * F.lit(rate), 0).cast("bigint")
    out = sums.withColumns({"map_tokens_low": tokens(low), "map_tokens_high": tokens(high), "map_usd_low": F.bround(F.col("cost") * low, 2), "map_usd_high": F.bround(F.col("cost") * high, 2)})
    share = lambda c: usage.rounded(usage.ratio(F.col(c), F.col("total_context_tokens")), 4)
    return out.withColumns({"pct_low": share("map_tokens_low"), "pct_high": share("map_tokens_high")}).drop("cost")
