"""Findings: their shape, order, merging, and the budget that bounds what is passed on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.usage import severity_rank

SCHEMA = (
    "id string, title string, severity string, category string, evidence string, recommendation string, "
    "impact_usd double, locations array<string>, effort string, autofixable boolean, tags array<string>"
)
SEVERITIES = ("high", "medium", "low", "info")


def coerced(findings: DataFrame) -> DataFrame:
    """With `info` for a severity that isn't known."""
    return findings.withColumn("severity", F.when(F.col("severity").isin(*SEVERITIES), F.col("severity")).otherwise("info"))


def ranked(findings: DataFrame, *then: Column) -> DataFrame:
    """With ``rank`` from 1: severity, then what is given (impact if nothing is), then id. One order, so one task: for lists of findings."""
    order = Window.orderBy(severity_rank(F.col("severity")).desc(), *(then or (F.coalesce("impact_usd", F.lit(0.0)).desc(),)), F.col("id"))
    return findings.withColumn("rank", F.row_number().over(order))


def upserted(base: DataFrame, extra: DataFrame, key: str = "id", pos: str = "pos") -> DataFrame:
    """Rows of ``base`` with those of ``extra`` in their place where they have its key, others after them.

    Of rows with one key the last counts and the place is the first's; a row without a key stands alone. ``pos`` orders
    each side. One grouping by key; the result has ``pos``, its place among all.
    """
    both = base.withColumn("_side", F.lit(0)).unionByName(extra.withColumn("_side", F.lit(1)))
    at = F.struct("_side", pos)
    held = F.struct(*[c for c in base.columns if c not in (key, pos)])
    alone = F.when(F.col(key).isNull(), at)
    out = both.groupBy(key, alone.alias("_alone")).agg(F.max_by(held, at).alias("_row"), F.min(at).alias("_at"))
    return out.select(key, "_row.*", F.col("_at._side").alias("side"), F.col(f"_at.{pos}").alias(pos))


def within_budget(rows: DataFrame, cost: str, order: list[Column], allowance: int, by: list[str] | None = None) -> DataFrame:
    """The first rows whose costs sum to no more than ``allowance``, with ``spent`` up to each. Costs aren't negative.

    Without ``by`` the whole list is one order, so it goes through one task: it is for ranked lists that are short.
    """
    window = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("spent", F.sum(cost).over(window)).where(F.col("spent") <= allowance)


def within_one_budget(lists: list[DataFrame], cost: str, order: list[Column], allowance: int) -> DataFrame:
    """As ``within_budget`` of several ranked lists, with ``list``, the number of each: one goes on from what those before it spent."""
    out, before = None, None
    for n, rows in enumerate(lists):
        window = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        own = rows.withColumn("spent", F.sum(cost).over(window))
        if before is not None:
            own = own.crossJoin(F.broadcast(before)).withColumn("spent", F.col("spent") + F.col("_before")).drop("_before")
        own = own.where(F.col("spent") <= allowance).withColumn("list", F.lit(n))
        out = own if out is None else out.unionByName(own)
        before = out.agg(F.coalesce(F.max("spent"), F.lit(0)).alias("_before"))
    return out


def prefix_sums(rows: DataFrame, cost: str, key: str, buckets: int = 256) -> DataFrame:
    """rows with ``spent``, the sum of ``cost`` up to each in the order of an integer ``key``, without one task for all.

    Keys are cut into even ranges; each range is summed by itself and starts from what those before it cost, which is one
    number a range. Rows without a key have no place in the order and go; keys that bunch up make uneven ranges.
    """
    span = rows.agg(F.min(key).alias("low"), F.max(key).alias("high"))
    dealt = rows.crossJoin(F.broadcast(span)).withColumn("_b", F.floor((F.col(key) - F.col("low")) * buckets / (F.col("high") - F.col("low") + 1))).drop("low", "high")
    before = dealt.groupBy("_b").agg(F.sum(cost).alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = dealt.withColumn("_own", F.sum(cost).over(inner)).join(F.broadcast(before.select("_b", "_before")), "_b")
    return out.withColumn("spent", F.col("_own") + F.col("_before")).drop("_b", "_own", "_before")


def top_per_group(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def latest(rows: DataFrame, time: str, tie: str, n: int, least: int = 3) -> DataFrame:
    """The last ``n`` rows by time, none if fewer than ``least`` have a time. A top-n, so only n rows a task are sorted together."""
    timed = rows.where(F.col(time).isNotNull())
    last = timed.orderBy(F.col(time).desc(), F.col(tie).desc()).limit(n)
    enough = timed.limit(least).agg((F.count("*") >= least).alias("_enough"))
    return last.crossJoin(F.broadcast(enough)).where("_enough").drop("_enough")


def capped(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows with ``truncated``, the number of rows left out."""
    total = rows.agg(F.greatest(F.lit(0).cast("bigint"), F.count("*") - n).alias("truncated"))
    return rows.orderBy(*order).limit(n).crossJoin(F.broadcast(total))
