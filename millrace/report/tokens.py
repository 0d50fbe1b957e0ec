"""The token report: totals, the worst sessions, findings and what could be saved, of session metrics.

All of it is made in Spark; what comes to the driver are one-row tables, findings and lists of a stated length.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from millrace.functions import usage
from millrace.operators import findings, rules, sessions
from millrace.sources import transcripts

#: Sessions of the cost trend.
TREND = 40
_MAPS = ("reread_files", "repeated_cmds", "tool_histogram")


def load(spark: SparkSession, root: str, project: str | None = None, limit: int | None = None, since_days: float | None = None, price: usage.Price = usage.Price(), logs: str = transcripts.LOGS) -> DataFrame:
    """Session metrics with size_bytes and mtime, of the logs that the filters keep; a row per log."""
    files, found = transcripts.load(spark, root, project, limit, since_days, logs)
    metrics = sessions.session_metrics(transcripts.turns(found), transcripts.session_attributes(found), price)
    return metrics.join(files.select("path", F.col("size").alias("size_bytes"), "mtime"), "path")


def load_order(metrics: DataFrame) -> list[Column]:
    """Newest first, then by path, where the metrics are of logs."""
    return [F.col("mtime").desc(), F.col("path")] if "mtime" in metrics.columns else [F.col("session_id")]


def _plain(row: Row) -> dict[str, Any]:
    """A row as JSON takes it; maps in the order of their counts, which a collected map has lost."""
    held = row.asDict(recursive=True)
    for name in _MAPS:
        if name in held:
            held[name] = dict(sorted((held[name] or {}).items(), key=lambda x: (-x[1], x[0])))
    return {k: v for k, v in held.items() if k not in ("mtime", "path", "pos")}


def _numbers(metrics: DataFrame) -> DataFrame:
    return metrics.withColumns({c: F.col(c).cast("double") for c in ("est_cost_usd", "cache_waste_usd")})


def every_session(metrics: DataFrame) -> Iterator[dict[str, Any]]:
    """All sessions in load order, a partition of them at a time."""
    return map(_plain, _numbers(metrics).orderBy(*load_order(metrics)).toLocalIterator())


def report(metrics: DataFrame, top: int = 12, price: usage.Price = usage.Price()) -> dict[str, Any]:
    """The token report of session metrics, which are held for the few passes that it takes."""
    held = metrics.persist()
    try:
        order = load_order(held)
        found = rules.token_findings(held, order, price).orderBy(*rules.by_impact())
        total = sessions.totals(held).first().asDict()
        projection = sessions.savings(held).first().asDict() | {"rate_low": sessions.SAVED_LOW, "rate_high": sessions.SAVED_HIGH, "cache_reclaimable_usd": total["reclaimable_cache_usd"]}
        trend = findings.latest(held.select("session_id", "started", F.col("est_cost_usd").cast("double").alias("cost")), "started", "session_id", TREND)
        return {
            "totals": total, "repos": [r.repo for r in held.where("repo <> ''").select("repo").distinct().orderBy("repo").collect()], "findings": [_plain(r) for r in found.collect()],
            "worst_sessions": [_plain(r) for r in sessions.worst(_numbers(held), top, order).collect()], "trend": [r.cost for r in trend.orderBy("started", "session_id").collect()], "projection": projection,
        }
    finally:
        held.unpersist()


def empty_report() -> dict[str, Any]:
    """The report of no sessions."""
    return {"totals": {"sessions": 0}, "repos": [], "findings": [], "worst_sessions": [], "trend": [], "projection": None}
