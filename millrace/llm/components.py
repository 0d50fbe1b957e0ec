"""Connected components of a table of links, by alternating stars; nothing comes to the driver but two numbers a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import discard, saved


def _large(e: DataFrame, least: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest of its neighbours and itself."""
    return _both(e).where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _both(e: DataFrame) -> DataFrame:
    return e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _small(e: DataFrame, least: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them."""
    joined = e.join(least, "a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node that links reach) of every node of ``links`` (a, b).

    Links may be repeated, run either way or join a node to itself; a link with a null end is none. Each round is written
    to the shared folder. Partial minima go before each shuffle, and as they are saved, the joins on a hot node can be
    split. Rounds go on until nothing changes, which takes as many as the square of the logarithm of the nodes at most.
    """
    e = saved(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        above = saved(_both(e).groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        wide = saved(_large(e, above), "wide")
        down = wide.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        below = saved(down.groupBy("a").agg(F.min("b").alias("m")), "least")
        after = saved(_small(down, below), "stars")
        discard(e, above, wide, below)
        e = after
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            out = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
            out.saved_at = e.saved_at
            return out
        state = now
