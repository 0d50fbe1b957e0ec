"""Usage of sessions as their logs grow, and of time windows, with Structured Streaming.

Sums are kept as state per session or window, never turns; a window's state goes once the watermark has passed it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import sessions
from millrace.sources import transcripts


def events(spark: SparkSession, root: str, files_per_trigger: int = 1000) -> DataFrame:
    """path, session_id and event of every new line under ``root``; a file is read once, when it comes."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.jsonl").text(f"{root.rstrip('/')}/*")
    return transcripts.parsed(lines.select("value", transcripts.decoded_path().alias("path"), F.lit(0).alias("block"), F.lit(0).alias("line")))


def session_usage(found: DataFrame) -> DataFrame:
    """Token sums of each session so far, for update mode."""
    return sessions.token_sums(transcripts.turns(found), [*transcripts.keys_of(found)])


def windowed_usage(found: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Token sums of each window of event time; lines that come later than ``late`` are left out."""
    rows = transcripts.turns(found).withColumn("time", F.try_to_timestamp("ts")).where("time is not null").withWatermark("time", late)
    names = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")
    sums = rows.groupBy(F.window("time", window)).agg(F.count("*").alias("turns"), *[F.sum(n).alias(n) for n in names])
    return sums.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "turns", *names)
