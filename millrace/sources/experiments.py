"""Experiment runs in JSON lines, one run a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "bench": "task string, config string, rep int, input_tokens bigint, output_tokens bigint, cache_read bigint, cache_creation bigint, total_tokens bigint, cost_usd double, num_turns int, success boolean, answer string, error string",
    "ladder": "tier string, task string, arm string, rep int, ok boolean, tokens bigint, turns int",
    "pareto": "task string, arm string, rep int, ok boolean, tokens bigint, turns int",
    "fanout": "arm string, rep int, tokens bigint, turns int, ok boolean",
}


def runs(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The runs of a file or folder, with ``pos``, their order: by file, where a split starts in it, and line; blank lines are skipped."""
    rows = spark.read.schema(SCHEMAS[kind]).json(path)
    at = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return rows.select(*rows.columns, at.alias("pos"))
