"""The symbol map over sources made from the part table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import surface
from millrace.sources.tables import table


def py_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module per brand, with a class per part type's first word and a function per part."""
    parts = table(spark, sf_dir, "part")
    functions = F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("def make_"), F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "_"), F.lit("(size, price=1.0, *, rush=False):\n    return size\n")))), "\n")
    sources = parts.groupBy("p_brand").agg(functions.alias("body"))
    text = F.concat(F.lit('"""Parts of '), F.col("p_brand"), F.lit('."""\n\nclass Part:\n    size: int\n    price: float = 1.0\n\n'), F.col("body"))
    found = sources.select(F.col("p_brand").alias("module"), surface.python_symbols(text).alias("s"))
    return found.select("module", F.col("s.summary").alias("summary"), F.size("s.symbols").alias("n_symbols"), F.array_join("s.symbols", ", ").alias("symbols"))


SQL = """WITH n AS (SELECT p_brand, 'make_' || regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g') AS name FROM part GROUP BY ALL)
SELECT p_brand AS module, 'Parts of ' || p_brand AS summary, (count(*) + 1)::INTEGER AS n_symbols, '`Part(size, price=...)`, ' || string_agg('`' || name || '(size, price=..., rush=...)`', ', ' ORDER BY name || '(') AS symbols FROM n GROUP BY p_brand"""
