"""Operator 9, main text of web pages by a recurrent block labeller.

A page is read into its leaf blocks; a numpy bidirectional LSTM reads each block's tag-path vector, hashed-word vector
and a few facts, in page order from both ends, and classifies every block with the whole page as context. The weights
come from ``train_blocks`` and are read from beside this module on the driver, then sent with the task.
"""

from __future__ import annotations

import io
import pkgutil
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import lstm
from millrace.llm.common import narrow, steps
from millrace.llm.html_blocks import blocks_of, features


def weights() -> lstm.Weights:
    held = np.load(io.BytesIO(pkgutil.get_data("millrace.llm", "block_labeller.npz")))
    return {k: held[k].astype(np.float32) for k in held.files}


def texts_of(pages: list[str], w: lstm.Weights) -> list[str]:
    """The main text of each page: its article's blocks, joined by a line end."""
    found = [blocks_of(p) for p in pages]
    odds = lstm.scores(w, [features(b) if b else np.zeros((0, 1), np.float32) for b in found])
    return ["\n".join(text for (_, text, _), o in zip(b, s) if o > 0) for b, s in zip(found, odds)]


def extracted(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), w: lstm.Weights | None = None) -> DataFrame:
    """The ``keep`` columns, text and n_chars (code points) of every row, without a shuffle.

    A null or empty page, or one without an article, has an empty text. Kept columns may be null, repeated rows are
    extracted alike, other columns aren't read, an empty table gives an empty one. Pages of any length are read whole.
    """
    w = w or weights()
    rows = narrow(pages, **{f"k{i}": k for i, k in enumerate(keep)}, html=html)
    held = [f"k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "html", 1 << 20):
            texts = pa.array(texts_of(pc.fill_null(batch.column("html"), "").to_pylist(), w), pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in held), texts, pc.utf8_length(texts).cast(pa.int64())], [*held, "text", "n_chars"])

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in held)
    return rows.mapInArrow(run, f"{kinds}{', ' if kinds else ''}text string, n_chars long").toDF(*keep, "text", "n_chars")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
