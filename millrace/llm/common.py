"""Helpers that the training-data operators share: column picking, shared storage and vectorised words.

Words are found and hashed over the raw UTF-8 bytes of an Arrow text column, a bounded block of bytes at a
time, so that memory follows the block and the longest single text, never the partition.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step takes (a longer single text is a step of its own).
STEP_BYTES = 2 << 20
BLOCK = 1 << 20

_ODD = 0x9E3779B97F4A7C15


def narrow(df: DataFrame, **names: str) -> DataFrame:
    """``df`` with just the named columns, as ``new=old``.

    Columns are found by their exact name, first match first, so extra columns that differ only in case,
    repeat a name or carry dots don't clash with the wanted ones.
    """
    held = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return held.select(*[F.col(f"_c{df.columns.index(old)}").alias(new) for new, old in names.items()])


def kept_as(keep: tuple[str, ...]) -> dict[str, str]:
    """Names inside an operator for the columns that it only passes on, for ``narrow``."""
    return {f"kept{i}": name for i, name in enumerate(keep)}


def kind_of(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def kinds_of(df: DataFrame, keep: tuple[str, ...]) -> str:
    """The schema of passed-on columns, to follow others."""
    return "".join(f", {k} {kind_of(df, k)}" for k in kept_as(keep))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, one is set for a session on one machine alone."""
    held = spark.conf.get("spark.checkpoint.dir", None)
    if not held:
        held = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not held:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        held = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", held)
    return held.rstrip("/")


#: While an intermediate table is made: its shuffle files go as soon as it is written, and batches for Python are small.
_MAKING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
#: Where the shared folder is a mounted one: Hadoop's local file system with checksums writes a second file for each and, it
#: seems, starts processes to set modes where its native library is missing. A write of 40 files took some 275 new processes
#: and threads with it, 193 with the raw one. Parquet pages have checksums of their own.
_MOUNTED = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """The session's settings for a while."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"
    with settings(spark, _MAKING):
        df.write.option("compression", "zstd").options(**_MOUNTED).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``saved`` made, once what was made from them is saved itself."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(df.saved_at)
        folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    base, inverse = (_ODD | 1), pow(_ODD | 1, -1, 1 << 64)
    up = np.cumprod(np.full(BLOCK + 1, base, np.uint64))
    down = np.cumprod(np.full(BLOCK + 1, inverse, np.uint64))
    one = np.ones(1, np.uint64)
    table = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return np.concatenate([one, up[:-1]]), np.concatenate([one, down[:-1]]), table


_TABLES: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

_BYTE = np.arange(256, dtype=np.uint8)
#: Byte maps: as it is, with A-Z lowered, and with every ASCII byte but letters and digits made a space as well.
PLAIN = _BYTE.copy()
LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)
_ALNUM = ((_BYTE >= 48) & (_BYTE <= 57)) | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128)
LETTERS = np.where(_ALNUM[LOWER], LOWER, 32).astype(np.uint8)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column (null: empty) and each text's offsets, one more than there are texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most`` bytes of text, never less than a row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(size) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def span_hashes(seen: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are in order and apart, a block of bytes is taken at a time."""
    global _TABLES
    if _TABLES is None:
        _TABLES = _powers()
    up, down, per_byte = _TABLES
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        origin = start[at]
        to = int(np.searchsorted(end, origin + BLOCK, "right"))
        if to == at:  # one span that is longer than a block
            h, n = np.zeros(1, np.uint64), int(end[at] - origin)
            for k in range(0, n, BLOCK):
                part = per_byte[seen[origin + k : min(origin + n, origin + k + BLOCK)]]
                h = mixed(h) + (part * up[: len(part)]).sum(dtype=np.uint64)
            out[at] = h[0] ^ np.uint64(n)
            at += 1
            continue
        block = seen[origin : end[to - 1]]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(per_byte[block] * up[: len(block)], dtype=np.uint64)])
        s, e = start[at:to] - origin, end[at:to] - origin
        out[at:to] = (total[e] - total[s]) * down[s]
        at = to
    return mixed(out)


class Words:
    """The words of some texts: byte spans, a 64-bit hash of each, and ``first``: each text's first word, one more at the end."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray = PLAIN):
        seen = table[data]
        inside = (seen != 32) & ((seen < 9) | (seen > 13))
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.empty(len(data), bool)
        if len(data):
            before[0] = False
            before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.empty(len(data), bool)
        if len(data):
            after[-1] = False
            after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.hash = span_hashes(seen, self.start, self.end)

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def grams(self, n: int) -> np.ndarray:
        """A hash of each run of ``n`` words from every word on (the last n-1 are void, runs may cross texts: see ``runs``)."""
        out = np.zeros(len(self.hash), np.uint64)
        if len(self.hash) >= n:
            m = len(self.hash) - n + 1
            part = np.zeros(m, np.uint64)
            for k in range(n):
                part = part * np.uint64(0xD6E8FEB86659FD93) + self.hash[k : k + m]
            out[:m] = mixed(part)
        return out

    def runs(self, n: int) -> np.ndarray:
        """Whether a run of ``n`` words from each word on lies within one text."""
        last = np.repeat(self.first[1:], self.count)
        return np.arange(len(self.hash)) + n <= last

    def text_of(self) -> np.ndarray:
        """The text that each word is of."""
        return np.repeat(np.arange(len(self.first) - 1), self.count)


def words_of(col: pa.Array, table: np.ndarray = PLAIN) -> Words:
    return Words(*text_bytes(col), table)


def i64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))
