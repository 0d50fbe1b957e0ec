"""Operator 1, token counts: pieces are counted once per distinct pre-token, joined to each text's pre-token
frequencies and summed; no ids are made.

A pre-token is a run of spaces with the characters up to the next space or line end, or a line end. The subword
vocabulary has no piece in which a space follows another character and none with a line end, which is tested when the
model is loaded, so that no merge crosses the edge of a pre-token and the sum is the library's own count.

1. A pass over the texts gives the distinct pre-tokens by a 64-bit hash, with how often they come. They are summed over
   all texts, and the pieces of each are counted once, by the one task that it is dealt to; that makes the table.
2. A pass over the texts gives each one's pre-token frequencies. The ``FREQUENT`` commonest entries of the table are with
   each task and joined there; a text's other pre-tokens, which are rare ones, are joined to the table by a shuffle.
   As none of them is common, no key of that join is hot.
3. Both parts are summed by text.

Two pre-tokens with one hash would be told apart when the table is made; texts that hold one are counted by themselves.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import discard, documents, kind_of, narrow, saved, span_hashes, steps, text_bytes

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: Distinct pre-tokens that a task holds at once, and the longest that it holds.
MEMO, LONGEST = 200_000, 64
#: Distinct pre-tokens that a task gathers for the table before it sends them, and entries of the table that go with each task, at most.
GATHERED, FREQUENT = 1 << 20, 1 << 20

_PRE_TOKEN = re.compile("▁+[^▁\n]*|[^▁\n]+|\n+")


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceCounter:
    """Counts the pieces of texts for a sentencepiece model of the BPE kind without normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        bare = [p for p in (self.model.id_to_piece(i) for i in range(self.model.get_piece_size())) if not self._whole(p)]
        if bare:
            raise ValueError(f"a piece of {path} crosses pre-tokens: {bare[0]!r}")
        self.line_end = len(self.model.encode("\n")) - 1
        self.known: dict[str, int] = {}

    @staticmethod
    def _whole(piece: str) -> bool:
        return "▁" not in piece.lstrip("▁") and "\n" not in piece

    def pieces(self, tokens: list[str]) -> list[int]:
        """How many pieces each pre-token has. The library adds a space before a text; a pre-token that begins with a space gives that one up, any other one follows a line end."""
        spaced = [t[0] == "▁" for t in tokens]
        ids = self.model.encode([t[1:] if s else f"\n{t}" for t, s in zip(tokens, spaced)], num_threads=1)
        lone = self.line_end + 1
        # the library makes nothing of an empty text, not even the space before it
        return [(len(x) if t != "▁" else 1) if s else len(x) - lone for t, x, s in zip(tokens, ids, spaced)]

    def count(self, texts: list[str]) -> list[int]:
        freqs = []
        for text in texts:
            freqs.append(Counter(_PRE_TOKEN.findall("▁" + text.replace(" ", "▁"))) if text else Counter())
        fresh = {t for f in freqs for t in f if t not in self.known and t[0] != "\n"}
        table = self.known
        if fresh:
            fresh = sorted(fresh)
            new = dict(zip(fresh, self.pieces(fresh)))
            if len(self.known) + len(new) > MEMO:
                table = self.known | new if len(self.known) else new
                self.known = {k: v for k, v in new.items() if len(k) <= LONGEST} if len(new) <= MEMO else {}
            else:
                long = {k: v for k, v in new.items() if len(k) > LONGEST}
                self.known.update((k, v) for k, v in new.items() if len(k) <= LONGEST)
                table = self.known | long if long else self.known
        return [sum(n * (table[t] if t[0] != "\n" else len(t) * self.line_end) for t, n in f.items()) for f in freqs]


class PreTokens:
    """The pre-tokens of some texts but for line ends: byte spans, a hash of each and ``first``, each text's first one; and each text's line ends.

    A text that isn't empty is read with a space before it, as the library does; its own sign for a space is a space.
    """

    def __init__(self, texts: pa.Array):
        data, offsets = text_bytes(pc.replace_substring(texts, "▁", " "))
        size = np.diff(offsets)
        some = (size > 0).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(size + some)])
        self.data = np.full(int(at[-1]), 32, np.uint8)
        self.data[np.arange(len(data)) + np.repeat(at[:-1] + some - offsets[:-1], size)] = data
        space, line = self.data == 32, self.data == 10
        opens = np.zeros(len(self.data), bool)
        opens[at[:-1][some > 0]] = True
        before = np.concatenate([[False], line[:-1]])
        opens[1:] |= (space[1:] & ~space[:-1]) | (before[1:] & ~line[1:])
        begin = opens & ~line
        self.start = np.flatnonzero(begin)
        close = np.append(np.flatnonzero(opens | (line & ~before)), len(self.data))
        self.end = close[np.searchsorted(close, self.start, "right")]
        self.first = np.searchsorted(self.start, at)
        self.hash = span_hashes(self.data, self.start, self.end)
        lines = np.concatenate([[0], np.cumsum(line)])
        self.lines = lines[at[1:]] - lines[at[:-1]]

    def texts(self, which: np.ndarray) -> pa.Array:
        """Some of the pre-tokens, as bytes."""
        size = self.end[which] - self.start[which]
        offsets = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.start[which] - offsets[:-1], size) + np.arange(int(offsets[-1]))
        return pa.Array.from_buffers(pa.large_binary(), len(which), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(self.data[at].tobytes())]).cast(pa.binary())


def _distinct(rows: DataFrame) -> DataFrame:
    """h, n and token of the pre-tokens of a task, each as often as the task has to begin anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []

        def merged() -> tuple[np.ndarray, np.ndarray, pa.Array]:
            h, n = np.concatenate([x for x, _, _ in held]), np.concatenate([x for _, x, _ in held])
            token = pa.concat_arrays([x for _, _, x in held])
            order = np.argsort(h, kind="stable")
            new = np.concatenate([[True], h[order[1:]] != h[order[:-1]]])
            # pre-tokens that share a hash both stay
            again = np.flatnonzero(~new)
            apart = ~pc.equal(token.take(pa.array(order[again])), token.take(pa.array(order[again - 1]))).to_numpy(zero_copy_only=False)
            new[again[apart]] = True
            at = np.flatnonzero(new)
            return h[order[at]], np.add.reduceat(n[order], at), token.take(pa.array(order[at]))

        def batch_of(h: np.ndarray, n: np.ndarray, token: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n), token], ["h", "n", "token"])

        for batch in steps(batches):
            found = PreTokens(pc.fill_null(batch.column("text"), ""))
            if not len(found.hash):
                continue
            h, first, n = np.unique(found.hash, return_index=True, return_counts=True)
            held.append((h, n, found.texts(first)))
            if sum(len(x) for x, _, _ in held) > GATHERED:
                held = [merged()]
                if len(held[0][0]) > GATHERED // 2:
                    yield batch_of(*held.pop())
        if held:
            yield batch_of(*merged())

    return rows.mapInArrow(run, "h long, n long, token binary")


def piece_table(rows: DataFrame, path: Callable[[str], str], model: str) -> DataFrame:
    """h, n (how often it comes), pieces and ``shared`` (whether several pre-tokens have the hash) of every distinct pre-token. rows: text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(path(model))
        left = None  # the last hash of a batch may go on in the next one

        def counted(table: pa.Table) -> pa.RecordBatch:
            h, n = (table.column(c).to_numpy() for c in ("h", "n"))
            token = table.column("token").combine_chunks()
            at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            lead = np.repeat(at, np.diff(np.append(at, len(h))))
            differs = ~pc.equal(token, token.take(pa.array(lead))).to_numpy(zero_copy_only=False)
            shared = np.logical_or.reduceat(differs, at)
            # bytes of whole pre-tokens are whole characters
            pieces = counter.pieces(["▁" * (len(t) - len(t.lstrip(" "))) + t.lstrip(" ") for t in token.take(pa.array(at)).cast(pa.string()).to_pylist()])
            return pa.RecordBatch.from_arrays([pa.array(h[at]), pa.array(np.add.reduceat(n, at)), pa.array(pieces, pa.int32()), pa.array(shared)], ["h", "n", "pieces", "shared"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([left, table]) if left is not None else table
            h = table.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1]))
            if cut:
                yield counted(table.slice(0, cut))
            left = table.slice(cut)
        if left is not None:
            yield counted(left)

    return _distinct(rows.select("text")).repartition("h").sortWithinPartitions("h").mapInArrow(run, "h long, n long, pieces int, shared boolean")


def _packed(table: DataFrame, columns: tuple[str, str]) -> tuple[np.ndarray, np.ndarray]:
    """Two columns of a bounded table, sorted by the first, by way of packed batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in columns)
            yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.int64).tobytes()]), pa.array([y.astype(np.int32).tobytes()])], ["x", "y"])

    got = [(np.frombuffer(r.x, np.int64), np.frombuffer(r.y, np.int32)) for r in table.select(*columns).mapInArrow(run, "x binary, y binary").collect()]
    x, y = np.concatenate([np.zeros(0, np.int64), *(a for a, _ in got)]), np.concatenate([np.zeros(0, np.int32), *(b for _, b in got)])
    order = np.argsort(x, kind="stable")
    return x[order], y[order]


def frequent(table: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and pieces of the commonest entries, ``most`` at most: those over the least frequency that leaves so few."""
    grade = F.floor(F.log2("n") * 16).cast("int")
    grades = sorted(((r.g, r.k) for r in table.groupBy(grade.alias("g")).agg(F.count("*").alias("k")).collect()), reverse=True)
    least, total = (grades[0][0] + 1 if grades else 0), 0
    for g, k in grades:
        if total + k > most:
            break
        least, total = g, total + k
    return _packed(table.where(grade >= least), ("h", "pieces"))


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", path: Callable[[str], str] = model_path, model: str = MODEL, most: int | None = None) -> DataFrame:
    """``key``, n_bytes and n_tokens of every row of ``df``. ``most``: the entries that go with each task.

    A null text counts as empty: 0 bytes and 0 tokens. A null key stays null, repeated rows stay repeated, an empty
    table gives an empty one. Only the two named columns are read, so others can't clash. Texts of any length are
    counted whole. ``path(model)`` is evaluated on the executors.
    """
    rows = narrow(df, key=key, text=text)
    table = saved(piece_table(rows, path, model), "pieces")
    known, pieces = frequent(table, FREQUENT if most is None else most)
    twice, _ = _packed(table.where("shared"), ("h", "pieces"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(path(model))
        row = TaskContext.get().partitionId() << 40
        for batch in steps(batches):
            texts = pc.fill_null(batch.column("text"), "")
            found = PreTokens(texts)
            h, count = found.hash.view(np.int64), np.diff(found.first)
            of = np.repeat(np.arange(len(texts)), count)
            at = np.searchsorted(known, h).clip(0, max(0, len(known) - 1))
            here = known[at] == h if len(known) else np.zeros(len(h), bool)
            sums = np.bincount(of[here], pieces[at[here]] if len(known) else None, len(texts)).astype(np.int64) + found.lines * counter.line_end
            rare, many = np.flatnonzero(~here), np.zeros(0, np.int64)
            order = rare[np.lexsort((h[rare], of[rare]))]
            new = np.concatenate([[True], (of[order[1:]] != of[order[:-1]]) | (h[order[1:]] != h[order[:-1]])])[: len(order)]
            lead = order[new]
            many = np.diff(np.append(np.flatnonzero(new), len(order)))
            if len(twice):  # texts with a hash that several pre-tokens share are counted by themselves
                alone = np.unique(of[np.isin(h, twice)])
                sums[alone] = counter.count(texts.take(pa.array(alone)).to_pylist())
                stay = ~np.isin(of[lead], alone)
                lead, many = lead[stay], many[stay]
            ends = np.concatenate([[0], np.cumsum(np.bincount(of[lead], minlength=len(texts)))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (h[lead], many.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(len(texts))), batch.column("key"), pc.binary_length(texts).cast(pa.int64()), pa.array(sums), *lists], ["row", "key", "n_bytes", "sums", "h", "times"])
            row += len(texts)

    parts = saved(rows.mapInArrow(run, f"row long, key {kind_of(rows, 'key')}, n_bytes long, sums long, h array<long>, times array<int>"), "texts")
    rest = parts.where(F.size("h") > 0).select("row", F.inline(F.arrays_zip("h", "times"))).join(table.select("h", "pieces"), "h")
    # saved before it is summed, so that what the join shuffled is gone by then
    rest = saved(rest.select("row", (F.col("pieces") * F.col("times")).alias("more")), "rest")
    discard(table)
    more = rest.groupBy("row").agg(F.sum("more").alias("more"))
    out = parts.select("row", "key", "n_bytes", "sums").join(more, "row", "left")
    return out.select(F.col("key").alias(key), "n_bytes", (F.col("sums") + F.coalesce("more", F.lit(0))).alias("n_tokens"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(documents(spark, sf_dir))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)
