"""Operator 5, substring dedup with a compressed FM-index per shard.

A window of ``WINDOW`` words has an anchor: the least hash of the ``ANCHOR``-word runs in it. Equal windows have equal
anchors, so anchors deal the work: consecutive windows with the same anchor occurrence are one segment, and a segment
goes to the shard of its anchor. Anchors of one document only can't repeat and go nowhere.

In a shard the distinct segments are indexed (Burrows-Wheeler transform and wavelet matrix) with the least document that
each comes from. Then they are streamed through it, each distinct one once: backward search keeps, word by word, the
interval of what matches the next ``WINDOW`` words, and the least document that the interval leads to tells whether a
smaller one has the same words. What a segment's windows give is joined back to all its occurrences, a join that can be
split on a hot segment; runs of windows that a smaller document has are the intervals reported.

An anchor of over ``HOT`` occurrences (a line that very many documents have among other words) would make a shard of its
own size, so its windows are segments of their own, dealt by their own hash.

Words are told apart by the 64 bits of their hash, each word of a window by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import Words, discard, documents, kept_as, kinds_of, mixed, narrow, saved, steps, text_bytes, words_of
from millrace.llm.fm_index import Index

WINDOW, ANCHOR = 13, 5
#: Occurrences from which an anchor's windows are dealt one by one, and words that a shard's index holds, about.
HOT, SHARD_WORDS = 100_000, 1 << 18
#: Segments whose words a task remembers to have sent.
SENT = 1 << 18


class Sent:
    """The least document with which a segment's words were sent, for as many segments as there are slots; one that falls out is sent again."""

    def __init__(self, slots: int = SENT):
        self.slots, self.seg, self.least = slots, np.zeros(slots, np.uint64), np.full(slots, np.iinfo(np.int64).max)

    def fresh(self, seg: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which of these segments (each once) aren't known with an id as small; they are from now on."""
        at = (seg % np.uint64(self.slots)).astype(np.int64)
        out = (self.seg[at] != seg) | (self.least[at] > ids)
        self.seg[at[out]], self.least[at[out]] = seg[out], ids[out]
        return out


def least_at(v: np.ndarray, width: int) -> np.ndarray:
    """Where the first least of each ``width`` consecutive values stands."""
    at, held, span = np.arange(len(v)), v, 1
    while span < width:
        step = min(span, width - span)
        lower = held[step:] < held[: len(held) - step]
        at = np.where(lower, at[step:], at[: len(at) - step])
        held = np.where(lower, held[step:], held[: len(held) - step])
        span += step
    return at


def anchors(words: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window within a text: its first word, the word where its anchor starts, and its anchor."""
    grams = words.grams(anchor)
    inside = np.flatnonzero(words.runs(window))
    if not len(inside):
        return inside, inside, grams[:0]
    # the hashes that stand after the last whole run aren't of any window
    at = least_at(grams, window - anchor + 1)[inside]
    return inside, at, grams[at]


def _anchored(rows: DataFrame, window: int, anchor: int, places: bool) -> DataFrame:
    """anchor and id of each anchor occurrence in a text; with ``places`` also the row's hash and the word it starts at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            words = words_of(batch.column("text"))
            _, at, held = anchors(words, window, anchor)
            at, first = np.unique(at, return_index=True)
            of = words.text_of()[at]
            columns = [pa.array(held[first].view(np.int64)), batch.column("id").take(pa.array(of))]
            if places:
                columns += [batch.column("row").take(pa.array(of)), pa.array((at - words.first[of]).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "id", "row", "at"][: len(columns)])

    return rows.mapInArrow(run, "anchor long, id long" + ", row long, at int" * places)


def _gathered(code: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
    return code[at]


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column and each row's number of them."""
    return pc.list_flatten(column).to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)


_SEGMENTS = "shard long, seg long, id long, row long, start int, words binary"


def _segments(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    """rows: id, row, text, ats, hots (where shared anchors stand, and whether each is hot). A row per segment.

    shard, seg (a hash of its words), id, row, start (first word), and its words' codes: once for equal segments of a
    task, as far as it remembers them, where the id is the least so far, and null for the others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = Sent()
        for batch in steps(batches):
            words = words_of(batch.column("text"))
            first, at, held = anchors(words, window, anchor)
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            state = np.zeros(len(words.hash), np.int8)  # by word: 1 where a shared anchor starts, 2 where a hot one does
            ats, many = _flat(batch.column("ats"))
            hots, _ = _flat(batch.column("hots"))
            state[np.repeat(words.first[:-1], many) + ats] = 1 + hots.astype(np.int8)
            kind = state[at]
            # segments: runs of windows with one anchor place; single windows of a hot one
            use = np.flatnonzero(kind)
            if not len(use):
                continue
            opens = np.concatenate([[True], at[use[1:]] != at[use[:-1]]]) | (kind[use] == 2)
            start, stop = first[use[opens]], first[use[np.concatenate([opens[1:], [True]])]] + window
            hot = kind[use[opens]] == 2
            whole = words.grams(window)
            shard = np.where(hot, whole[start], held[use[opens]])
            # the windows' hashes, one after the other, make the segment's; the first and last window and the length would do as well
            running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(whole))])
            seg = mixed((running[stop - window + 1] - running[start]) ^ (whole[start] + shard))
            of = words.text_of()[start]
            order = np.lexsort((ids[of], seg))
            least = order[np.concatenate([[True], seg[order[1:]] != seg[order[:-1]]])]
            lead = np.zeros(len(start), bool)
            lead[least[sent.fresh(seg[least], ids[of[least]])]] = True
            code = np.maximum(words.hash, np.uint64(1))  # 0 ends a segment in the index
            size = np.where(lead, stop - start, 0)
            offsets = np.concatenate([[0], np.cumsum(8 * size)]).astype(np.int32)
            valid = pa.py_buffer(np.packbits(lead, bitorder="little").tobytes())
            codes = pa.Array.from_buffers(pa.binary(), len(start), [valid, pa.py_buffer(offsets.tobytes()), pa.py_buffer(_gathered(code, start, size).tobytes())])
            rows_ = batch.column("row").take(pa.array(of))
            yield pa.RecordBatch.from_arrays([pa.array(shard.view(np.int64)), pa.array(seg.view(np.int64)), pa.array(ids[of]), rows_, pa.array((start - words.first[of]).astype(np.int32)), codes], ["shard", "seg", "id", "row", "start", "words"])

    return rows.mapInArrow(run, _SEGMENTS)


def stream(codes: np.ndarray, sizes: np.ndarray, ids: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Index segments (their words one after the other) and stream them through: each one's number of windows, and each window's least id."""
    n = len(sizes)
    text = np.zeros(int(sizes.sum()) + n, np.uint64)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    text[np.arange(len(codes)) + np.repeat(np.arange(n), sizes)] = codes
    index = Index(text, window)
    low, high = index.matching(index.codes(text), starts, starts + sizes)
    return sizes - window + 1, index.least(np.repeat(ids, sizes + 1), low, high)


def _searched(contents: DataFrame, window: int) -> DataFrame:
    """contents: shard, seg, id, words; shard, seg and the least id of each of its windows."""

    def flush(keys: np.ndarray, segs: np.ndarray, ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
        # equal segments of other tasks come together here; the least id stands for all
        order = np.lexsort((ids, segs, keys))
        k, s = keys[order], segs[order]
        keep = order[np.concatenate([[True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])])]
        starts = np.cumsum(sizes) - sizes
        count, least = stream(_gathered(codes, starts[keep], sizes[keep]), sizes[keep], ids[keep], window)
        offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(keys[keep]), pa.array(segs[keep]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(least))], ["shard", "seg", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        total = 0
        for batch in batches:
            column = batch.column("words")
            offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
            codes = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.uint64)
            held.append([*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "seg", "id")), np.diff(offsets) // 8, codes])
            total += len(codes)
            if total > SHARD_WORDS:
                keys, segs, ids, sizes, codes = (np.concatenate(x) for x in zip(*held))
                ends = np.flatnonzero(keys[1:] != keys[:-1]) + 1  # a shard is whole once the next one has begun
                filled = np.cumsum(sizes)
                a = 0
                while len(ends):
                    done = filled[a - 1] if a else 0
                    after = ends[(ends > a) & (filled[ends - 1] - done >= SHARD_WORDS)]
                    if not len(after):
                        break
                    b = int(after[0])
                    yield flush(keys[a:b], segs[a:b], ids[a:b], sizes[a:b], codes[done : filled[b - 1]])
                    a = b
                done = filled[a - 1] if a else 0
                held, total = [[keys[a:], segs[a:], ids[a:], sizes[a:], codes[done:]]], len(codes) - int(done)
        if total:
            yield flush(*(np.concatenate(x) for x in zip(*held)))

    return contents.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "shard long, seg long, least array<long>")


def _spans(found: DataFrame, window: int) -> DataFrame:
    """found: id, row, start, least (of each window from start on); id, row, start and stop of each run of words that a smaller id has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least, count = _flat(batch.column("least"))
            ids, starts = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "start"))
            of = np.repeat(np.arange(len(ids)), count)
            place = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + starts[of]
            hit = np.flatnonzero(least < ids[of])
            if not len(hit):
                continue
            of, place = of[hit], place[hit]
            new = np.concatenate([[True], (of[1:] != of[:-1]) | (place[1:] != place[:-1] + 1)])
            last = np.concatenate([new[1:], [True]])
            rows = batch.column("row").take(pa.array(of[new]))
            yield pa.RecordBatch.from_arrays([pa.array(ids[of[new]]), rows, pa.array(place[new].astype(np.int32)), pa.array((place[last] + window).astype(np.int32))], ["id", "row", "start", "stop"])

    return found.mapInArrow(run, "id long, row long, start int, stop int")


def repeated(rows: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """rows: id, row, text; a row per text with repeats: id, row and ``spans``, (start, stop) runs of words that smaller ids have."""
    spark = rows.sparkSession
    there = rows.where("id is not null and text is not null")
    seen = _anchored(there.select("id", "text"), window, anchor, False)
    shared = saved(seen.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n")).where("low <> high").select("anchor", (F.col("n") > HOT).alias("hot")), "anchors")
    places = _anchored(there, window, anchor, True).join(shared.hint("shuffle_hash"), "anchor")
    places = saved(places.groupBy("id", "row").agg(F.collect_list(F.struct("at", "hot")).alias("p")).select("id", "row", F.col("p.at").alias("ats"), F.col("p.hot").alias("hots")), "places")
    discard(shared)
    segments = saved(_segments(there.join(places.hint("merge"), ["id", "row"]), window, anchor), "segments")
    discard(places)
    least = saved(_searched(segments.where("words is not null").select("shard", "seg", "id", "words"), window), "least")
    found = segments.select("shard", "seg", "id", "row", "start").join(least.hint("merge"), ["shard", "seg"])
    spans = saved(_spans(found.select("id", "row", "start", "least"), window), "spans")
    discard(segments)
    discard(least)
    return spans.groupBy("id", "row").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR, keep: tuple[str, ...] = ()) -> DataFrame:
    """``key``, kept (the words that are left, joined by a space), n_words, n_removed, spans and the ``keep`` columns of every row.

    A word goes if a window of ``window`` words that covers it also starts in a row with a smaller key; all windows are
    judged on the input. Rows with the same key are one document: they take nothing from each other. A null text has no
    words and a null key neither removes nor loses any. Texts of under ``window`` words stay. An empty table gives an
    empty one; only the two named columns are read.
    """
    rows = narrow(df, id=key, text=text, **kept_as(keep)).withColumn("id", F.col("id").cast("long")).withColumn("row", F.xxhash64("text"))
    spans = repeated(rows.select("id", "row", "text"), window, anchor)
    joined = rows.join(spans.hint("merge"), ["id", "row"], "left").select("id", "text", "spans", *kept_as(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            data, offsets = text_bytes(batch.column("text"))
            words = Words(data, offsets)
            column = batch.column("spans")
            inner = pc.list_flatten(column)
            base = np.repeat(words.first[:-1], _flat(column)[1])
            gone = np.zeros(len(words.hash) + 1, np.int64)
            np.add.at(gone, base + pc.struct_field(inner, "start").to_numpy(zero_copy_only=False), 1)
            np.add.at(gone, base + pc.struct_field(inner, "stop").to_numpy(zero_copy_only=False), -1)
            stay = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
            left = np.diff(np.searchsorted(stay, words.first))
            # the kept words' bytes, and of the space after each of them one byte, but for a text's last
            last = np.zeros(len(stay), bool)
            last[np.cumsum(left)[left > 0] - 1] = True
            out = data.copy()
            out[words.end[stay[~last]]] = 32
            edge = np.zeros(len(data) + 2, np.int8)
            edge[words.start[stay]] += 1
            edge[words.end[stay] + ~last] -= 1
            taken = np.cumsum(edge[:-1], dtype=np.int8)[: len(data)] > 0
            before = np.concatenate([[0], np.cumsum(taken)])[offsets]
            kept = pa.Array.from_buffers(pa.large_utf8(), batch.num_rows, [None, pa.py_buffer(before.astype(np.int64).tobytes()), pa.py_buffer(out[taken].tobytes())])
            n = words.count
            yield pa.RecordBatch.from_arrays([batch.column("id"), kept.cast(pa.string()), pa.array(n.astype(np.int64)), pa.array((n - left).astype(np.int64)), column, *(batch.column(k) for k in kept_as(keep))], ["id", "kept", "n_words", "n_removed", "spans", *kept_as(keep)])

    schema = f"id long, kept string, n_words long, n_removed long, spans array<struct<start:int,stop:int>>{kinds_of(rows, keep)}"
    return joined.mapInArrow(run, schema).toDF(key, "kept", "n_words", "n_removed", "spans", *keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
     starts AS (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 11))) AS i FROM w),
     windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win FROM starts),
     judged AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) < doc_id AS again FROM windows),
     gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM judged WHERE again),
     words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
     kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS kept FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
