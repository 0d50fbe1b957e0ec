"""Operator 7, benchmark decontamination by SimHash of item-sized windows.

A window of an item's length holds the item if the weighted Jaccard similarity of their shingle multisets is ``SIMILAR``
or more under one of two weightings: all shingles alike, or each one over the number of different item texts that have it
(1 if none has), so that boilerplate that many items share counts little. Repeated benchmark rows change nothing.

For either weighting each item and each window has a SimHash of ``BITS`` bits, the signs of the sums of its shingles' hash
bits. A shingle that comes n times with weight w adds sqrt(n * w), under which two multisets of similarity J have a cosine
of 2J / (1 + J) at least, so their fingerprints are expected to differ in the angle's share of bits; ``radius_of`` lies
``SURE`` standard deviations beyond that for the least J that is wanted. A multi-index over 64-bit blocks finds every item
within the radius: of two fingerprints that close, one block at least differs by no more than its share of the radius.
What it finds is verified exactly.

A window that shares no shingle with any item of its length can't be similar, so no fingerprint is made of it. The
benchmark is sent to the tasks in slices of about ``SLICE_BYTES`` of text, one pass over the documents each; every slice
is given how often shingles come in the whole benchmark, as packed numbers of those that several items have.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import LETTERS, documents, kept_as, kind_of, kinds_of, mixed, narrow, steps, words_of

SHINGLE, SIMILAR = 5, 0.8
#: Bits of a fingerprint, and standard deviations of the bits that differ which the radius leaves room for.
BITS, SURE = 256, 5.0
#: Benchmark text that is sent to the tasks at once, about.
SLICE_BYTES = 16 << 20
#: Words of windows' running sums, and pairs of windows and items, that are held at once.
SPAN, PAIRS = 1 << 14, 1 << 21

MATCHES = "array<struct<item_id:long,start:int,stop:int,similarity:double>>"


def radius_of(similar: float, bits: int = BITS) -> int:
    """How many bits the fingerprints of two multisets of that similarity may differ by."""
    share = float(np.arccos(2 * similar / (1 + similar)) / np.pi)
    return int(np.ceil(bits * share + SURE * np.sqrt(bits * share * (1 - share))))


def signs(features: np.ndarray) -> np.ndarray:
    """The hash bits of each feature, as a row of ``BITS`` times 1 or -1."""
    lanes = mixed(features[:, None] + np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    bits = np.unpackbits(lanes.view(np.uint8).reshape(-1, BITS // 8), axis=1, bitorder="little")
    return bits.astype(np.float32) * 2 - 1


def packed(sums: np.ndarray) -> np.ndarray:
    """Fingerprints, as rows of 64-bit blocks, of rows of sums. A sum of nothing, rounding aside, is no bit."""
    return np.packbits(sums > 1e-3, axis=1, bitorder="little").view(np.uint64).reshape(len(sums), -1)


def simhash(features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The fingerprint of a multiset. weights: of each of ``features``, the same wherever a feature comes."""
    distinct, first, n = np.unique(features, return_index=True, return_counts=True)
    return packed((np.sqrt(weights[first] * n)[None, :].astype(np.float32) @ signs(distinct)).reshape(1, -1))


class Blocks:
    """A multi-index over the 64-bit blocks of fingerprints: rows of blocks, or single blocks, of which each is cut in halves of 32 bits."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints.reshape(len(prints), -1), radius
        self.single = self.prints.shape[1] == 1
        self.keys = self._keys(self.prints)
        self.share = radius // len(self.keys)

    def _keys(self, prints: np.ndarray) -> list[np.ndarray]:
        if self.single:
            return list(prints.view(np.uint32).reshape(-1, 2).T)
        return list(prints.T)

    def find(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (of ``prints``, of the index) within the radius."""
        prints = prints.reshape(len(prints), -1)
        out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        step = max(1, PAIRS // max(1, len(self.prints)))
        for at in range(0, len(prints), step):
            part = prints[at : at + step]
            hit = np.zeros((len(part), len(self.prints)), bool)
            for mine, own in zip(self._keys(part), self.keys):
                hit |= np.bitwise_count(mine[:, None] ^ own[None, :]) <= self.share
            a, b = np.nonzero(hit)
            keep = np.bitwise_count(part[a] ^ self.prints[b]).sum(1) <= self.radius
            out_a.append(a[keep] + at)
            out_b.append(b[keep])
        return np.concatenate(out_a), np.concatenate(out_b)


class Benchmark:
    """The items of a benchmark by their number of words; equal texts with other ids are items of their own."""

    def __init__(self, items: list[tuple[int, str | None]], size: int = SHINGLE, similar: float = SIMILAR, many: tuple[np.ndarray, np.ndarray] | None = None):
        """``many``: shingles (sorted) and in how many different texts of the whole benchmark each is, where these are a slice of it."""
        words = words_of(pa.array([t for _, t in items], pa.string()), LETTERS)
        self.items: list[tuple[int, Counter]] = []
        #: the items by a digest of their words
        self.distinct: dict[int, Counter] = {}
        by: dict[int, list[tuple[int, np.ndarray]]] = {}
        grams = {g: words.grams(g) for g in range(1, size + 1)}
        for (key, _), a, b in zip(items, words.first.tolist(), words.first[1:].tolist()):
            if b > a:
                g = min(size, b - a)
                own = grams[g][a : b - g + 1]
                by.setdefault(b - a, []).append((len(self.items), own))
                self.items.append((key, Counter(own.tolist())))
                self.distinct[int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)] = self.items[-1][1]
        if many is None:
            seen = Counter(s for held in self.distinct.values() for s in held)
            known = np.array(sorted(s for s, n in seen.items() if n > 1), np.uint64)
            many = known, np.array([seen[s] for s in known.tolist()], np.int64)
        self.known, self.often = many
        radius = radius_of(similar)
        #: by length: shingle size, all shingles sorted, a multi-index for each weighting and the items in it
        self.groups = []
        for length, own in sorted(by.items()):
            alike = np.concatenate([simhash(f, np.ones(len(f))) for _, f in own])
            weighed = np.concatenate([simhash(f, self.weights(f)) for _, f in own])
            self.groups.append((length, min(size, length), np.unique(np.concatenate([f for _, f in own])), (Blocks(alike, radius), Blocks(weighed, radius)), [i for i, _ in own]))
        self.every = {g: np.unique(np.concatenate([s for _, k, s, _, _ in self.groups if k == g])) for g in {k for _, k, _, _, _ in self.groups}}

    def weights(self, features: np.ndarray) -> np.ndarray:
        out = np.ones(len(features))
        if len(self.known):
            at = np.searchsorted(self.known, features).clip(0, len(self.known) - 1)
            there = self.known[at] == features
            out[there] /= self.often[at[there]]
        return out

    def similarity(self, item: int, features: np.ndarray) -> float:
        """The larger one of both weightings' similarities."""
        a, b = self.items[item][1], Counter(features.tolist())
        union = list(a | b)
        low, high = np.array([min(a[s], b[s]) for s in union]), np.array([max(a[s], b[s]) for s in union])
        weight = self.weights(np.array(union, np.uint64))
        return max(float(low.sum() / high.sum()), float((low * weight).sum() / (high * weight).sum()))


def _member(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_, x)
    at[at == len(sorted_)] = 0
    return sorted_[at] == x


def window_prints(features: np.ndarray, weights: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Fingerprints of the runs first to stop of ``features``, each the multiset's own; runs are in order of their start."""
    sums = np.zeros((len(features) + 1, BITS), np.float32)
    np.cumsum(signs(features) * np.sqrt(weights).astype(np.float32)[:, None], axis=0, out=sums[1:])
    out = packed(sums[stop] - sums[first])
    # where a feature comes again within a run, the root of its number counts, which running sums don't give
    order = np.argsort(features, kind="stable")
    before = np.full(len(features), -1)
    same = features[order[1:]] == features[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    latest = np.maximum.accumulate(np.concatenate([[-1], before]))
    for i in np.flatnonzero(latest[stop] >= first):
        a, b = first[i], stop[i]
        if (before[a:b] >= a).any():
            out[i] = simhash(features[a:b], weights[a:b])
    return out


def matches(texts: pa.Array, bench: Benchmark, similar: float = SIMILAR) -> list[list[dict]]:
    """For each text the items that it holds: the best window (words start to stop) of each."""
    words = words_of(texts, LETTERS)
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    hits, grams = {}, {}
    for g, every in bench.every.items():
        grams[g] = words.grams(g)
        hits[g] = np.flatnonzero(words.runs(g) & _member(every, grams[g]))
    of = words.text_of()
    for length, g, own, indexes, members in bench.groups:
        at = hits[g]
        if not len(at):
            continue
        at = at[_member(own, grams[g][at])]
        if not len(at):
            continue
        first, stop = words.first[of[at]], words.first[of[at] + 1]
        # windows that hold the hit: those of full length, or the whole of a shorter text
        low = np.maximum(first, at + g - length)
        high = np.maximum(first, np.minimum(at, stop - length))
        low = np.minimum(low, high)
        order = np.argsort(low, kind="stable")
        low, high = low[order], high[order]
        fresh = np.maximum.accumulate(np.concatenate([[-1], high[:-1]])) + 1  # windows before this are taken already
        low = np.maximum(low, fresh)
        n = np.maximum(0, high - low + 1)
        starts = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        ends = np.minimum(starts + length, words.first[of[starts] + 1])
        a = 0
        while a < len(starts):  # the running sums are made near the hits only, of about SPAN words or a window
            b = int(np.searchsorted(starts, starts[a] + max(SPAN, length), "right"))
            gaps = np.flatnonzero(np.diff(starts[a:b]) > 4 * length)
            b = a + int(gaps[0]) + 1 if len(gaps) else b
            base, s, e = starts[a], starts[a:b], ends[a:b]
            features = np.ascontiguousarray(grams[g][base : e[-1] - g + 1])
            found = set()
            for index, weights in zip(indexes, (np.ones(len(features)), bench.weights(features))):
                x, y = index.find(window_prints(features, weights, s - base, e - g + 1 - base))
                found.update(zip(x.tolist(), y.tolist()))
            for w, i in sorted(found):
                item, c, d = members[i], int(s[w]), int(e[w])
                value = bench.similarity(item, grams[g][c : d - g + 1])
                key = (int(of[c]), item)
                if value >= similar and value > best.get(key, (0, 0, 0))[0]:
                    best[key] = (value, c, d)
            a = b
    for (t, item), (value, b, c) in sorted(best.items()):
        out[t].append({"item_id": bench.items[item][0], "start": b - int(words.first[t]), "stop": c - int(words.first[t]), "similarity": value})
    return out


def _spread(items: DataFrame, size: int) -> DataFrame:
    """gram and n of the shingles that several different texts have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text").to_pylist():
                for digest, held in Benchmark([(0, text)], size).distinct.items():
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(list(held), np.uint64).view(np.int64)), pa.array([digest] * len(held), pa.int64())], ["gram", "digest"])

    grams = items.select("text").mapInArrow(run, "gram long, digest long")
    return grams.groupBy("gram").agg(F.count_distinct("digest").alias("n")).where("n > 1")


def contamination(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", size: int = SHINGLE, similar: float = SIMILAR, keep: tuple[str, ...] = ()) -> DataFrame:
    """``key`` and matches (item_id, start, stop, similarity; words, the best window of each item) of every row of ``df``, then the columns named by ``keep``.

    Words are runs of letters, digits and anything beyond ASCII, A-Z lowered. Null or empty texts match nothing, items
    without words are matched by nothing, an item of under ``size`` words is one shingle, items with equal texts are all
    reported, items with a null id are left out. Keys may be null, repeated rows are judged alike, an empty table gives an
    empty one and an empty benchmark matches nothing. Other columns aren't read. No shuffle of documents.
    """
    rows = narrow(df, key=key, text=text, **kept_as(keep))
    items = narrow(benchmark, item=item, text=item_text).where("item is not null").withColumn("item", F.col("item").cast("long"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    slices = max(1, -(-total // SLICE_BYTES))
    items = items.withColumn("slice", F.pmod(F.xxhash64("item", "text"), F.lit(slices)))
    many = None
    if slices > 1:
        held_often = sorted((r.gram % 2**64, r.n) for r in _spread(items, size).collect())
        many = np.array([x for x, _ in held_often], np.uint64), np.array([n for _, n in held_often], np.int64)
    schema = f"key {kind_of(rows, 'key')}, matches {MATCHES}, text string{kinds_of(rows, keep)}"
    out = rows.select("key", F.lit(None).cast(MATCHES).alias("matches"), "text", *kept_as(keep))
    for k in range(slices):
        held = sorted((r.item, r.text) for r in items.where(F.col("slice") == k).select("item", "text").collect() if r.text)

        def run(batches: Iterator[pa.RecordBatch], held: list = held) -> Iterator[pa.RecordBatch]:
            bench = Benchmark(held, size, similar, many)
            for batch in steps(batches):
                before = batch.column("matches").to_pylist()
                found = matches(batch.column("text"), bench, similar)
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([(b or []) + f for b, f in zip(before, found)], batch.schema.field("matches").type), batch.column("text"), *(batch.column(x) for x in kept_as(keep))], ["key", "matches", "text", *kept_as(keep)])

        out = out.mapInArrow(run, schema)
    return out.select("key", "matches", *kept_as(keep)).toDF(key, "matches", *keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", (F.size("matches") > 0).alias("contaminated"), F.array_sort(F.col("matches.item_id")).alias("item_ids"), F.array_max(F.col("matches.similarity")).alias("similarity"))
