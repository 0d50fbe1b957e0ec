"""Operator 4, license scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies.

For each number of shingles that a template has, a text is cut into overlapping windows of shingles: runs of blocks of a
quarter of that number, so that some window holds any stretch of the template's length and is at most a quarter longer
(a bit more for rounding). A template that a window contains by ``CONTAINED`` has a Jaccard similarity of at least 0.55 to
it; one of ``BANDS`` bands of one MinHash value then collides with probability 1 - (1 - 0.55)**16, over 0.999997. What
collides is verified by the exact share of the template's shingles in the window, and the best window of each overlapping
stretch is reported. Texts without a shingle of any template have no window that could be verified and aren't cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import LETTERS, documents, mixed, narrow, steps, words_of
from millrace.llm.license_templates import TEMPLATES

SHINGLE, CONTAINED, BANDS = 5, 0.8, 16
FOUND = "array<struct<license:string,start:int,stop:int,containment:double>>"

_SEEDS = mixed(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


class Templates:
    """Templates by shingle size and number of shingles, with their MinHash values; those without words are left out."""

    def __init__(self, templates: list[tuple[str, str]], size: int = SHINGLE):
        words = words_of(pa.array([t for _, t in templates], pa.string()), LETTERS)
        self.names, self.sets, by = [], [], {}
        for (name, _), a, b in zip(templates, words.first.tolist(), words.first[1:].tolist()):
            if a == b:
                continue
            g = min(size, b - a)
            own = np.unique(words.grams(g)[a : b - g + 1])
            by.setdefault((g, b - a - g + 1), []).append(len(self.names))
            self.names.append(name)
            self.sets.append(own)
        #: by shingle size: the shingles of all templates
        self.every = {g: np.unique(np.concatenate([self.sets[m] for (h, _), own in by.items() if h == g for m in own])) for g, _ in by}
        #: (shingle size, shingles, shingles of a block, blocks of a window, templates, their MinHash values by band, flags of these by 16 bits)
        self.classes = []
        for (g, n), members in sorted(by.items()):
            block = max(1, n // 4)
            least = np.array([[mixed(self.sets[m] ^ s).min() for m in members] for s in _SEEDS])
            flags = np.zeros((BANDS, 1 << 16), bool)
            for k in range(BANDS):
                flags[k, (least[k] & np.uint64(0xFFFF)).astype(np.int64)] = True
            self.classes.append((g, n, block, -(-(n + block - 1) // block), members, least, flags))


def touched(texts: pa.Array, templates: Templates) -> np.ndarray:
    """The texts that hold a shingle of some template; the others contain none of any, whatever their windows' values."""
    words = words_of(texts, LETTERS)
    of, out = words.text_of(), np.zeros(len(texts), bool)
    for g, every in templates.every.items():
        grams = words.grams(g)
        at = np.searchsorted(every, grams).clip(0, len(every) - 1)
        out[of[(every[at] == grams) & words.runs(g)]] = True
    return np.flatnonzero(out)


def scan(texts: pa.Array, templates: Templates, contained: float = CONTAINED) -> list[list[dict]]:
    """For each text the verified stretches (words, start to stop) of templates, best first for each stretch, in order of place."""
    some = touched(texts, templates)
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    for i, found in zip(some.tolist(), _scan(texts.take(pa.array(some)), templates, contained)):
        out[i] = found
    return out


def _scan(texts: pa.Array, templates: Templates, contained: float) -> list[list[dict]]:
    words = words_of(texts, LETTERS)
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    for g in sorted({c[0] for c in templates.classes}):
        runs, grams = words.runs(g), words.grams(g)
        at = np.flatnonzero(runs)
        if not len(at):
            continue
        grams = grams[at]
        first = np.searchsorted(at, words.first)
        hashed = [mixed(grams ^ s) for s in _SEEDS]
        for _, n, block, blocks, members, least, flags in (c for c in templates.classes if c[0] == g):
            # block starts: each text is cut on its own, so no block crosses texts
            many = -(-np.diff(first) // block)
            of = np.repeat(np.arange(len(many)), many)
            start = first[of] + block * (np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many))
            stop = first[of + 1]
            hit: set[tuple[int, int]] = set()
            for k in range(BANDS):
                low = np.minimum.reduceat(hashed[k], start) if block > 1 else hashed[k][start]
                window = low.copy()
                for step in range(1, blocks):  # a window ends with its text
                    same = of[step:] == of[:-step] if step < len(of) else np.zeros(0, bool)
                    window[: len(same)] = np.where(same, np.minimum(window[: len(same)], low[step:]), window[: len(same)])
                for w in np.flatnonzero(flags[k][(window & np.uint64(0xFFFF)).astype(np.int64)]):
                    for j in np.flatnonzero(least[k] == window[w]):
                        hit.add((int(w), int(j)))
            best: dict[tuple[int, int], list[tuple[float, int, int]]] = {}
            for w, j in sorted(hit):
                template = templates.sets[members[j]]
                a, b = int(start[w]), min(int(start[w]) + block * blocks, int(stop[w]))
                inside = np.isin(grams[a:b], template)
                share = len(np.unique(grams[a:b][inside])) / len(template)
                if share >= contained:
                    where = np.flatnonzero(inside)
                    best.setdefault((int(of[w]), members[j]), []).append((share, int(at[a + where[0]]), int(at[a + where[-1]]) + g))
            for (t, m), found in best.items():
                taken: list[tuple[int, int]] = []
                for share, a, b in sorted(found, key=lambda x: (-x[0], x[1])):
                    if all(b <= x or a >= y for x, y in taken):
                        taken.append((a, b))
                        base = int(words.first[t])
                        out[t].append({"license": templates.names[m], "start": a - base, "stop": b - base, "containment": share})
    return [sorted(x, key=lambda f: (f["start"], f["stop"], f["license"])) for x in out]


def license_matches(df: DataFrame, key: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] | None = None, size: int = SHINGLE, contained: float = CONTAINED) -> DataFrame:
    """``key`` and found (license, start, stop, containment) of every row of ``df``; no shuffle.

    Words are runs of letters, digits and anything beyond ASCII, A-Z lowered. A null or empty text holds nothing. A
    template of under ``size`` words is one shingle of all its words; several templates may have one license's name. Keys
    may be null, repeated rows are scanned alike, an empty table gives an empty one, other columns aren't read. The
    templates are a parameter of the call and go to the tasks with the code: theirs is the size that bounds it.
    """
    rows = narrow(df, key=key, text=text)
    held = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(held, size)
        for batch in steps(batches):
            found = pa.array(scan(batch.column("text"), known, contained), pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("containment", pa.float64())])))
            yield pa.RecordBatch.from_arrays([batch.column("key"), found], ["key", "found"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, found {FOUND}").withColumnRenamed("key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_matches(documents(spark, sf_dir))
    return found.select("doc_id", F.array_sort(F.array_distinct("found.license")).alias("licenses"), F.size("found").alias("n_matches"), F.array_max("found.containment").alias("containment"))
