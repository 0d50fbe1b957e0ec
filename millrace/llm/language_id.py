"""Operator 6, language identification by hierarchical discrimination.

A one-versus-rest linear support vector machine first names the language family; within it one-versus-one linear machines
separate the languages, and the language with the largest summed pairwise probability wins (ties: the first by name).
All machines read the same vector: hashed byte 2-, 3- and 4-grams of the lower-cased whole text, in which everything in
ASCII but letters counts as space, by square root and unit length.

Learning takes a sample bounded by ``PER_LANGUAGE`` rows a language and ``SAMPLE`` rows in all (about; by a hash of key and
text), whose vectors, not texts, come to the driver. Everything else is one narrow pass over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import documents, kept_as, kind_of, kinds_of, narrow, steps, text_bytes

UNKNOWN = "und"
DIM_BITS = 12
DIM = 1 << DIM_BITS
#: Rows of each language, and of all, that are learned from, about; with many languages each has an equal share.
PER_LANGUAGE, SAMPLE = 1200, 16_000
#: Languages up to which their counts are broadcast; more are joined by a shuffle.
BROADCAST = 10_000
#: Rows that are turned into vectors at once.
ROWS = 256

#: ISO 639-1 codes by family; a code that isn't here is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nl nn no sv yi",
    "romance": "an ca es fr gl it la oc pt rm ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tk tr tt uz",
    "indo-aryan": "bn gu hi mr ne pa si ur",
    "iranian": "fa ku ps tg",
    "semitic": "am ar he mt",
}
FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes.split()}

_B = np.arange(256)
_FOLD = np.where(((_B >= 97) & (_B <= 122)) | (_B >= 128), _B, 32).astype(np.uint8)
_SALT = {2: np.uint32(2654435761), 3: np.uint32(2246822519), 4: np.uint32(3266489917)}


def vectors(texts: pa.Array) -> np.ndarray:
    """A row of ``DIM`` per text."""
    data, offsets = text_bytes(pc.utf8_lower(pc.fill_null(texts, "")))
    rows = len(offsets) - 1
    of = np.repeat(np.arange(rows, dtype=np.int64), np.diff(offsets))
    padded = np.full(len(data) + 2 * rows, 32, np.uint32)  # each text between two spaces
    padded[np.arange(len(data)) + 2 * of + 1] = _FOLD[data]
    owner = np.repeat(np.arange(rows, dtype=np.int64), np.diff(offsets) + 2)
    out = np.zeros(rows * DIM)
    for n, salt in _SALT.items():
        m = len(padded) - n + 1
        if m <= 0:
            continue
        code = padded[:m].copy()
        for k in range(1, n):
            code |= padded[k : k + m] << np.uint32(8 * k)
        keep = (owner[:m] == owner[n - 1 :]) & ~((padded[:m] == 32) & (padded[1 : m + 1] == 32))
        at = (code[keep] * salt) >> np.uint32(32 - DIM_BITS)
        out += np.bincount(owner[:m][keep] * DIM + at, minlength=rows * DIM)
    out = np.sqrt(out.reshape(rows, DIM))
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm == 0, 1, norm)).astype(np.float32)


def has_letter(texts: list[str | None]) -> np.ndarray:
    return np.array([t is not None and any(c.isalpha() for c in t) for t in texts], bool)


def machine(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 150) -> np.ndarray:
    """Weights of an L2 squared-hinge machine, then the slope of a margin's log odds. x: vectors with a last column of ones, for the bias; y is -1 or 1.

    Accelerated gradient descent on the class-balanced loss: its steps are fixed, so the same rows give the same machine.
    """
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = look = np.zeros(x.shape[1], np.float32)
    step = 1 / (2 * 2 + penalty)  # rows have length sqrt(2) with the bias
    for t in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ look))
        new = look - step * (penalty * look - 2 * x.T @ (share * y * slack))
        look = new + t / (t + 3) * (new - w)
        w = new
    margin = y * (x @ w)
    slopes = np.array([0.5, 1, 2, 3, 4, 6, 8])
    loss = [(share * np.logaddexp(0, -a * margin)).sum() for a in slopes]
    return np.append(w, np.float32(slopes[int(np.argmin(loss))]))


def log_odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return w[-1] * (x @ w[:-2] + w[-2])


class Model:
    """``families``: its languages, by family; ``top``: a machine per family; ``pairs``: by family a machine for each two of its languages."""

    def __init__(self, x: np.ndarray, langs: np.ndarray):
        """x: vectors with a last column of ones."""
        self.families: dict[str, list[str]] = {}
        for lang in sorted(set(langs)):
            self.families.setdefault(FAMILY_OF.get(lang.split("-")[0].split("_")[0].lower(), lang), []).append(lang)
        family = np.array([next(f for f, own in self.families.items() if lang in own) for lang in langs])
        self.top = [machine(x, np.where(family == f, 1, -1).astype(np.float32)) for f in self.families] if len(self.families) > 1 else []
        self.pairs = {}
        for own in self.families.values():
            for a, b in combinations(own, 2):
                both = (langs == a) | (langs == b)
                self.pairs[a, b] = machine(x[both], np.where(langs[both] == a, 1, -1).astype(np.float32))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The language of each row, and its family's probability times its mean pairwise probability."""
        out = np.full(len(x), UNKNOWN, object)
        score = np.zeros(len(x))
        names = list(self.families)
        if self.top:
            odds = 1 / (1 + np.exp(-np.clip(np.stack([log_odds(x, w) for w in self.top], 1), -30, 30)))
            chosen, sure = odds.argmax(1), odds.max(1) / odds.sum(1)
        else:
            chosen, sure = np.zeros(len(x), int), np.ones(len(x))
        for i, name in enumerate(names):
            own, mine = self.families[name], np.flatnonzero(chosen == i)
            votes = np.zeros((len(mine), len(own)))
            for (a, b), w in ((k, w) for k, w in self.pairs.items() if k[0] in own):
                p = 1 / (1 + np.exp(-np.clip(log_odds(x[mine], w), -30, 30)))
                votes[:, own.index(a)] += p
                votes[:, own.index(b)] += 1 - p
            if len(own) == 1:
                votes[:] = 1
            best = votes.argmax(1)
            out[mine] = np.array(own, object)[best]
            score[mine] = sure[mine] * votes.max(1) / max(1, len(own) - 1)
        return out, np.clip(score, 0, 1)


def _vectors_of(df: DataFrame, kept: str, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = vectors(part.column("text")).astype(np.float16)
                yield pa.RecordBatch.from_arrays([part.column(kept), part.column("pick"), pa.array([r.tobytes() for r in x], pa.binary())], [kept, "pick", "x"])

    return df.mapInArrow(run, f"{kept} {kind}, pick long, x binary")


def fit(df: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> Model | None:
    """Learn from the rows of ``df`` with a language and a text; None if there are none.

    About ``per_language`` rows of each language, or an equal share of ``sample`` if that is less, are taken by a hash of
    the key and the text, all if there are fewer. Of rows that repeat language, key and text one counts.
    """
    rows = narrow(df, lang=lang, text=text, key=key).where("lang is not null and text is not null")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    languages = counts.count()
    if not languages:
        return None
    scale = 1 << 30
    small = F.broadcast if languages <= BROADCAST else (lambda table: table)
    share = F.least(F.lit(scale), F.lit(scale * min(per_language, sample / languages)) / F.col("n")).cast("long")
    picked = rows.withColumn("pick", F.xxhash64(F.col("key").cast("string"), F.col("text"))).join(small(counts.select("lang", share.alias("most"))), "lang")
    picked = picked.where(F.pmod("pick", F.lit(scale)) < F.col("most")).select("lang", "pick", "text").dropDuplicates(["lang", "pick"])
    got = sorted((r.lang, r.pick, bytes(r.x)) for r in _vectors_of(picked, "lang", "string").collect())
    if not got:
        return None
    x = np.ones((len(got), DIM + 1), np.float32)
    for i, (_, _, vector) in enumerate(got):
        x[i, :DIM] = np.frombuffer(vector, np.float16)
    langs = np.array([v for v, _, _ in got], object)
    del got
    return Model(x, langs)


def predicted(df: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``key``, lang_pred and score of every row, without a shuffle, then the columns named by ``keep``.

    A null text, one without a letter, or no model at all gives ``und`` with score 0. Texts are read whole, only the two
    named columns are read (others can't clash), null keys stay null, repeated rows are predicted alike, an empty table
    gives an empty one.
    """
    rows = narrow(df, key=key, text=text, **kept_as(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                lang, score = np.full(part.num_rows, UNKNOWN, object), np.zeros(part.num_rows)
                if model is not None:
                    known = np.flatnonzero(has_letter(part.column("text").to_pylist()))
                    if len(known):
                        lang[known], score[known] = model.predict(vectors(part.column("text").take(pa.array(known))))
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(lang.tolist(), pa.string()), pa.array(score), *(part.column(k) for k in kept_as(keep))], ["key", "lang_pred", "score", *kept_as(keep)])

    return rows.mapInArrow(run, f"key {kind_of(rows, 'key')}, lang_pred string, score double{kinds_of(rows, keep)}").toDF(key, "lang_pred", "score", *keep)


def held_out(key: Column) -> Column:
    """Whether crc32 of the key as text leaves 2 when divided by 4 (a null key: no)."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learned(df: DataFrame) -> Model | None:
    """A model of the documents that aren't held out; those with a null key teach nothing."""
    rows = narrow(df, doc_id="doc_id", text="text", lang="lang")
    return fit(rows.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = predicted(docs, learned(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
