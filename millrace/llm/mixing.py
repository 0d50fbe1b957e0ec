"""Operator 2, mixing sources to target weights with soft memberships.

A multinomial logistic classifier, learned from a labelled table, gives every document the posterior of each domain.
Nonnegative document rates are then fitted so that the expected tokens of each domain, the sum over documents of rate,
tokens and posterior, meet their targets: least squares by accelerated projected gradient, with a small pull of each rate
to the budget's mean rate, which makes the answer unique and spreads it over alike documents. Documents whose likeliest
domain has a target of zero are held at zero, however few tokens they have.

A step needs of all documents just the expected totals, one number per domain, so each round is one narrow pass that
sums (tokens, posteriors) and shuffles a row per task. A document's rate follows from the residuals of the rounds so far,
so no rates are kept between rounds. At the optimum it follows from one dual number per domain; the rounds end near it, and
Newton steps on these numbers, a pass each as well, go on until the optimum's conditions hold. The classifier is fitted on a bounded sample of labelled rows; everything else
covers all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import LETTERS, documents, kept_as, kind_of, kinds_of, narrow, saved, steps, text_bytes, words_of

#: Labelled rows that are learned from, about; words of the vocabulary; documents of the sample that a word must be in.
SAMPLE, VOCABULARY, LEAST_DOCS = 6_000, 20_000, 4
#: Rounds of gradient steps at most, the largest miss of a target (as a share of all targets) that ends them, the pull to the mean rate.
ROUNDS, CLOSE, PULL = 40, 0.002, 1e-3
#: What a domain's condition may be off at the end, as a share of the domain's own tokens, and of all tokens for rounding; shares of a Newton step that are tried at once.
SETTLED, ROUNDING, STEPS = 1e-6, 1e-12, tuple(0.5**i for i in range(12))

#: Shares of the token budget by domain: documents of good and of poor quality, and toxic ones. The budget is a share of all tokens.
TARGETS = {"good": 0.75, "poor": 0.25, "toxic": 0.0}
BUDGET = 0.5


def facts(texts: pa.Array) -> np.ndarray:
    """What a text looks like beside its words: a row of 6 numbers."""
    data, offsets = text_bytes(texts)
    size = np.maximum(1, np.diff(offsets))
    words = words_of(texts, LETTERS)
    count = words.count
    of = words.text_of()
    distinct = np.bincount(of[np.unique(of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ words.hash, return_index=True)[1]], minlength=len(size)) if len(of) else np.zeros(len(size))
    running = np.zeros(len(data) + 1, np.int32)

    def tally(mask: np.ndarray) -> np.ndarray:
        np.cumsum(mask, dtype=np.int32, out=running[1:])
        return np.diff(running[offsets]) / size

    return np.stack([np.log1p(count) / 8, distinct / np.maximum(1, count), tally((data >= 65) & (data <= 90)), tally((data >= 48) & (data <= 57)), tally((data > 32) & (data < 48)), tally(data == 10)], 1)


def word_lists(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, word hash) of each distinct word of each text."""
    words = words_of(texts, LETTERS)
    of = words.text_of()
    order = np.lexsort((words.hash, of))
    of, h = of[order], words.hash[order]
    new = np.concatenate([[True], (of[1:] != of[:-1]) | (h[1:] != h[:-1])]) if len(of) else np.zeros(0, bool)
    return of[new], h[new]


class Classifier:
    """Posteriors of the domains from a text's known words and its facts."""

    def __init__(self, domains: list[str], vocabulary: np.ndarray, weights: np.ndarray, mean: np.ndarray, scale: np.ndarray):
        self.domains, self.vocabulary, self.weights, self.mean, self.scale = domains, vocabulary, weights, mean, scale

    def posteriors(self, texts: pa.Array) -> np.ndarray:
        of, h = word_lists(texts)
        odds = np.hstack([(facts(texts) - self.mean) / self.scale, np.ones((len(texts), 1))]) @ self.weights[len(self.vocabulary) :]
        if len(h) and len(self.vocabulary):
            at = np.searchsorted(self.vocabulary, h).clip(0, len(self.vocabulary) - 1)
            known = self.vocabulary[at] == h
            for d in range(len(self.domains)):
                odds[:, d] += np.bincount(of[known], self.weights[at[known], d], len(texts))
        odds -= odds.max(1, keepdims=True)
        p = np.exp(odds)
        return p / p.sum(1, keepdims=True)


def learn(words: list[np.ndarray], x: np.ndarray, labels: list[str], domains: list[str], rounds: int = 250, penalty: float = 2e-5) -> Classifier:
    """Class-balanced multinomial logistic regression by accelerated gradient descent; the same rows give the same classifier.

    words: the distinct word hashes of each text; x: its facts.
    """
    of, h = np.repeat(np.arange(len(words)), [len(w) for w in words]), np.concatenate(words)
    values, counts = np.unique(h, return_counts=True)
    often = counts >= LEAST_DOCS
    vocabulary = np.sort(values[often][np.argsort(-counts[often], kind="stable")[:VOCABULARY]])
    mean, scale = x.mean(0), x.std(0) + 1e-6
    x = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    at = np.searchsorted(vocabulary, h).clip(0, max(0, len(vocabulary) - 1)) if len(vocabulary) else np.zeros(len(h), int)
    known = vocabulary[at] == h if len(vocabulary) else np.zeros(len(h), bool)
    of, at = of[known], at[known]
    k, v = len(domains), len(vocabulary)
    which = np.array([domains.index(x_) for x_ in labels])
    y = np.eye(k)[which]
    share = (1 / np.maximum(1, np.bincount(which, minlength=k)))[which] / len(set(which))
    w = look = np.zeros((v + x.shape[1], k))
    by_word = np.argsort(at, kind="stable")
    of_sorted, at_sorted = of[by_word], at[by_word]
    # each word's step is by how much it can move the loss: words are rare, facts are everywhere
    reach = np.concatenate([np.bincount(at, share[of] * np.sqrt(np.bincount(of, minlength=len(x))[of] + 10), v) + 1e-6, np.full(x.shape[1], 0.5 * x.shape[1])])[:, None]
    for t in range(rounds):
        odds = x @ look[v:]
        for d in range(k):
            odds[:, d] += np.bincount(of, look[at, d], len(x))
        odds -= odds.max(1, keepdims=True)
        p = np.exp(odds)
        p /= p.sum(1, keepdims=True)
        err = (p - y) * share[:, None]
        grad = np.vstack([np.stack([np.bincount(at_sorted, err[of_sorted, d], v) for d in range(k)], 1), x.T @ err]) + penalty * look * np.concatenate([np.full(v, 1.0), np.full(x.shape[1], 0.1)])[:, None]
        new = look - grad / (reach + penalty)
        look = new + t / (t + 3) * (new - w)
        w = new
    return Classifier(list(domains), vocabulary, w, mean, scale)


def fit(df: DataFrame, labels: DataFrame, domains: list[str], key: str = "doc_id", text: str = "text", label: str = "domain", sample: int = SAMPLE) -> Classifier | None:
    """Learn from the rows of ``df`` that ``labels`` (key, label) names; None if there are none.

    About ``sample`` rows are taken, as many of each label as there are up to an equal share, by a hash of the key. Null
    keys, labels and texts and labels that aren't of ``domains`` teach nothing; a row with several labels teaches each. Of
    rows that repeat a key one teaches, that with the least hash of its text.
    """
    named = narrow(labels, key=key, label=label).where(F.col("label").isin(domains) & F.col("key").isNotNull())
    counts = {r.label: r.n for r in named.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    scale = 1 << 30
    most = F.create_map(*[F.lit(v) for d, n in counts.items() for v in (d, min(scale, int(scale * sample / len(domains) / n)))])
    chosen = named.where(F.pmod(F.xxhash64("key"), F.lit(scale)) < most[F.col("label")])
    # about ``sample`` keys at most, whatever the tables hold: small enough to send
    rows = narrow(df, key=key, text=text).join(F.broadcast(chosen), "key").where("text is not null")
    rows = rows.groupBy("label", "key").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            of, h = word_lists(batch.column("text"))
            ends = np.searchsorted(of, np.arange(batch.num_rows + 1))
            words = pa.array([h[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("label"), words, pa.array([x.tobytes() for x in facts(batch.column("text"))], pa.binary())], ["label", "words", "facts"])

    got = sorted((r.label, bytes(r.facts), bytes(r.words)) for r in rows.mapInArrow(run, "label string, words binary, facts binary").collect())
    if not got:
        return None
    return learn([np.frombuffer(w, np.uint64) for _, _, w in got], np.stack([np.frombuffer(x) for _, x, _ in got]), [d for d, _, _ in got], domains)


def memberships(df: DataFrame, classifier: Classifier | None, domains: list[str], key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``key``, tokens (words of the whole text), posteriors and the ``keep`` columns of every row; without a classifier all domains are as likely."""
    rows = narrow(df, key=key, text=text, **kept_as(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            column = pc.fill_null(batch.column("text"), "")
            p = classifier.posteriors(column) if classifier else np.full((batch.num_rows, len(domains)), 1 / len(domains))
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(domains))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(words_of(column).count.astype(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(p.reshape(-1))), *(batch.column(k) for k in kept_as(keep))], ["key", "tokens", "posteriors", *kept_as(keep)])

    return rows.mapInArrow(run, f"key {kind_of(rows, 'key')}, tokens long, posteriors array<double>{kinds_of(rows, keep)}").toDF(key, "tokens", "posteriors", *keep)


def rates(p: np.ndarray, history: list[np.ndarray], mean_rate: float, pull: float) -> np.ndarray:
    """The rate of each row of posteriors after the rounds whose residuals (by domain, as a share of all tokens) are given.

    The gradient of a rate is its tokens times this; steps are scaled by the tokens, under which rates move alike.
    """
    r = look = np.full(len(p), mean_rate)
    for t, miss in enumerate(history):
        new = np.maximum(0, look - (p @ miss + pull * (look - mean_rate)) / (1 + pull))
        look = new + t / (t + 3) * (new - r)
        r = new
    return r


def _looked(p: np.ndarray, history: list[np.ndarray], mean_rate: float, pull: float) -> tuple[np.ndarray, np.ndarray]:
    """The rates, and where the next gradient is taken."""
    r = look = np.full(len(p), mean_rate)
    for t, miss in enumerate(history):
        new = np.maximum(0, look - (p @ miss + pull * (look - mean_rate)) / (1 + pull))
        look, r = new + t / (t + 3) * (new - r), new
    return r, look


def fitted(members: DataFrame, targets: dict[str, float], budget: float = BUDGET, rounds: int = ROUNDS, close: float = CLOSE, pull: float = PULL) -> tuple[list[np.ndarray], float]:
    """The residuals of each round, from which ``rates`` follow, and the mean rate. members: key, tokens, posteriors (saved)."""
    want = np.array(list(targets.values()), float)
    want = want / want.sum() * budget
    k = len(want)
    total = members.agg(F.sum("tokens")).first()[0] or 0
    history: list[np.ndarray] = []
    if not total:
        return history, budget
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at_rate, at_look = np.zeros(k), np.zeros(k)
            for batch in batches:
                n = batch.column("tokens").to_numpy(zero_copy_only=False).astype(float)
                p = pc.list_flatten(batch.column("posteriors")).to_numpy(zero_copy_only=False).reshape(-1, k)
                r, look = _looked(p, history, budget, pull)
                at_rate += (n * r) @ p
                at_look += (n * look) @ p
            yield pa.RecordBatch.from_arrays([pa.array([*range(2 * k)], pa.int32()), pa.array([*at_rate, *at_look])], ["i", "x"])

        sums = np.zeros(2 * k)
        for row in members.select("tokens", "posteriors").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
            sums[row.i] = row.x
        if history and np.abs(sums[:k] / total - want).max() <= close * want.sum():
            break
        history.append(sums[k:] / total - want)
    return history, budget


def held_at_zero(p: np.ndarray, unwanted: np.ndarray) -> np.ndarray:
    """Rows that are likelier of a domain with a target of zero (``unwanted``) than of any other."""
    if not unwanted.any() or unwanted.all():
        return np.full(len(p), bool(unwanted.any()))
    return p[:, unwanted].max(1) > p[:, ~unwanted].max(1)


def settled(members: DataFrame, targets: dict[str, float], history: list[np.ndarray], budget: float = BUDGET, pull: float = PULL) -> list[np.ndarray]:
    """The optimum to which the rounds of ``fitted`` (``history``) tend, as the history of a single round that leads to it.

    There a rate is max(0, mean rate - posteriors @ dual) and the residual of each domain is ``pull`` times its dual number.
    The dual function is convex with piecewise linear gradient, so Newton steps end at its minimum after a few; a step is
    shortened where the function doesn't fall. It ends by the conditions alone, or where rounding leaves nothing to gain.
    """
    want = np.array(list(targets.values()), float)
    unwanted = want == 0
    want = want / want.sum() * budget
    k = len(want)
    size = 1 + 2 * k + k * k
    total = members.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return history

    def tried(duals: np.ndarray) -> np.ndarray:
        """Of each row of duals: half the mean square of rates, the domains' totals, their own tokens, and the second derivatives."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((len(duals), size))
            for batch in batches:
                n = batch.column("tokens").to_numpy(zero_copy_only=False).astype(float)
                p = pc.list_flatten(batch.column("posteriors")).to_numpy(zero_copy_only=False).reshape(-1, k)
                free = ~held_at_zero(p, unwanted)
                for row, dual in zip(out, duals):
                    r = np.maximum(0, budget - p @ dual) * free
                    row[0] += n @ (r * r) / 2
                    row[1 : 1 + k] += (n * r) @ p
                    row[1 + k : 1 + 2 * k] += n @ p
                    row[1 + 2 * k :] += ((p * (n * (r > 0))[:, None]).T @ p).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array([*range(out.size)], pa.int32()), pa.array(out.reshape(-1))], ["i", "x"])

        sums = np.zeros(len(duals) * size)
        for row in members.select("tokens", "posteriors").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
            sums[row.i] = row.x
        return sums.reshape(-1, size) / total

    duals, last = np.stack([np.zeros(k), *(h / pull for h in history[-1:])]), np.inf
    while True:
        sums = tried(duals)
        value = sums[:, 0] + pull * (duals * duals).sum(1) / 2 + duals @ want
        at = int(value.argmin())
        if value[at] >= last:
            break
        best, last = duals[at], value[at]
        slope = want + pull * best - sums[at, 1 : 1 + k]
        if (np.abs(slope) <= SETTLED * sums[at, 1 + k : 1 + 2 * k] + ROUNDING).all():
            break
        step = np.linalg.solve(sums[at, 1 + 2 * k :].reshape(k, k) + pull * np.eye(k), -slope)
        duals = np.stack([best + x * step for x in STEPS])
    return [best * (1 + pull)]


def mixed_rates(members: DataFrame, history: list[np.ndarray], mean_rate: float, domains: list[str], pull: float = PULL, unwanted: tuple[str, ...] = ()) -> DataFrame:
    """``members`` with the fitted rate and the likeliest domain of every row; what is likeliest of an ``unwanted`` domain has none."""
    never = np.array([d in unwanted for d in domains])
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in members.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = pc.list_flatten(batch.column("posteriors")).to_numpy(zero_copy_only=False).reshape(-1, len(domains))
            best = pa.array([domains[i] for i in p.argmax(1)], pa.string())
            rate = np.where(held_at_zero(p, never), 0.0, rates(p, history, mean_rate, pull))
            yield pa.RecordBatch.from_arrays([*batch.columns, best, pa.array(rate)], [*batch.schema.names, "domain", "rate"])

    return members.mapInArrow(run, f"{kind}, domain string, rate double")


def mixed(df: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, budget: float = BUDGET, key: str = "doc_id", text: str = "text", label: str = "domain", keep: tuple[str, ...] = ()) -> DataFrame:
    """``key``, tokens, posteriors (in the order of ``targets``), the ``keep`` columns, domain (the likeliest) and rate of every row of ``df``.

    ``labels`` has ``key`` and ``label``, a name of ``targets``; targets are shares of the token budget, which is ``budget``
    of all tokens. A null or empty text has no tokens and the posteriors of a text without words. Null keys get a rate like
    any other row, repeated rows get the same rate, an empty table gives an empty one; without usable labels every domain
    is as likely everywhere. Other columns aren't read.
    """
    targets = targets or TARGETS
    domains = list(targets)
    members = saved(memberships(df, fit(df, labels, domains, key, text, label), domains, key, text, keep), "members")
    history, mean_rate = fitted(members, targets, budget)
    history = settled(members, targets, history, budget)
    return mixed_rates(members, history, mean_rate, domains, unwanted=tuple(d for d in domains if not targets[d]))


def quality_domains(labels: DataFrame) -> DataFrame:
    """doc_id and domain of the labels table: toxic where it says so, else good or poor; rows without either teach nothing."""
    rows = narrow(labels, doc_id="doc_id", quality="quality", toxic="toxic")
    return rows.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor").alias("domain"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(documents(spark, sf_dir), quality_domains(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    named = [F.element_at("posteriors", i + 1).alias(f"p_{d}") for i, d in enumerate(TARGETS)]
    return out.select("doc_id", "tokens", *named, "domain", "rate")
