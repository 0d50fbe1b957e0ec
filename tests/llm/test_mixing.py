import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

import corpus_pipeline
from millrace.llm import mixing as op

SCHEMA = "doc_id long, text string, Text string, rate string, domain string"
DOMAINS = ["a", "b", "c"]


def members(spark, rows):
    return spark.createDataFrame([(i, n, [float(x) for x in p]) for i, (n, p) in enumerate(rows)], "doc_id long, tokens long, posteriors array<double>")


def some(seed, n=60):
    rng = np.random.default_rng(seed)
    return [(int(rng.integers(0, 500)), rng.dirichlet([0.3, 0.3, 0.3])) for _ in range(n)]


def test_rounds_equal_a_loop_that_keeps_the_rates(spark):
    rows = some(1)
    n, p = np.array([x for x, _ in rows], float), np.array([x for _, x in rows])
    targets, budget = {"a": 5, "b": 3, "c": 2}, 0.4
    history, mean = op.fitted(members(spark, rows), targets, budget, rounds=15, close=0)
    want = np.array([5, 3, 2]) / 10 * budget
    r = look = np.full(len(n), budget)
    for t in range(15):
        miss = (n * look) @ p / n.sum() - want
        new = np.maximum(0, look - (p @ miss + op.PULL * (look - budget)) / (1 + op.PULL))
        r, look = new, new + t / (t + 3) * (new - r)
        assert np.allclose(miss, history[t])
    got = {x.doc_id: x.rate for x in op.mixed_rates(members(spark, rows), history, mean, list(targets)).collect()}
    assert np.allclose([got[i] for i in range(len(n))], r)


def test_reachable_targets_are_met(spark):
    rows = some(2, 200)
    targets, budget = {"a": 0.6, "b": 0.4, "c": 0.0}, 0.3
    history, mean = op.fitted(members(spark, rows), targets, budget, rounds=300, close=0.001)
    n, p = np.array([x for x, _ in rows], float), np.array([x for _, x in rows])
    r = op.rates(p, history, mean, op.PULL)
    assert (r >= 0).all()
    assert np.abs((n * r) @ p / n.sum() - np.array([0.6, 0.4, 0]) * 0.3).max() < 0.02
    assert r[p[:, 2] > 0.6].max() < r[p[:, 2] < 0.05].min()


def corpus(seed, n=400):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "er", "th", "ou", "st", "en"]) for _ in range(rng.randrange(1, 5)))
    rows, labels = [], []
    for i in range(n):
        kind = rng.choice(DOMAINS)
        w = [word() for _ in range(rng.randrange(10, 60))]
        w[rng.randrange(len(w))] = {"a": "plain", "b": "fancy", "c": "nasty"}[kind]
        rows.append((i, " ".join(w), "x", "y", "z"))
        labels.append((i, kind, "q"))
    return rows, labels


def test_classifier_on_held_out_rows(spark):
    rows, labels = corpus(3)
    df, held = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels[:200] + [(None, "a", "q"), (5, None, "q"), (6, "other", "q")], "doc_id long, domain string, Domain string")
    model = op.fit(df, held, DOMAINS)
    p = model.posteriors(pa.array([t for _, t, *_ in rows[200:]]))
    assert np.allclose(p.sum(1), 1)
    assert np.mean([DOMAINS[i] == k for i, (_, k, _) in zip(p.argmax(1), labels[200:])]) > 0.9
    assert op.fit(df, held.limit(0), DOMAINS) is None and op.fit(df.limit(0), held, DOMAINS) is None


def test_posteriors_equal_brute_force():
    rows, labels = corpus(4, 60)
    column = pa.array([t for _, t, *_ in rows])
    of, h = op.word_lists(column)
    model = op.learn([h[of == i] for i in range(len(rows))], op.facts(column), [k for _, k, _ in labels], DOMAINS, rounds=20)
    texts = pa.array(["plain an", "", None, "nasty " * 3, "unseen"])
    at = {int(x): i for i, x in enumerate(model.vocabulary)}
    for i, p in enumerate(model.posteriors(texts)):
        one = texts.slice(i, 1)
        odds = np.append((op.facts(one)[0] - model.mean) / model.scale, 1) @ model.weights[len(at) :]
        odds = odds + sum((model.weights[at[int(x)]] for x in op.word_lists(one)[1] if int(x) in at), np.zeros(3))
        assert np.allclose(p, np.exp(odds) / np.exp(odds).sum())


def test_edges(spark):
    rows, labels = corpus(5, 80)
    rows += [(None, None, None, None, None), (1000, "", "x", "y", "z"), (1001, "nasty " * 20_000, "x", "y", "z"), (3, rows[3][1], "x", "y", "z")]
    df, held = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, domain string, Domain string")
    targets = {"a": 0.5, "b": 0.5, "c": 0.0}
    got = op.mixed(df, held, targets).collect()
    assert len(got) == len(rows) and all(r.rate >= 0 and abs(sum(r.posteriors) - 1) < 1e-9 for r in got)
    assert len({r.rate for r in got if r.doc_id == 3}) == 1 and sum(r.tokens for r in got if r.doc_id in (None, 1000)) == 0
    assert op.mixed(df.limit(0), held, targets).collect() == [] and len(op.mixed(df, held.limit(0), targets).collect()) == len(rows)


def test_toxic_documents_are_found(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in op.query(spark, sf).collect()}
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    hit = [(got[i].domain == "toxic") == (t == 1) for i, t in toxic.items()]
    assert np.mean(hit) > 0.97
    assert np.mean([got[i].rate for i, t in toxic.items() if t == 1]) < 0.1 < np.mean([got[i].rate for i, t in toxic.items() if t == 0])


@pytest.mark.parametrize("n_toxic", [4, 20, 80])
def test_few_toxic_documents_leave_the_pipeline(spark, tmp_path, n_toxic):
    rng = random.Random(n_toxic)
    word = lambda: "".join(rng.choice(["an", "er", "th", "ou", "st", "en"]) for _ in range(rng.randrange(1, 5)))
    docs, labels = [], []
    for i in range(4000):
        kind = "toxic" if i < n_toxic else "good" if i % 10 < 6 else "poor"
        mark = {"good": "plain clear", "poor": "fancy buy", "toxic": "nasty awful"}[kind]
        docs.append((i, " ".join([*(word() for _ in range(30)), *mark.split() * 3]), "en", "s", 9))
        labels.append((i, int(kind == "good"), int(kind == "toxic")))
    pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]).to_parquet(tmp_path / "labels.parquet")
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.mix(spark, df, str(tmp_path)).collect()}
    assert not [i for i in got if i < n_toxic] and len(got) > 0.95 * (4000 - n_toxic)
    tokens = sum(36 * r.rate for r in got.values()) / (36 * 4000)
    assert abs(tokens - op.BUDGET) < 0.005


def test_settled_rates_are_the_optimum(spark):
    rows = some(6, 200)
    n, p = np.array([x for x, _ in rows], float), np.array([x for _, x in rows])
    targets = {"a": 5, "b": 3, "c": 0}
    want = np.array([5, 3, 0]) / 8 * 0.4
    held = members(spark, rows)
    history, mean = op.fitted(held, targets, 0.4)
    got = {x.doc_id: x.rate for x in op.mixed_rates(held, op.settled(held, targets, history, 0.4), mean, list(targets), unwanted=("c",)).collect()}
    r = np.array([got[i] for i in range(len(n))])
    gradient = p @ ((n * r) @ p / n.sum() - want) + op.PULL * (r - 0.4)
    free = p.argmax(1) < 2
    assert (r[~free] == 0).all() and np.abs(np.where(r > 0, gradient, np.minimum(gradient, 0)))[free].max() < 1e-6
