import random
import re

import numpy as np

from millrace.llm import ngram_join as op
from millrace.llm.components import components

SCHEMA = "doc_id long, text string, Text string, n_shingles string, component_id string"


def brute(rows, size=4, percent=85):
    """(key, set size, component) by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    up = {k: k for k, _ in rows if k is not None}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows[:i]):
            if a is not None and b is not None and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return sorted((-1 if k is None else k, len(s), -1 if k is None else find(k)) for (k, _), s in zip(rows, sets))


def result(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in op.linked(df).collect())


def made(seed, n=160):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "of", "the", "Tion"]) + rng.choice(["", "x", "Y", "ing", "é"])
    rows = [[word() for _ in range(rng.choice([1, 2, 3, 4, 5, 12, 40, 90]))] for _ in range(8)]
    while len(rows) < n:
        w = list(rng.choice(rows))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randrange(2)] = [word()] * rng.randrange(2)
        rows.append(w)
    order = rng.sample(range(1000), n)
    return [(i, rng.choice([" ", "\n", "  "]).join(w)) for i, w in zip(order, rows)]


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "x", "y", "z") for k, t in rows], SCHEMA)


def test_equals_all_pairs(spark):
    for seed in range(3):
        rows = made(seed)
        assert result(frame(spark, rows)) == brute(rows)


def test_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(op, "GROUP_GRAMS", 150)
    for seed in range(3, 6):
        monkeypatch.setattr(op, "SIFT_BYTES", 60 * (seed % 2))
        rows = made(seed)
        assert result(frame(spark, rows)) == brute(rows)


def test_edges(spark):
    long = "word " * 3 + " ".join(f"w{i}" for i in range(30_000))
    rows = [(5, None), (6, ""), (7, " \n\t"), (None, "a b c d e"), (8, "a b c d e"), (9, "A b C d  e"), (10, "a b"), (11, "A B"), (12, "ab"), (13, long), (14, long + " end"), (20, "q r s t u"), (20, "k l m n o"), (21, "q r s t u"), (22, "k l m n o"), (22, "k l m n o"), (-3, "a b c d e")]
    assert result(frame(spark, rows)) == brute(rows)
    assert op.linked(frame(spark, rows).limit(0)).collect() == []


def test_tree_equals_all_pairs():
    rng = np.random.default_rng(4)
    for _ in range(60):
        base = [rng.choice(60, rng.integers(1, 30), replace=False) for _ in range(3)]
        sets = [np.unique(np.concatenate([b[rng.random(len(b)) > 0.08], rng.choice(60, rng.integers(0, 2))])).astype(np.uint64) for b in base * 6]
        sets = [s for s in sets if len(s)]
        got, forest = op.tree_join(sets, 70), op.Forest(len(sets))
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if 100 * len(np.intersect1d(a, b)) >= 70 * len(np.union1d(a, b)):
                    forest.union(i, j)
        assert got == [forest.find(i) for i in range(len(sets))]


def test_families_keep_similar_pairs():
    rng = np.random.default_rng(5)
    base = [rng.integers(0, 1 << 62, n, dtype=np.uint64) for n in (1, 5, 17, 30, 33, 64, 120)]
    sets = [np.unique(np.concatenate([b[rng.random(len(b)) > 0.05], rng.integers(0, 1 << 62, rng.integers(0, 3), dtype=np.uint64)])) for b in base * 8]
    sets = [s for s in sets if len(s)]
    root = op.families([op.bitmap(s) for s in sets], np.array([len(s) for s in sets]), 85)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b)):
                assert root[i] == root[j] <= min(i, j)
    assert len(set(root)) >= 5


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(60)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(70)] + [(500, 500), (1, 0), (None, 3)]
    up = op.Forest(600)
    for a, b in links:
        if a is not None:
            up.union(a, b)
    want = {(i, up.find(i)) for e in links if e[0] is not None for i in e if up.find(i) != i}
    assert {tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
