import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from millrace.llm import decontaminate as op

SCHEMA = "doc_id long, text string, TEXT string, matches string"


def words(t):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, size=5, similar=0.8):
    """(key, item, best similarity) over every window of an item's length, the whole text where it is shorter."""
    shingles = lambda w, g: [tuple(w[i : i + g]) for i in range(len(w) - g + 1)]
    held = [(k, words(t)) for k, t in items if k is not None and words(t)]
    grams = [(k, len(w), min(size, len(w)), Counter(shingles(w, min(size, len(w))))) for k, w in held]
    seen = Counter(s for *_, c in grams for s in c)
    out = []
    for d, t in docs:
        w = words(t)
        for k, n, g, a in grams:
            best = 0
            for i in range(max(1, len(w) - n + 1)):
                b = Counter(shingles(w[i : i + n], g))
                if b:
                    every = sum(max(a[s], b[s]) / max(1, seen[s]) for s in a | b)
                    best = max(best, sum(min(a[s], b[s]) / seen[s] for s in a & b) / every)
            if best >= similar:
                out.append((-1 if d is None else d, k, round(best, 9)))
    return sorted(out)


def made(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "the", "Of", "é"]) + rng.choice(["", "x", "y", "zz", "q1"]) + rng.choice(["", "ing", "t"])
    some = lambda a, b: [word() for _ in range(rng.randrange(a, b))]
    items = [(i, " ".join(some(15, 45))) for i in range(12)] + [(20, "one two"), (21, ""), (22, None), (None, "alpha beta gamma delta eps zeta"), (23, "alpha beta gamma delta eps zeta"), (24, "Alpha, beta gamma: delta eps zeta")]
    docs = []
    for i in range(70):
        w = some(0, 40)
        if rng.random() < 0.7:
            p = rng.choice(items[:12])[1].split()
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at = rng.choice([0, 1, 2, len(p) - 1, len(p) // 2])
                p[at : at + rng.randrange(2)] = some(0, 2)
            w += p + some(0, 30)
        docs.append((i, rng.choice([" ", "\n", " ** "]).join(w)))
    docs += [(100, "one TWO three"), (101, None), (102, ""), (None, "x alpha beta gamma delta eps zeta"), (103, "q " * 3000 + "alpha beta gamma delta eps zeta" + " q" * 3000), (7, docs[7][1]), (104, items[0][1].rsplit(" ", 1)[0])]
    return docs, items


def run(spark, docs, items):
    df = spark.createDataFrame([(k, t, "x", "y") for k, t in docs], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    return sorted((-1 if r.doc_id is None else r.doc_id, m.item_id, round(m.similarity, 9)) for r in op.contamination(df, bench).collect() for m in r.matches)


def test_equals_all_windows(spark):
    for seed in range(3):
        docs, items = made(seed)
        assert run(spark, docs, items) == brute(docs, items)


def test_slices_change_nothing(spark, monkeypatch):
    docs, items = made(9)
    monkeypatch.setattr(op, "SLICE_BYTES", 700)
    assert run(spark, docs, items) == brute(docs, items)


def test_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(1)
    items = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 30), replace=False)) for _ in range(400)], np.uint64)
    prints = items[rng.integers(0, 40, 400)] ^ flips
    got = set(zip(*(x.tolist() for x in op.Blocks(items, 18).find(prints))))
    assert got == {(a, b) for a in range(400) for b in range(40) if int(prints[a] ^ items[b]).bit_count() <= 18}


def test_empty_tables(spark):
    docs, items = made(1)
    assert run(spark, docs[:3], []) == [] and run(spark, [], items) == []
    assert op.matches(pa.array([], pa.string()), op.Benchmark(items[:3])) == []


def test_repeated_benchmark_rows_change_nothing(spark, monkeypatch):
    text = [f"w{i}" for i in range(60)]
    doc = " ".join(["before", *text[:30], "other", *text[31:], "after"])
    once = run(spark, [(1, doc)], [(0, " ".join(text))])
    assert len(once) == 1
    items = [(i, (" ", ", ", "\n", " - ", ". ")[i].join(text)) for i in range(5)]
    for held in (1 << 24, 300):
        monkeypatch.setattr(op, "SLICE_BYTES", held)
        got = run(spark, [(1, doc)], items + items[:2])
        assert {(d, i) for d, i, _ in got} == {(1, i) for i in range(5)} and {x for *_, x in got} == {once[0][2]}


def test_slices_change_nothing_beside_shared_shingles(spark, monkeypatch):
    line = [f"common{i}" for i in range(12)]
    items = [(i, " ".join([*(f"w{i}x{j}" for j in range(60)), *(line if i else [])])) for i in range(9)]
    docs = [(1, " ".join([*items[0][1].split()[:54], *line])), (2, " ".join([*line, *items[0][1].split()[6:]])), (3, " ".join([*items[1][1].split()[:66], *line]))]
    whole = run(spark, docs, items)
    assert {d for d, *_ in whole} == {1, 2, 3}
    monkeypatch.setattr(op, "SLICE_BYTES", 200)  # an item or two a slice
    assert run(spark, docs, items) == whole


def swapped(n=120, own=100):
    """Items of two families, each with a long line that its family shares; documents that hold an item's own words within the other family's line."""
    lines = [[f"line{k}x{j}" for j in range(60)] for k in (0, 1)]
    items = [(i, " ".join([*lines[i % 2][:30], *(f"own{i}x{j}" for j in range(own)), *lines[i % 2][30:]])) for i in range(n)]
    docs = [(i, " ".join([*lines[1 - i % 2][:30], *(f"own{i}x{j}" for j in range(own)), *lines[1 - i % 2][30:]])) for i in range(0, n, 4)]
    return docs, items


def test_items_within_other_boilerplate_are_found(spark):
    docs, items = swapped()
    got, want = run(spark, docs, items), brute(docs, items)
    assert [x[:2] for x in got] == [x[:2] for x in want] and len(got) == 30


def test_fingerprints_lose_nothing_that_verification_accepts():
    """Recall is 1 on pairs about the bound, and under 5 % of all pairs are verified."""
    rng = random.Random(3)
    held = [(i, " ".join(f"w{rng.randrange(4000)}" for _ in range(rng.choice([20, 60, 150])))) for i in range(60)]
    bench = op.Benchmark(held)
    wanted = found = checked = pairs = 0
    for length, g, _, indexes, members in bench.groups:
        windows = []
        for m in members:
            w = held[m][1].split()
            for _ in range(20):
                v = list(w)
                at, n = rng.randrange(length), rng.randrange(length // 5)
                v[at : at + n] = [f"z{rng.randrange(10**6)}" for _ in range(len(v[at : at + n]))]
                windows.append(v)
        words = op.words_of(pa.array([" ".join(v) for v in windows]), op.LETTERS)
        grams = words.grams(g)
        runs = [grams[a : b - g + 1] for a, b in zip(words.first, words.first[1:])]
        got = set()
        for index, weights in zip(indexes, (lambda f: np.ones(len(f)), bench.weights)):
            prints = np.concatenate([op.simhash(f, weights(f)) for f in runs])
            got.update(zip(*(x.tolist() for x in index.find(prints))))
        pairs, checked = pairs + len(runs) * len(members), checked + len(got)
        for i, f in enumerate(runs):
            for j, m in enumerate(members):
                if bench.similarity(m, f) >= op.SIMILAR:
                    wanted, found = wanted + 1, found + ((i, j) in got)
    assert wanted > 300 and found == wanted and checked < 0.1 * pairs


def test_window_prints_are_those_of_the_multisets():
    rng = np.random.default_rng(4)
    features = rng.integers(0, 1 << 62, 40, dtype=np.uint64)[rng.integers(0, 40, 300)]
    weights = 1 / (1 + features % np.uint64(5)).astype(float)
    first = np.arange(0, 280)
    got = op.window_prints(features, weights, first, first + 20)
    want = np.concatenate([op.simhash(features[a : a + 20], weights[a : a + 20]) for a in first])
    assert np.bitwise_count(got ^ want).sum() <= 5  # rounding, where a sum is next to nothing
