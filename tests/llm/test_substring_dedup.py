import hashlib
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa

from millrace.llm import substring_dedup as op
from millrace.llm.fm_index import Index

SCHEMA = "doc_id long, text string, Text string, spans string"


def brute(rows, window=13):
    texts = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (k, _), w in zip(rows, texts):
        for i in range(len(w) - window + 1):
            x = tuple(w[i : i + window])
            if k is not None:
                least[x] = min(least.get(x, k), k)
    out = []
    for (k, _), w in zip(rows, texts):
        gone = {j for i in range(len(w) - window + 1) if k is not None and least[tuple(w[i : i + window])] < k for j in range(i, i + window)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((-1 if k is None else k, len(w), len(gone), kept))
    return sorted(out)


def result(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept) for r in op.deduplicated(df).collect())


def made(seed, n=80):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "C", "é", "f,", "gg"]) + rng.choice(["", "x", "y"])
    parts = [[word() for _ in range(rng.randrange(1, 40))] for _ in range(12)] + [["z"] * 30]
    rows = []
    for _ in range(n):
        w = sum((rng.choice(parts) if rng.random() < 0.6 else [word() for _ in range(rng.randrange(30))] for _ in range(rng.randrange(5))), [])
        rows.append((rng.randrange(60) - 10, rng.choice([" ", "\n", "\t "]).join(w)))
    return rows + [(None, rows[-1][1]), (7, None), (8, ""), (9, " \n"), (100, "x " * 5000), (101, "x " * 5000), (102, "one two")]


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "x", "y") for k, t in rows], SCHEMA)


def test_equals_brute_force(spark):
    for seed in range(2):
        rows = made(seed)
        assert result(frame(spark, rows)) == brute(rows)
    assert op.deduplicated(frame(spark, [])).collect() == []


def test_hot_anchors_and_small_shards(spark, monkeypatch):
    monkeypatch.setattr(op, "SHARD_WORDS", 100)
    for hot in (0, 4):
        monkeypatch.setattr(op, "HOT", hot)
        rows = made(10 + hot)
        assert result(frame(spark, rows)) == brute(rows)


def test_index_counts_like_a_scan():
    rng = np.random.default_rng(2)
    for sigma in (1, 2, 5, 300):
        text = np.concatenate([np.append(rng.integers(1, sigma + 1, rng.integers(1, 30)), 0) for _ in range(20)]).astype(np.uint32)
        index = Index(text, 4)
        values = rng.integers(0, 1000, len(text))
        pats = rng.integers(1, sigma + 2, (50, 4)).astype(np.uint32)
        low, high = index.search(pats)
        for p, a, b in zip(pats, low, high):
            at = [i for i in range(len(text) - 3) if (text[i : i + 4] == p).all()]
            assert sorted(index.order[a:b]) == at
            if at:
                assert index.least(values, np.array([a]), np.array([b]))[0] == values[at].min()


def test_query_equals_sql(spark, tmp_path):
    rows = [(i, t) for i, (_, t) in enumerate(made(5))]
    (tmp_path / "sf").mkdir()
    pd.DataFrame(rows, columns=["doc_id", "text"]).to_parquet(tmp_path / "sf/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/sf/documents.parquet'")
    got = sorted(tuple(r) for r in op.query(spark, str(tmp_path / "sf")).collect())
    assert got == sorted(con.sql(op.SQL).fetchall())
    assert [g[3] for g in got] == [hashlib.sha256(k.encode()).hexdigest() for _, _, _, k in brute(rows)]


def test_words_with_equal_parts_of_their_hash_are_told_apart(spark):
    """Of 400,000 words some share 31 bits of their hash; windows that differ in such words aren't equal."""
    words = op.Words(*op.text_bytes(pa.array([" ".join(f"w{i}" for i in range(400_000))])))
    top = words.hash >> np.uint64(33)
    order = np.argsort(top, kind="stable")
    twins = [(f"w{a}", f"w{b}") for a, b in zip(order, order[1:]) if top[a] == top[b]]
    assert len(twins) > 10
    line = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(2 * i + j, f"{line} {w}") for i, pair in enumerate(twins[:10]) for j, w in enumerate(pair)]
    assert result(frame(spark, rows)) == brute(rows) == [(i, 13, 0, t) for i, t in rows]


def test_matches_of_foreign_streams():
    rng = np.random.default_rng(3)
    for _ in range(20):
        text = np.concatenate([np.append(rng.integers(1, 4, rng.integers(1, 20)), 0) for _ in range(10)]).astype(np.uint64)
        index, asked = Index(text, 4), rng.integers(1, 5, 40).astype(np.uint64)
        low, high = index.matching(index.codes(asked), np.array([0, 25, 30]), np.array([25, 30, 32]))
        got = [sorted(index.order[a:b].tolist()) for a, b in zip(low, high)]
        want = [[p for p in range(len(text) - 3) if (text[p : p + 4] == asked[i : i + 4]).all()] for a, b in ((0, 25), (25, 30), (30, 32)) for i in range(a, b - 3)]
        assert got == want


def test_words_are_sent_once_a_task_unless_a_smaller_document_has_them():
    sent = op.Sent(4)
    fresh = lambda segs, ids: sent.fresh(np.array(segs, np.uint64), np.array(ids, np.int64)).tolist()
    assert fresh([1, 2], [5, 5]) == [True, True] and fresh([1, 2], [5, 4]) == [False, True]
    assert fresh([6], [1]) == [True] and fresh([2], [4]) == [True]  # 6 took the slot of 2
