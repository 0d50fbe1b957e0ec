import os
import random
import subprocess
import sys

import sentencepiece

from millrace.llm import token_counts as op

SCHEMA = "doc_id long, text string, TEXT string, n_tokens string"
EDGES = ["", " ", "   ", "a b", "  a  b ", "\na\n\n b\n", "\t\ta", "\n", " \n ", "a　b<s>x</s> <unk>", "x▁y ▁ z", "▁", "\x00a", "\r\n\r\n x\r", "\U0001f600 é́", "word" * 5000, "x " * 30000, None, "a b", "a b"]


def library(texts):
    model = sentencepiece.SentencePieceProcessor(model_file=op.model_path())
    return [len(model.encode(t or "")) for t in texts]


def test_counts_equal_the_library(spark):
    rng = random.Random(3)
    texts = EDGES + ["".join(rng.choice("ab \n\t▁é<s>.$\r") for _ in range(rng.randrange(60))) for _ in range(300)]
    df = spark.createDataFrame([(i if i != 3 else None, t, "x", "clash") for i, t in enumerate(texts)], SCHEMA)
    got = op.token_counts(df).collect()
    assert sorted((r.n_bytes, r.n_tokens) for r in got) == sorted((len((t or "").encode()), n) for t, n in zip(texts, library(texts)))
    assert sum(r.doc_id is None for r in got) == 1


def test_memo_limits_change_nothing(spark, monkeypatch):
    counter = op.PieceCounter(op.model_path())
    texts = [f"w{i} v{i % 7} {'z' * i}" for i in range(200)]
    want = counter.count(texts)
    monkeypatch.setattr(op, "MEMO", 20)
    again = op.PieceCounter(op.model_path())
    assert [again.count([t])[0] for t in texts] == want == library(texts)
    assert len(again.known) <= 40


def test_rare_pre_tokens_are_joined(spark, monkeypatch):
    """With no table, a small one or the whole one in the tasks the counts are the library's."""
    rng = random.Random(5)
    texts = EDGES + [" ".join(rng.choice(["the", "of", f"w{rng.randrange(400)}", "é\n"]) for _ in range(rng.randrange(80))) for _ in range(120)]
    df = spark.createDataFrame([(i, t, "x", "clash") for i, t in enumerate(texts)], SCHEMA).repartition(5)
    for most, gathered in ((0, 50), (30, 500), (10_000, 1 << 20)):
        monkeypatch.setattr(op, "GATHERED", gathered)
        got = {r.doc_id: r.n_tokens for r in op.token_counts(df, most=most).collect()}
        assert got == dict(enumerate(library(texts)))


def test_pre_tokens_that_share_a_hash_are_told_apart(tmp_path):
    # in a session of its own, whose workers have the weak hash
    code = """
from millrace.llm import token_counts as op
from pyspark import cloudpickle
import numpy as np
weak = lambda seen, start, end: (np.add.reduceat(np.append(seen, 0).astype(np.uint64), start) if len(start) else np.zeros(0, np.uint64)) % np.uint64(5)
op.span_hashes = weak
texts = ["b a", "a b", "ab cd ba dc", "the of", "", "dc dc  x"]
import pyarrow as pa
h = op.PreTokens(pa.array(texts)).hash
assert len(set(h.tolist())) <= 5
from pyspark.sql import SparkSession
cloudpickle.register_pickle_by_value(op)
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
import sentencepiece
model = sentencepiece.SentencePieceProcessor(model_file=op.model_path())
got = {r.doc_id: r.n_tokens for r in op.token_counts(df, most=2).collect()}
assert got == {i: len(model.encode(t)) for i, t in enumerate(texts)}, got
print("fine")
"""
    path = op.__file__.rsplit("/millrace/", 1)[0]
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=tmp_path, env=os.environ | {"PYTHONPATH": path})
    assert done.stdout.strip().endswith("fine"), done.stderr[-2000:]


def test_empty_table(spark):
    assert op.token_counts(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_on_all_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: n for r, n in zip(rows, library([r.text for r in rows]))}
    got = op.query(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: r.n_tokens for r in got} == want
    assert all(r.over_limit == (r.n_tokens > 4096) for r in got)
