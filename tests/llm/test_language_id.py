import zlib

import numpy as np
import pyarrow as pa

from millrace.llm import language_id as op

SCHEMA = "doc_id long, text string, lang string, source string, LANG string"


def brute_vector(text):
    folded = "".join(c if c.isalpha() and c.isascii() or not c.isascii() else " " for c in text.lower()).encode()
    data, out = b" " + folded + b" ", np.zeros(op.DIM)
    for n, salt in op._SALT.items():
        for i in range(len(data) - n + 1):
            if data[i : i + 2] != b"  ":
                out[(int.from_bytes(data[i : i + n], "little") * int(salt) % 2**32) >> (32 - op.DIM_BITS)] += 1
    out = np.sqrt(out)
    return out / (np.linalg.norm(out) or 1)


def test_vectors_equal_brute_force():
    texts = ["", "Hello, World 12!", "É  é ß", None, "a", "xx " * 50]
    got = op.vectors(pa.array(texts))
    assert np.allclose(got, [brute_vector(t or "") for t in texts], atol=1e-5)


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = op.query(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(rows) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    right = [r.lang_pred == rows[r.doc_id].lang for r in got if r.held_out]
    assert np.mean(right) > 0.98


def test_nothing_is_learned_from_held_out_rows(spark):
    docs = [(i, "der und die nicht " * 5 if i % 2 else "le de que pour " * 5, "de" if i % 2 else "fr", "s", "x") for i in range(200)]
    changed = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else lang, s, x) for i, t, lang, s, x in docs]
    model = op.learned(spark.createDataFrame(changed, SCHEMA))
    assert sorted(x for own in model.families.values() for x in own) == ["de", "fr"]


def test_edges(spark):
    docs = [(i, "der und die nicht " * 5, "de", "s", "x") for i in range(20)] + [(i, "le de que pour " * 5, "fr", "s", "x") for i in range(20, 40)] + [(i, "los que las una", "es", None, "x") for i in range(60, 80)]
    docs += [(40, None, None, None, None), (41, "", "de", "s", None), (42, "123 !? \n", "de", "s", "x"), (None, "die und der", None, "s", "x"), (43, "и", None, "s", "x"), (1, "der und", "de", "s", "x"), (44, "die und der " * 40_000, None, "s", "x")]
    df = spark.createDataFrame(docs, SCHEMA)
    got = op.predicted(df, op.learned(df)).collect()
    by = {r.doc_id: r.lang_pred for r in got}
    assert len(got) == len(docs) and [by[i] for i in (40, 41, 42)] == ["und"] * 3 and by[None] == by[44] == "de" and by[43] != "und" and by[30] == "fr" and by[70] == "es"
    assert {r.lang_pred for r in op.predicted(df, None).collect()} == {"und"}
    assert op.predicted(df.limit(0), None).collect() == [] and op.learned(df.limit(0)) is None
    one = spark.createDataFrame(docs[:20], SCHEMA)
    assert {r.lang_pred for r in op.predicted(one, op.learned(one)).collect()} == {"de"}


def test_many_languages_and_repeated_rows(spark):
    """No number of languages is too many, and a row that is repeated counts once; the sample is as bounded as it says."""
    docs = [(i, f"{chr(0x4E00 + i)}{chr(0x5000 + i)} " * 6, f"x{i}", "s", "x") for i in range(80)] * 3
    model = op.learned(spark.createDataFrame(docs, SCHEMA))
    taught = {f"x{i}" for i in range(80) if zlib.crc32(str(i).encode()) % 4 != 2}
    assert {x for own in model.families.values() for x in own} == taught and len(taught) > 50
    rows = spark.createDataFrame([(i, f"{'ab' if i % 2 else 'cd'} {i}", "de" if i % 2 else "fr", "s", "x") for i in range(2000)], SCHEMA)
    sizes = []
    op_model, op.Model = op.Model, lambda x, langs: sizes.append(len(langs))
    try:
        op.fit(rows, sample=400)
        op.fit(rows, per_language=100)
    finally:
        op.Model = op_model
    assert all(100 < n < 500 for n in sizes) and sizes[0] > sizes[1]
