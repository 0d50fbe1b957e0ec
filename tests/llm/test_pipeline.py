import random
import re

import pandas as pd

import corpus_pipeline
from millrace.llm import decontaminate, language_id, mixing
from tests.llm import test_decontaminate, test_ngram_join, test_substring_dedup

GERMAN, FRENCH = "der die und nicht das ist ein auch mit sich".split(), "le la les des une que pour dans est pas".split()


def corpus(seed, n=90):
    rng = random.Random(seed)
    bench = [(i, " ".join(rng.choice(GERMAN) + str(rng.randrange(99)) for _ in range(30))) for i in range(4)]
    shared = " ".join(rng.choice(FRENCH) + rng.choice("abcdefgh") for _ in range(60))
    rows = []
    for i in range(n):
        words = rng.choice((GERMAN, FRENCH))
        text = " ".join(rng.choice(words) + rng.choice(["", "", "x", "yz", "q", "r"]) for _ in range(rng.randrange(5, 120)))
        if rng.random() < 0.15:
            text += " " + rng.choice(bench)[1] + " ende"
        if rng.random() < 0.2:
            text = f"{text} {shared} fin {i}"
        if rows and rng.random() < 0.2:
            text = rng.choice(rows)[1] + rng.choice(["", " noch"])
        if rng.random() < 0.2:
            text += " idiot"
        rows.append((i, text, "de" if words is GERMAN else "fr", f"s{i % 3}", len(text)))
    rows += [(n, "12 ## 3", None, "s", 7), (n + 1, None, None, None, None), (n + 2, "", "de", "s", 0), (n + 3, "der die und", None, "s", 11)]
    return rows, bench


def test_stages_equal_brute_force(spark, tmp_path):
    rows, bench = corpus(1)
    sf = tmp_path / "sf"
    sf.mkdir()
    pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"n_chars": "Int64"}).to_parquet(sf / "documents.parquet")
    pd.DataFrame(bench, columns=["item_id", "text"]).to_parquet(sf / "benchmark.parquet")
    labels = [(i, int(len(t) > 200), int("idiot" in t)) for i, t, *_ in rows[:90]]
    pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]).to_parquet(sf / "labels.parquet")

    docs = spark.read.parquet(str(sf / "documents.parquet"))
    columns = docs.columns
    want = {r[0]: r for r in rows}
    model = language_id.learned(docs)
    for step, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(sf))
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        got = {r.doc_id: r for r in docs.collect()}
        pairs = [(i, r[1]) for i, r in want.items()]
        if step == 0:  # what has no letter goes, and no more
            want = {i: (i, t, lang or "de", s, n) for i, (_, t, lang, s, n) in want.items() if t and re.search("[a-z]", t)}
            assert model is not None and got[93].lang == "de"
        elif step == 1:
            want = {i: want[i] for i, _, c in test_ngram_join.brute(pairs) if i == c}
        elif step == 2:
            left = {i: (n, gone, kept) for i, n, gone, kept in test_substring_dedup.brute(pairs)}
            want = {i: (i, left[i][2], r[2], r[3], len(left[i][2])) if left[i][1] else r for i, r in want.items() if not left[i][1] or left[i][1] < left[i][0]}
        elif step == 3:
            leaks = {d for d, _, _ in test_decontaminate.brute(pairs, bench)}
            assert leaks
            want = {i: r for i, r in want.items() if i not in leaks}
        if step < 4:
            assert docs.columns == columns
            assert {i: tuple(r) for i, r in got.items()} == want, name
    assert set(got) <= set(want) and all(r.rate > 0 for r in got.values())
    clean = [i for i, r in want.items() if "idiot" not in r[1]]
    assert sum(i in got for i in clean) >= 0.95 * len(clean)
    assert decontaminate.SIMILAR == 0.8 and mixing.TARGETS["toxic"] == 0


def test_empty_documents(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_take_odd_tables(spark, tmp_path):
    """Null ids, repeated rows, nulls everywhere, a very long text, and columns named as what the operators make."""
    kinds = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double, kept string, spans string, matches string, row long, rate double, id long"
    more = ("x", 0.5, "y", "z", "m", 7, 0.25, 9)
    base = "der die und nicht das ist ein auch mit sich "
    rows = [(i, f"{base}{i} " * (1 + i % 3), "de", "s", 9, *more) for i in range(12)] + [(i, f"le la les des une que pour {i}", "fr", "s", 9, *more) for i in range(20, 30)]
    rows += [(None, base * 2, None, None, None, *[None] * 8), (None, base * 2, None, None, None, *[None] * 8), (3, "repeated le la les", "fr", "s", 9, *more), (40, None, None, None, None, *[None] * 8), (41, "und " * 50_000, "de", "s", 9, *more)]
    spark.createDataFrame([(0, "der die und x y z")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(0, 1, 0), (1, 0, 0), (21, 1, 0), (None, 1, 1), (22, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, kinds)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert sum(r.doc_id is None for r in docs.collect()) == 2 and {r.lang_pred for r in docs.collect()} == {"x", None}, name
    out = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sum(r.doc_id is None for r in out) == 2 and all(r.rate > 0 for r in out)
