import hashlib
import random
import re

from pyspark.sql import functions as F

from millrace.llm import fingerprints as op

SCHEMA = "doc_id long, text string, Text string, n_chars string"


def units(t):
    return {p for p in re.split(r"\n+|(?<=[.!?])[ \t]+", t) if p.strip(" ")}


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    """(key, n_chars, sha256 of the edited text, likeness to it and to the next text) by set operations."""
    rows = [(k, t or "") for k, t in rows]
    out = []
    for i, (k, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + after[:half]
        out.append((k, len(t), hashlib.sha256(e.encode()).hexdigest(), round(likeness(units(t), units(e)), 9), round(likeness(units(t), units(after)), 9)))
    return out


def result(df):
    rows = op.compared(df).collect()
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in rows), key=str), rows


def made(seed, n=60):
    rng = random.Random(seed)
    word = lambda: rng.choice(["of", "a", "é", "\U0001f600"]) + rng.choice(["", "x", "yy", "ing"])
    lines = [" ".join(word() for _ in range(rng.randrange(1, 12))) + rng.choice([".", "", "!", ","]) for _ in range(60)]
    rows = [(i * 7 - 20, rng.choice(["\n", " ", "\n\n"]).join(rng.choice(lines) for _ in range(rng.choice([0, 1, 2, 10, 40, 90])))) for i in range(n)]
    return rows + [(5000, None), (5001, ""), (5002, " \n "), (6000, "word"), (6001, "x. " * 4000)]


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "c", "d") for k, t in rows], SCHEMA)


def test_equals_set_operations(spark, monkeypatch):
    for rows_ in (2000, 3):
        monkeypatch.setattr(op, "ROWS", rows_)
        rows = made(rows_)
        want = brute(sorted(rows, key=lambda r: -r[0]))
        assert result(frame(spark, rows))[0] == sorted(want, key=str)


def test_fingerprints(spark):
    text = "one two three. four five\nsix"
    _, rows = result(frame(spark, [(1, text), (2, text), (3, text + "!"), (4, "abab"), (5, "abab")]))
    by = {r.doc_id: r for r in rows}
    assert by[1].fingerprint == by[2].fingerprint != by[3].fingerprint and by[4].fingerprint == by[5].fingerprint == by[5].edited_fingerprint
    assert by[5].near_edited == by[5].near_next == 1


def test_edges(spark):
    assert result(frame(spark, []))[0] == []
    assert result(frame(spark, [(3, "a b c d")]))[0] == [r for r in brute([(3, "a b c d")])]
    got, _ = result(frame(spark, [(1, "a b"), (1, "a b"), (None, "c d"), (None, None), (2, "e f")]))
    assert sorted((str(k), n) for k, n, *_ in got) == [("1", 3), ("1", 3), ("2", 3), ("None", 0), ("None", 3)]


def test_peeling_and_failure(spark):
    rng = random.Random(2)
    rows = []
    for i, n in enumerate((1, 3, 10, 40, 200, 2000)):
        both = [rng.getrandbits(62) for _ in range(30)]
        rows.append((i, both + [rng.getrandbits(62) for _ in range(n)], both + [rng.getrandbits(62) for _ in range(n // 2)], n + n // 2))
    df = spark.createDataFrame(rows, "k long, x array<long>, y array<long>, want long")
    got = {r.k: (r.found, r.left) for r in op.differing(df.select("k", "x", "y"), ["k"], 4, 18).collect()}
    assert got == {i: (w, 0) for i, _, _, w in rows}
    few = op.differing(df.where("k = 5").select("k", "x", "y"), ["k"], 4, 1).first()
    assert few.left > 0 and few.found < 3000  # too few passes: told apart from a right answer


def test_retries_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(op, "THIRD", 1)
    monkeypatch.setattr(op, "PASSES", 6)
    rows = made(4)
    assert result(frame(spark, rows))[0] == sorted(brute(sorted(rows, key=lambda r: -r[0])), key=str)


def read(fingerprint):
    """The number of digests and the cells of a reported fingerprint."""
    _, n, held = fingerprint.split(":")
    return int(n, 16), [(int(held[i : i + 4], 16), int(held[i + 4 : i + 20], 16), int(held[i + 20 : i + 28], 16)) for i in range(0, len(held), 28)]


def recomputed(spark, a, b):
    """The likeness of two reported fingerprints, by subtracting and peeling their cells in plain Python; None where they don't peel."""
    (na, x), (nb, y) = read(a), read(b)
    cells = [[p[0] - q[0], p[1] ^ q[1], p[2] ^ q[2]] for p, q in zip(x, y)]
    signed = lambda d: d - (1 << 64) if d >> 63 else d
    found = 0
    while True:
        held = sorted({signed(c[1]) for c in cells if abs(c[0]) == 1})
        known = spark.createDataFrame([(d,) for d in held], "d long").select("d", op._check(F.col("d")).alias("c"), op._mask(F.col("d")).alias("m")).collect()
        by = {r.d: r for r in known}
        single = next(((c[0], by[signed(c[1])]) for c in cells if abs(c[0]) == 1 and c[2] == by[signed(c[1])].c), None)
        if single is None:
            return None if any(any(c) for c in cells) else (na + nb - found) / (na + nb + found) if na + nb else 1.0
        n, r = single
        for i in range(len(cells)):
            if r.m >> i & 1:
                cells[i] = [cells[i][0] - n, cells[i][1] ^ (r.d % (1 << 64)), cells[i][2] ^ r.c]
        found += 1


def test_likenesses_are_those_of_the_reported_fingerprints(spark):
    lines = [f"line {i} of it." for i in range(40)]
    texts = [" ".join(lines[a:b]) for a, b in ((0, 6), (2, 9), (0, 6), (20, 32), (21, 30))] + ["", None]
    rows = {r.doc_id: r for r in op.compared(frame(spark, list(enumerate(texts)))).collect()}
    for i, r in rows.items():
        assert recomputed(spark, r.fingerprint, r.edited_fingerprint) == r.near_edited, i
        assert recomputed(spark, r.fingerprint, rows[(i - 1) % len(texts)].fingerprint) == r.near_next, i


def test_what_a_fingerprint_cannot_hold_is_sized_by_what_it_lets_expect(spark):
    rng = random.Random(7)
    rows = [(i, [rng.getrandbits(62) for _ in range(n)], [rng.getrandbits(62) for _ in range(m)]) for i, (n, m) in enumerate(((5, 5), (100, 80), (1000, 10), (400, 1200)))]
    df = spark.createDataFrame(rows, "k long, x array<long>, y array<long>")
    both = df.select("k", op.less(op.cells(F.col("x")), op.cells(F.col("y"))).alias("z"), F.size("x").alias("n"), F.size("y").alias("m"))
    got = {r.k: r for r in both.select("k", op.expected(F.col("z"), F.col("n"), F.col("m")).alias("much"), op.peeled_cells(F.col("z"), op.PASSES).alias("p")).collect()}
    assert got[0].p.whole and got[0].p.found == 10 and not any(got[k].p.whole for k in (1, 2, 3))
    assert all(0.4 < got[k].much / (len(rows[k][1]) + len(rows[k][2])) < 2 for k in (1, 2, 3))


def test_no_python_in_the_plan(spark):
    plan = op.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "MapIn"))
