import json

import duckdb
import pytest

import __spark_entry__ as entry
from millrace import cli
from millrace.operators import experiments, findings
from millrace.plans import queries
from millrace.report import bundle as B
from millrace.report import formats, render
from millrace.report.budget import Budget, cap_for
from millrace.sources import experiments as runs
from pyspark.sql import functions as F
from tests import fixtures

SF = "/root/testdata/sf0.001"


def plain(v):
    return str(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else float(v) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    at = [want.columns.index(c) for c in order]
    assert sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=str) == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)


@pytest.fixture(scope="module")
def ties(tmp_path_factory, duck):
    """A session for each cache ratio of k / 20000: its rounding, or that of its score, is a tie or a bit off one for many."""
    at = str(tmp_path_factory.mktemp("ties"))
    made = "k AS l_orderkey, 18.0::DOUBLE AS l_extendedprice, (k + 0.5) / 360.0::DOUBLE AS l_discount, (19982 - k + 0.5) / 1000.0::DOUBLE AS l_tax"
    duck.sql(f"COPY (SELECT l.* REPLACE ({made}) FROM (SELECT * FROM lineitem LIMIT 1) l, range(19983) t(k)) TO '{at}/lineitem.parquet'")
    return at


@pytest.mark.parametrize("name", ["efficiency_grade", "cache_ratio_waste", "waste_scores"])
def test_ties_equal_sql(spark, ties, name):
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{ties}/lineitem.parquet'")
    want = con.sql(queries.SQL[name])
    got = [tuple(r) for r in queries.QUERIES[name](spark, ties).select(*want.columns).orderBy("session_id").collect()]
    assert len(got) == 19983 and got == sorted(want.fetchall())
    if name == "efficiency_grade":
        assert [got[k][1:] for k in (6350, 7650)] == [(59.0, "D"), (63.0, "C")]  # exactly 59.05 and 62.95


def test_grade_of_unknown_counts_equals_sql(spark, duck, tmp_path):
    made = ", ".join(f"CASE WHEN l_orderkey % {n} = 0 THEN NULL ELSE {c} END AS {c}" for n, c in ((7, "l_extendedprice"), (11, "l_discount"), (13, "l_tax"), (5, "l_quantity")))
    duck.sql(f"COPY (SELECT * REPLACE ({made}) FROM lineitem) TO '{tmp_path}/lineitem.parquet'")
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    got = [tuple(r) for r in queries.QUERIES["efficiency_grade"](spark, str(tmp_path)).select("session_id", "score", "grade").collect()]
    assert any(r[1] is None for r in got) and sorted(got) == sorted(con.sql(queries.SQL["efficiency_grade"]).fetchall())


def test_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and entry.entry(spark).count() == 12


def test_formats():
    assert [formats.human(n) for n in (0, 999, 1000, 1_500_000)] == ["0", "999", "1K", "2M"] and formats.human_tokens(1500) == "1.5K"
    assert [formats.size(n) for n in (10, 2048, 5 << 20)] == ["10B", "2.0KB", "5.0MB"] and formats.money(1234.5) == "$1,234.50"
    assert render.sparkline([1, 2, 3]) == "▁▄█" and render.sparkline([]) == "" and render.bar(1, 2, 4) == "██░░"


def test_budget_and_gate():
    b = Budget(100)
    assert b.charge(60) and not b.charge(60, "more") and b.remaining == 40 and b.allowance() == 26 and len(b.notes) == 1
    assert (cap_for("tokens"), cap_for("both"), cap_for("both", 500)) == (200_000, 400_000, 500)
    assert (B.gate("B", "A"), B.gate("B", "C"), B.gate("B", None), B.gate("·", "A"), B.gate("B", "q")) == (1, 0, 0, 0, 0)
    assert [B.grade(x) for x in (90, 89.9, 78, 62, 45, 44)] == ["A", "B", "B", "C", "D", "F"]


def test_merge_synthesis():
    bundle = {"findings": [{"id": "a", "severity": "low", "title": "old"}, {"id": "b", "severity": "high"}, {"severity": "info"}]}
    assert B.merge_synthesis(bundle, {"findings": [{"id": "a", "severity": "medium", "title": "new"}, "x", {"id": "c", "severity": "high"}]}) == 3
    assert [(f.get("id"), f.get("title")) for f in bundle["findings"]] == [("b", None), ("c", None), ("a", "new"), (None, None)]
    assert B.merge_synthesis(bundle, []) == 0 == B.merge_synthesis(bundle, {"x": 1})


def test_upsert_rank_and_budget(spark):
    base = spark.createDataFrame([("a", "old", 1), ("b", "keep", 2), (None, "n1", 3), (None, "n2", 4)], "id string, title string, pos int")
    extra = spark.createDataFrame([("c", "add", 1), ("a", "mid", 2), ("a", "new", 3)], "id string, title string, pos int")
    got = findings.upserted(base, extra).orderBy("side", "pos").collect()
    assert [(r.id, r.title) for r in got] == [("a", "new"), ("b", "keep"), (None, "n1"), (None, "n2"), ("c", "add")]
    rows = spark.createDataFrame([("x", "low", 5.0), ("y", "odd", 9.0), ("z", "high", None), ("w", "low", 5.0)], "id string, severity string, impact_usd double")
    assert [r.id for r in findings.ranked(findings.coerced(rows)).orderBy("rank").collect()] == ["z", "w", "x", "y"]
    costs = spark.createDataFrame([(i, c) for i, c in enumerate([5, 0, 7, 3, 9, 1])], "i long, cost long")
    assert [r.i for r in findings.within_budget(costs, "cost", [F.col("i")], 15).orderBy("i").collect()] == [0, 1, 2, 3]
    assert [r.spent for r in findings.prefix_sums(costs, "cost", "i", 3).orderBy("i").collect()] == [5, 5, 12, 15, 24, 25]
    few = spark.createDataFrame([(1, "t1"), (2, None), (3, "t3")], "i long, t string")
    assert findings.latest(few, "t", "i", 40).count() == 0 and findings.latest(few, "t", "i", 1, least=2).first().i == 3
    assert [(r.i, r.truncated) for r in findings.capped(costs, [F.col("i")], 2).collect()] == [(0, 4), (1, 4)]


def test_experiments(spark, tmp_path):
    rows = [{"task": t, "config": c, "rep": r, "total_tokens": n, "success": ok} for t, c, r, n, ok in (("a", "baseline", 0, 100, True), ("a", "baseline", 1, 200, True), ("a", "optimized", 0, 90, True), ("b", "baseline", 0, 50, True), ("c", "baseline", 0, 100, True), ("c", "optimized", 0, 60, False))]
    (tmp_path / "r.jsonl").write_text("\n".join(json.dumps(r) for r in [*rows, {"task": "a", "config": "baseline", "rep": 3, "error": "x"}]) + "\n\n")
    found = runs.runs(spark, str(tmp_path / "r.jsonl"), "bench")
    pairs = experiments.paired(found.where("error is null"))
    assert [(r.task, r.base_tokens, r.opt_tokens, r.save_pct, r.base_ok, r.opt_ok) for r in pairs.orderBy("task").collect()] == [("a", 150.0, 90.0, 40.0, 1.0, 1.0), ("c", 100.0, 60.0, 40.0, 1.0, 0.0)]
    total = experiments.overall(pairs).first()
    assert (total.save_pct, total.quality_held) == (40.0, False)
    ladder = [("T1", "x", "A", 0, False, 10, 1), ("T1", "x", "C", 0, True, 20, 1), ("T1", "x", "A", 0, False, 30, 2), ("T1", "y", "C", 0, True, 40, 3), ("T2", "x", "A", 0, True, 10, 1), ("T2", "x", "C", 0, False, 10, 1), ("T3", "x", "A", 0, True, 1, 1)]
    df = spark.createDataFrame(ladder, "tier string, task string, arm string, rep int, ok boolean, tokens bigint, pos bigint")
    got = {r.tier: r for r in experiments.lift(df).collect()}
    assert (got["T1"].acc_a, got["T1"].acc_c, got["T1"].rescued, got["T1"].damaged, got["T1"].tokens_a) == (0.0, 1.0, 1, 0, 20.0) and set(got) == {"T1", "T2"}
    assert experiments.cap_tier(experiments.lift(df)).first().cap_tier == "T2"
    arms = spark.createDataFrame([("baseline", True, 100), ("gate", False, 150)], "arm string, ok boolean, tokens bigint")
    assert {r.arm: r.delta_pct for r in experiments.against_baseline(arms).collect()} == {"baseline": 0.0, "gate": 50.0}


def test_runs_are_in_file_order(spark, tmp_path):
    """Of runs that repeat a task the last by file, then line, counts, however the files are split."""
    line = lambda n, ok: json.dumps({"tier": "T1", "task": "x", "arm": "A", "rep": 0, "ok": ok, "tokens": n, "turns": 1})
    for name, oks in (("a", [True] * 300), ("b", [True] * 299 + [False])):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(line(i, ok) for i, ok in enumerate(oks)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = runs.runs(spark, str(tmp_path), "ladder")
        assert rows.rdd.getNumPartitions() > 4
        got = rows.orderBy("pos").select("tokens").collect()
        assert [r.tokens for r in got] == [*range(300)] * 2
        assert rows.agg(F.max_by("ok", "pos").alias("ok")).first().ok is False
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    root = str(fixtures.write(tmp_path / "projects"))
    out = tmp_path / "run"
    assert cli.main(["--projects-root", root, "--out", str(out), "--format", "json", "--fail-under", "F"]) == 0
    got = json.loads(capsys.readouterr().out)["verdict"]["grade"]
    assert got in "BCD" and sorted(p.name for p in out.iterdir()) == ["budget.json", "bundle.json", "digest.md", "report.md", "shards", "token_report.json"]
    saved = json.loads((out / "token_report.json").read_text())
    assert len(saved["per_session"]) == saved["totals"]["sessions"] == 12 and saved["per_session"][0]["waste_score"] >= 0
    assert len([p for p in (out / "shards").iterdir() if p.name.startswith("session-")]) == 12
    assert cli.main(["--projects-root", root, "--fail-under", "A", "--color", "never"]) == 1
    shown = capsys.readouterr()
    assert f"Grade {got}" in shown.out and "\x1b" not in shown.out and "under A" in shown.err
    (out / "synthesis.json").write_text(json.dumps([{"id": "mine", "severity": "high", "title": "Mine"}]))
    assert cli.main(["render", str(out / "bundle.json"), "--format", "markdown"]) == 0
    assert "### 1. [HIGH] Mine" in capsys.readouterr().out
    assert cli.main(["doctor", "--projects-root", root]) == 0 and f"{fixtures.PROJECTS[0]} ({fixtures.PER_PROJECT})" in capsys.readouterr().out
    assert cli.main(["--projects-root", str(tmp_path / "none")]) == 0 and "No sessions found" in capsys.readouterr().out
    monkeypatch.chdir(tmp_path)
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree" / "a.py").write_text("def f(x): ...\n")
    assert cli.main(["map", "--repo", "tree", "--out", "tree"]) == 0 and "`f(x)`" in (tmp_path / "tree" / "CLAUDE.md").read_text()
    assert cli.main(["extract", "--mode", "both", "--projects-root", root, "--repo", "tree"]) == 0 and (tmp_path / cli.RUN_FOLDER / "repo_report.json").exists()
