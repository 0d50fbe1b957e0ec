import json
import os

import pytest
from pyspark.sql import functions as F

from millrace.functions.usage import Price
from millrace.operators import rules, sessions
from millrace.report import bundle as B
from millrace.report import tokens
from millrace.sources import transcripts
from tests import fixtures

PLAIN = {k: fixtures.plain(v) for k, v in fixtures.every().items()}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    return str(fixtures.write(tmp_path_factory.mktemp("logs") / "projects"))


@pytest.fixture(scope="module")
def metrics(spark, root):
    return tokens.load(spark, root).cache()


def test_sessions_of_equal_names_stay_apart(metrics):
    got = {(r.path.split("/")[-2], r.session_id): r for r in metrics.collect()}
    assert set(got) == set(PLAIN) and len(PLAIN) == 12
    for key, want in PLAIN.items():
        r = got[key].asDict()
        same = ("turns", "assistant_turns", "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "tool_calls", "tool_errors", "denial_ratio", "big_outputs", "compactions", "reread_files", "repeated_cmds", "tool_histogram", "waste_score", "branch", "repo", "version", "started", "ended")
        assert {k: r[k] for k in same} == {k: want[k] for k in same}, key
        assert r["cache_hit_ratio"] == round(want["ratio"], 4)
        assert float(r["est_cost_usd"]) == pytest.approx(want["cost"], abs=1e-4) and float(r["cache_waste_usd"]) == pytest.approx(want["waste"], abs=1e-4)


def test_report(spark, metrics):
    got = tokens.report(metrics)
    total = got["totals"]
    i, o, r, w = (sum(p[f"{x}_tokens"] for p in PLAIN.values()) for x in ("input", "output", "cache_read", "cache_creation"))
    assert (total["sessions"], total["input_tokens"], total["output_tokens"], total["cache_read_tokens"], total["cache_creation_tokens"]) == (12, i, o, r, w)
    assert total["overall_cache_hit_ratio"] == round(r / (i + r + w), 4)
    assert total["est_total_cost_usd"] == pytest.approx(sum(p["cost"] for p in PLAIN.values()), abs=0.02)
    assert [s["waste_score"] for s in got["worst_sessions"]] == sorted((p["waste_score"] for p in PLAIN.values()), reverse=True)
    assert len(got["trend"]) == 12 and got["repos"] == ["/srv/0", "/srv/1", "/srv/2"]
    again = [p for p in PLAIN.values() if p["reread_files"]]
    own = sum(p["input_tokens"] + p["cache_read_tokens"] + p["cache_creation_tokens"] for p in again)
    p = got["projection"]
    assert (p["map_eligible_sessions"], p["eligible_context_tokens"], p["map_tokens_low"], p["map_tokens_high"]) == (len(again), own, round(own * 0.41), round(own * 0.47))
    page = B.token_bundle(got)
    share = min(1, total["reclaimable_cache_usd"] / total["est_total_cost_usd"])
    assert page["verdict"]["grade"] == B.grade(100 * (0.6 * total["overall_cache_hit_ratio"] + 0.4 * (1 - share)))
    assert len(page["charts"][0]["rows"]) == 8 and page["trend"]["values"] == got["trend"]
    assert [s["session_id"] for s in tokens.every_session(metrics)] and len(list(tokens.every_session(metrics))) == 12


def test_findings_follow_the_rules(spark, metrics):
    got = {r.id: r for r in rules.token_findings(metrics, [F.col("path")]).collect()}
    held = [PLAIN[k] for k in sorted(PLAIN, key=lambda k: f"{k[0]}/{k[1]}")]
    waste, ratio = sum(round(p["waste"], 4) for p in held), sum(p["cache_read_tokens"] for p in held) / sum(p["input_tokens"] + p["cache_read_tokens"] + p["cache_creation_tokens"] for p in held)
    assert got["cache-hit-ratio"].severity == ("low" if ratio >= 0.55 else "high" if waste >= 1 else "medium") and got["cache-hit-ratio"].impact_usd == pytest.approx(waste, abs=0.011)
    again = [p for p in held if p["reread_files"]]
    extra = sum(n - 1 for p in again[:5] for n in sorted(p["reread_files"].values(), reverse=True)[:2])
    assert got["file-reread-churn"].evidence.startswith(f"{len(again)} session") and got["file-reread-churn"].impact_usd == round(1000 * extra * 3 / 1e6, 2)
    for id_, n in (("oversized-tool-output", sum(p["big_outputs"] for p in held)), ("command-retry-loops", sum(bool(p["repeated_cmds"]) for p in held)), ("permission-and-error-friction", sum(p["denial_ratio"] > 0.04 for p in held)), ("context-thrash", sum(p["compactions"] >= 2 for p in held))):
        assert (id_ in got) == (n > 0) and (not n or got[id_].evidence.startswith(f"{n} "))
    assert rules.token_findings(metrics.limit(0)).collect() == []


def test_a_limit_or_a_project_reads_no_other_log(spark, root):
    for n, (project, name) in enumerate(sorted(PLAIN)):
        os.utime(f"{root}/{project}/{name}.jsonl", (10_000 + n,) * 2)
    newest = sorted(PLAIN)[-1]
    files, found = transcripts.load(spark, root, limit=1)
    assert [(r.project, r.session_id) for r in files.collect()] == [newest]
    assert [f.rsplit("/", 1)[-1].replace("%20", " ") for f in found.inputFiles()] == [f"{newest[1]}.jsonl"]
    assert tokens.load(spark, root, limit=3).count() == 3
    files, found = transcripts.load(spark, root, project="/srv/loom")
    assert files.count() == 6 and all("loom" in f for f in found.inputFiles()) and len(found.inputFiles()) == 6
    strange = tokens.load(spark, root, project="/srv/my mill%20#1")
    assert {(r.path.split("/")[-2], r.session_id) for r in strange.collect()} == {k for k in PLAIN if k[0] == fixtures.PROJECTS[0]}
    assert tokens.load(spark, root, project="/nowhere").count() == 0 and tokens.load(spark, root, since_days=1).count() == 0
    os.utime(f"{root}/{newest[0]}/{newest[1]}.jsonl")
    assert [r.session_id for r in tokens.load(spark, root, since_days=1).collect()] == [newest[1]]


def test_totals_and_savings_operators_agree_with_the_report(spark, metrics):
    report = tokens.report(metrics)
    t = sessions.totals(metrics).first().asDict()
    assert t == {k: report["totals"][k] for k in t}
    s = sessions.savings(metrics).first().asDict()
    assert {k: s[k] for k in s} == {k: report["projection"][k] for k in s}


def test_parser_edges(spark, tmp_path):
    folder = tmp_path / "p" / "x"
    folder.mkdir(parents=True)
    use = lambda **u: {"type": "assistant", "message": {"content": "hello", "usage": u}}
    lines = [
        "not json", "", "   ", "[1,2]", "7", json.dumps({"type": "system", "cwd": "/w", "gitBranch": "old", "version": "9", "timestamp": "t0"}),
        json.dumps(use(input_tokens="12", output_tokens=1.9, cache_read_input_tokens=True)), json.dumps({"type": "assistant", "message": {"content": None}}),
        json.dumps({"type": "assistant", "message": "text"}), json.dumps({"type": "user", "message": {"content": [{"type": "tool_result", "content": [{"text": "abc"}, {"text": None}, 7]}, {"type": "tool_result", "content": 5}, {"type": "tool_result", "content": "four", "is_error": True}, "x"]}}),
        json.dumps({"type": "assistant", "gitBranch": "new", "timestamp": "t1", "message": {"content": [{"type": "tool_use", "input": {"command": "a"}}, {"type": "tool_use", "name": "Bash", "input": {"command": " ls   -l "}}, {"type": "thinking", "thinking": "hmm"}, {"type": "text", "text": "é"}]}}),
        '{"type":"user","type":"assistant","message":{"content":"dup"}}',
    ]
    (folder / "s1.jsonl").write_text("\n".join(lines) + "\n")
    (folder / "s2.jsonl").write_text('{"type":"system"}\n')
    (folder / "other.txt").write_text("{}")
    found = transcripts.events(spark, str(tmp_path / "p"))
    rows = {tuple(r.seq): r for r in transcripts.turns(found).collect()}
    turns = [rows[k] for k in sorted(rows)]
    assert [t.role for t in turns] == ["assistant", "assistant", "user", "assistant", "assistant"]
    assert (turns[0].input_tokens, turns[0].output_tokens, turns[0].cache_read_tokens, turns[0].text_chars) == (12, 1, 1, 5)
    assert (list(turns[2].tool_result_chars), turns[2].tool_errors) == ([3, 4], 1)
    assert [(c.name, c.command) for c in turns[3].tool_calls] == [("unknown", "a"), ("Bash", " ls   -l ")]
    assert (turns[3].thinking_chars, turns[3].text_chars) == (3, 1)
    metrics = {r.session_id: r for r in sessions.session_metrics(transcripts.turns(found), transcripts.session_attributes(found), Price()).collect()}
    assert list(metrics) == ["s1"]  # a session without turns is none
    m = metrics["s1"]
    assert (m.repo, m.branch, m.version, m.started, m.ended, m.tool_calls, dict(m.tool_histogram)) == ("/w", "new", "9", "t0", "t1", 2, {"Bash": 1, "unknown": 1})


def test_listing_filters(spark, tmp_path):
    root = tmp_path / "p"
    for n, (project, age) in enumerate((("-w-app", 0), ("-w-app2", 86400 * 3), ("-w-other", 86400 * 9))):
        (root / project / "deep").mkdir(parents=True)
        (root / project / "deep" / "no.jsonl").write_text("{}\n")
        f = root / project / f"s{n}.jsonl"
        f.write_text("{}\n")
        os.utime(f, (f.stat().st_mtime - age,) * 2)
    names = lambda **k: sorted(r.session_id for r in transcripts.listing(spark, str(root), **k).collect())
    assert names() == ["s0", "s1", "s2"] == names(limit=0)
    assert names(limit=2) == ["s0", "s1"] and names(since_days=5) == ["s0", "s1"] and names(project="/w/app") == ["s0", "s1"] and names(project="/w/other") == ["s2"]


def test_stream_sums_equal_batch(spark, root, tmp_path):
    from millrace.streaming import usage as stream

    query = stream.session_usage(stream.events(spark, root)).writeStream.outputMode("complete").format("memory").queryName("usage_now").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {tuple(r) for r in spark.table("usage_now").collect()}
    want = {tuple(r) for r in sessions.token_sums(transcripts.turns(transcripts.events(spark, root)), ["path"]).collect()}
    assert got == want and len(got) == 12
    hours = stream.windowed_usage(stream.events(spark, root)).writeStream.outputMode("append").format("memory").queryName("hours").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    hours.awaitTermination()
    assert spark.table("hours").count() == 0  # the watermark hasn't passed any hour
