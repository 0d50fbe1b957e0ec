import json
import os
import re
import subprocess

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import repo as R
from millrace.operators import surface
from millrace.report import repo as report
from millrace.report import symbol_map
from millrace.sources import files


def tree(root, held):
    for path, text in held.items():
        full = root / path
        full.parent.mkdir(parents=True, exist_ok=True)
        full.write_text(text) if isinstance(text, str) else full.write_bytes(text)
    return str(root)


@pytest.fixture(scope="module")
def untracked():
    old = os.environ.get("GIT_CEILING_DIRECTORIES")
    os.environ["GIT_CEILING_DIRECTORIES"] = "/tmp"
    yield
    os.environ.pop("GIT_CEILING_DIRECTORIES") if old is None else os.environ.update(GIT_CEILING_DIRECTORIES=old)


BODY = "\n".join(f"export function part{i}(a) {{ return a + {i}; }}" for i in range(40))
TREE = {
    "components/Button.tsx": "export const Button = 1;\n", "app/page.tsx": "import { Button } from '@/components/Button'\n", "lib/dead.ts": "export const dead = 1;\n",
    "tests/x.test.ts": "it();\n", "scripts/run.ts": "#!/usr/bin/env node\n", "scripts/old.ts": "run();\n", "lib/util.ts": "/**\n" + " * words here\n" * 15 + " */\nexport const util = 1;\n", "lib/util-user.ts": "import './util'\nexport const u = 1;\n",
    "lib/commented.py": "x = 1\n" + "# y = call(1)\n" * 12, "lib/near_a.ts": "import a from 'a';\n" + BODY, "lib/near_b.ts": "import b from 'b';\n\n" + BODY.replace("\n", "\n\n"),
    "docs/one.md": "Same words.\n" * 30, "docs/two.md": "Same words.\n" * 30, "lib/copy1.py": "value = 1\n" * 40, "lib/copy2.py": "value = 1\n" * 40, "a.log": "noise", "b.orig": "noise", "package-lock.json": "{}",
    "lib/made.ts": "// @generated\nimport '../lib/only_generated'\n", "lib/only_generated.ts": "export const g = 1;\n", "lib/min.js": "a" * 5000, ".cursor/rules/x.ts": "export const x = 1;\n", "tool.json": '{"run": "spawn spawned.js"}', "lib/spawned.js": "go();\n",
    "package.json": json.dumps({"scripts": {"test": "jest", "go": "node tools/started.js"}}), "tools/started.js": "go();\n", "lib/long.py": "z = 1\n" * 800, "bytes.py": b"a\xffb = 1\n", "node_modules/dep/index.js": "no",
}


def test_report(spark, tmp_path, untracked):
    got = report.report(spark, tree(tmp_path, TREE))
    by = {f["id"]: f for f in got["findings"]}
    orphans = set(by["orphan-modules"]["locations"])
    assert {"lib/dead.ts", "lib/long.py", "bytes.py"} <= orphans
    assert not orphans & {"components/Button.tsx", "app/page.tsx", "tests/x.test.ts", "scripts/run.ts", "lib/util.ts", "lib/only_generated.ts", "lib/spawned.js", "tools/started.js", "lib/made.ts", "lib/min.js", ".cursor/rules/x.ts"}
    assert by["unreferenced-scripts"]["locations"] == ["scripts/old.ts"]
    assert by["commented-out-code"]["locations"] == ["lib/commented.py"] and by["oversized-files"]["locations"] == ["lib/long.py (801 lines)"]
    assert by["duplicate-code"]["locations"] == ["lib/copy1.py"] and by["duplicate-docs"]["locations"] == ["docs/one.md"] and by["near-duplicate-code"]["locations"] == ["lib/near_a.ts"]
    assert by["junk-artifacts"]["severity"] == "medium" and by["junk-artifacts"]["locations"] == ["a.log", "b.orig"]
    s = got["summary"]
    assert s["files"] == len(TREE) - 1 and s["excluded_generated"] == 2 and s["duplicate_groups"] == 2 and s["junk_count"] == 4
    assert s["reclaimable_bytes"] == 10 + 360 + 400 and s["largest_file"] == "lib/min.js"
    ranks = [{"high": 3, "medium": 2, "low": 1, "info": 0}[f["severity"]] for f in got["findings"]]
    assert ranks == sorted(ranks, reverse=True)
    taken = min(30, 4 * 4) + min(18, 1.5 * len(orphans)) + min(16, 3 * 2) + min(12, 100 * 770 / s["bytes"])
    assert got["health_score"] == round(100 - taken, 1)


def test_uncommitted_work_is_no_orphan(spark, tmp_path):
    root = tree(tmp_path, {"lib/orphan.ts": "export const a = 1;\n", "lib/other.ts": "export const b = 1;\n"})
    git = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=x", "-c", "user.email=x@example.com", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "x")
    (tmp_path / "lib/orphan.ts").write_text("export const a = 2;\n")
    (tmp_path / "untracked.ts").write_text("export const c = 2;\n")
    assert files.tracked(root) == ["lib/orphan.ts", "lib/other.ts"] and files.changed(root) == {"lib/orphan.ts", "untracked.ts"}
    found = report.scan(files.tree(spark, root))
    assert [r.path for r in found.orphans.collect()] == ["lib/other.ts"]


def test_orphans_keep_a_hash_anti_join(spark):
    df = spark.createDataFrame([("a/b.ts", 10, "x", "d", False)], files.SCHEMA)
    found = R.features(df)
    plan = R.unreferenced(found, *R.references(found))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and plan.count("LeftAnti") >= 2


def test_classes(spark):
    held = {"app/x.test.tsx": R.TARGET, ".claude/skills/foo/a.py": R.VENDORED, "gen.ts": R.GENERATED, "min.js": R.GENERATED, "x.min.js": R.IGNORED, "vendor/a.py": R.IGNORED, "a.log": R.JUNK, ".DS_Store": R.JUNK, "big.py": R.UNREAD, "mine.skip": R.IGNORED, "img.png": R.IGNORED}
    texts = {"gen.ts": "// @generated", "min.js": "a" * 5000, "big.py": None}
    df = spark.createDataFrame([(p, 10, texts.get(p, "x = 1"), "d", False) for p in held], files.SCHEMA)
    assert {r.path: r["class"] for r in R.classified(df, ["*.skip"]).collect()} == held


def one(spark, column, **values):
    kinds = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], kinds).select(column.alias("x")).first().x


def test_references(spark):
    want = {"@/components/Button": "components/Button", "./a/b.tsx": "a/b", "react": None, "../../x/y.json": "x/y", "@scope/pkg": "scope/pkg", "a/b.py": "a/b.py", "/": None, "./": None, "a/.ts": "a/"}
    df = spark.createDataFrame([(k,) for k in want], "t string").select("t", T.normal_reference(F.col("t")).alias("n"))
    assert {r.t: r.n for r in df.collect()} == want
    pairs = [("src/components/ui/Button", "components/ui/Button", True), ("src/other/Button", "a/Button", False), ("b/Button", "x/b/Button", True), ("Button", "ui/Button", True), ("xButton", "Button", False)]
    got = spark.createDataFrame(pairs, "p string, n string, want boolean").select("want", R.resolves(F.col("p"), F.col("n")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_paths(spark):
    paths = ["a/b/c.tar.gz", "x", ".bashrc", "d/.env.local", "d/e.", "A.TS", "d.e/f"]
    df = spark.createDataFrame([(p,) for p in paths], "p string").select("p", T.suffix_of(F.col("p")).alias("s"), T.stem_of(F.col("p")).alias("t"), T.area_of(F.col("p")).alias("a"), T.folder_of(F.col("p")).alias("f"))
    got = {r.p: (r.s, r.t, r.a, r.f) for r in df.collect()}
    assert got["a/b/c.tar.gz"] == (".gz", "c.tar", "a", "a/b") and got["x"] == ("", "x", ".", ".") and got[".bashrc"] == ("", ".bashrc", ".", ".")
    assert got["d/.env.local"][:2] == (".local", ".env") and got["A.TS"][0] == ".ts" and got["d.e/f"][0] == ""


LINES = st.lists(st.sampled_from(["", "  ", "// x = 1", "# call()", "#", "* doc", "/* c */", "import x", "from a", "export { a }", "Code  Line", "\tcode\t", "é"]), max_size=12)


@settings(max_examples=25, deadline=None)
@given(st.lists(LINES, min_size=1, max_size=6), st.sampled_from(["\n", "\r\n", "\x0b", "\u2028", " "]))
def test_line_rules_equal_plain_statements(spark, groups, end):
    texts = [end.join(g) for g in groups]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = df.select("i", T.normal_source(F.col("t")).alias("n"), T.dead_code_run(F.col("t")).alias("d"), T.line_count(F.col("t")).alias("c"), T.longest_line(F.col("t")).alias("l")).collect()
    for r in got:
        lines = texts[r.i].splitlines()
        kept = [" ".join(x.split()).lower() for x in lines if x.strip() and not re.match(r"(//|#|\*|/\*|import |export \{|from )", x.strip())]
        runs = "".join("1" if re.match(r"\s*(//|#)\s*[\w{}()\[\];=<>.\"'`]", x) else "0" for x in lines)
        assert (r.n, r.d, r.c, r.l) == ("\n".join(kept), max(map(len, runs.split("0"))), texts[r.i].count("\n") + 1, max(map(len, lines), default=0))


def test_empty_tree(spark, tmp_path, untracked):
    got = report.report(spark, str(tmp_path))
    assert got["summary"]["files"] == 0 and got["findings"] == []


PY = '''"""Sluices and gates.

Second line."""
import dataclasses

@dataclasses.dataclass(order=True)
class Sluice:
    width: float
    depth: float = 1.0
    label = "no field"

    def flow(self, speed, /, *, unit="m3"): ...

class Gate:
    open_by: str
    def lift(self, *cranks): ...
    def _jam(self): ...

class Weir:
    crest: int = 0

class Empty(Gate):
    pass

class _Sealed: ...

async def drain(pond, until=None, **how): ...
def _leak(): ...
'''


def surface_of(spark, text):
    r = spark.createDataFrame([(text,)], "t string").select(surface.python_symbols(F.col("t")).alias("s")).first().s
    return r.summary, list(r.symbols)


def test_python_surface(spark):
    assert surface_of(spark, PY) == ("Sluices and gates", ["`Sluice(width, depth=...)`: `flow(speed, unit=...)`", "`Gate`: `lift(*cranks)`", "`Weir(crest=...)`", "`Empty`", "`drain(pond, until=..., **how)`"])
    assert surface_of(spark, "def (") == ("", []) == surface_of(spark, "") == surface_of(spark, None)
    many = "class A:\n" + "\n".join(f"    f{i}: int" for i in range(12))
    assert surface_of(spark, many)[1] == ["`A(" + ", ".join(f"f{i}" for i in range(10)) + ", ...)`"]
    rows = surface.python_rows("class A:\n    def m(cls, b=1): ...\n")["symbols"]
    assert rows == [{"name": "A", "kind": "class", "parameters": [], "methods": [{"name": "m", "parameters": [{"name": "cls", "kind": "plain", "optional": False}, {"name": "b", "kind": "plain", "optional": True}]}]}]


def test_map(spark, tmp_path, untracked):
    held = {f"pkg/m{i:02d}.py": f'"""Module {i}."""\ndef f{i}(): ...\n' for i in range(8)}
    held |= {"scripts/last.py": "def go(): ...\n", "tests/test_a.py": "def test_x(): ...\n", ".verify/check.py": "def secret(): ...\n", "gen.py": "# @generated\ndef g(): ...\n", "web/a.ts": "// Buttons.\nexport default async function Go() {}\nexport const x = 1\nexport const x = 2\n", "m/a.go": "package m\ntype T struct{}\nfunc (t T) Run() {}\nfunc low() {}\n", "r/a.rs": "/* Core */\npub fn go() {}\npub struct S;\n"}
    held["many.py"] = "".join(f"def f{i}(): ...\n" for i in range(20))
    m = symbol_map.build(spark, tree(tmp_path, held), 10)
    assert [x["path"] for x in m["modules"]] == ["many.py", "m/a.go", *[f"pkg/m{i:02d}.py" for i in range(8)]] and m["truncated"] == 4
    whole = {x["path"]: x for x in symbol_map.build(spark, str(tmp_path), 99)["modules"]}
    assert whole["web/a.ts"] == {"path": "web/a.ts", "summary": "Buttons", "symbols": ["`Go`", "`x`"]} and whole["m/a.go"]["symbols"] == ["`T`", "`Run`"] and whole["r/a.rs"]["symbols"] == ["`go`", "`S`"] and whole["r/a.rs"]["summary"] == "Core"
    assert whole["tests/test_a.py"]["summary"] == "test suite" and len(whole["many.py"]["symbols"]) == 15 and whole["many.py"]["symbols"][-1] == "`+6 more`"
    assert list(whole)[-2:] == ["tests/test_a.py", "scripts/last.py"] and m["verify_cmd"] == "python3 -m unittest discover -s tests -t . -q"
    assert "- `pkg/m00.py` — Module 0: `f0()`" in symbol_map.render(m) and "+4 more modules" in symbol_map.render(m)


@pytest.mark.parametrize(
    ("paths", "scripts", "pytest_", "want"),
    [(["go.mod", "a.py"], [], False, "go test ./..."), (["package.json"], ["lint", "test"], False, "npm test"), (["x"], ["lint"], False, "npm run lint"), (["Cargo.toml", "go.mod"], [], False, "cargo test"), (["a.py"], [], True, "pytest -q"), (["a.py", "conftest.py"], [], False, "pytest -q"), (["a.py"], [], False, "python3 -m unittest -q"), (["Makefile"], [], False, "make test"), ([], [], False, "")],
)
def test_verify_command(spark, paths, scripts, pytest_, want):
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert surface.verify_command(df, scripts, pytest_).first().command == want
