"""Command line: analyze (the default), extract, render, doctor, map, bench."""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.usage import Price
from millrace.operators import experiments
from millrace.report import bundle as B
from millrace.report import render, repo, symbol_map, tokens
from millrace.report.budget import Budget, cap_for
from millrace.sources import experiments as runs
from millrace.sources import transcripts

VERSION = "0.1.0"
COMMANDS = ("analyze", "extract", "render", "doctor", "map", "bench")


def session() -> SparkSession:
    """The running session as it is, or a local one. Repeated keys in a log line take the last value, which is set before it starts."""
    if (running := SparkSession.getActiveSession()) is not None:
        return running
    builder = SparkSession.builder.appName("millrace").config("spark.sql.variant.allowDuplicateKeys", "true").config("spark.ui.showConsoleProgress", "false")
    if "SPARK_MASTER" not in os.environ and not os.environ.get("MASTER"):
        builder = builder.master("local[*]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _emit(args: argparse.Namespace, bundle: dict) -> None:
    if args.format == "json":
        print(json.dumps(bundle, indent=2, default=str))
    elif args.format == "markdown":
        print(render.markdown(bundle))
    else:
        print(render.terminal(bundle, render.Style({"always": True, "never": False}.get(args.color))))


def _token_side(args: argparse.Namespace) -> tuple[dict, DataFrame | None]:
    """The token report, and the sessions that it is of."""
    root = args.projects_root or transcripts.default_root()
    if not transcripts.has_logs(root):
        return tokens.empty_report(), None
    price = Price(*(getattr(args, f"price_{x}") for x in ("input", "output", "cache_read", "cache_write")))
    metrics = tokens.load(session(), root, args.repo if args.scope_repo else None, args.max_sessions, args.since, price)
    return tokens.report(metrics, args.top, price), metrics


def _bundle(reports: dict[str, dict]) -> dict:
    if len(reports) == 2:
        return B.combined_bundle(reports["tokens"], reports["repo"])
    return B.token_bundle(reports["tokens"]) if "tokens" in reports else B.repo_bundle(reports["repo"])


def _write(out: Path, reports: dict[str, dict], metrics: DataFrame | None, bundle: dict, budget: Budget) -> None:
    """The artifacts; their names are fixed. The sessions go into the token report one by one."""
    out.mkdir(parents=True, exist_ok=True)
    for side, held in reports.items():
        with open(out / ("token_report.json" if side == "tokens" else "repo_report.json"), "w", encoding="utf-8") as f:
            text = json.dumps(held, indent=2, default=str)
            if side == "tokens":
                f.write(text[: text.rindex("}")].rstrip() + ',\n  "per_session": [')
                for n, s in enumerate(tokens.every_session(metrics) if metrics is not None else ()):
                    f.write(("," if n else "") + "\n    " + json.dumps(s, default=str))
                text = "\n  ]\n}"
            f.write(text)
    (out / "bundle.json").write_text(json.dumps(bundle, indent=2, default=str))
    (out / "report.md").write_text(render.markdown(bundle))
    render.write_digest(out, bundle, reports.get("tokens"), reports.get("repo"), budget)
    (out / "budget.json").write_text(json.dumps(budget.to_dict(), indent=2))


def analyze(args: argparse.Namespace) -> int:
    reports: dict[str, dict] = {}
    metrics = None
    if args.mode != "repo":
        reports["tokens"], metrics = _token_side(args)
    if args.mode != "tokens":
        reports["repo"] = repo.report(session(), args.repo, args.top)
    bundle = _bundle(reports)
    if args.out:
        _write(Path(args.out), reports, metrics, bundle, Budget(cap_for(args.mode, args.budget)))
    _emit(args, bundle)
    got = bundle["verdict"]["grade"]
    missed = B.gate(got, args.fail_under)
    if missed:
        print(f"grade {got} is under {args.fail_under.upper()}", file=sys.stderr)
    return missed


#: Where ``extract`` writes if it isn't told.
RUN_FOLDER = ".millrace/run"


def extract(args: argparse.Namespace) -> int:
    args.out = args.out or RUN_FOLDER
    args.format = "markdown" if args.format == "markdown" else "terminal"
    code = analyze(args)
    print(f"artifacts are in {args.out}", file=sys.stderr)
    return code


def render_saved(args: argparse.Namespace) -> int:
    path = Path(args.bundle)
    bundle = json.loads(path.read_text())
    extra = Path(args.synthesis) if args.synthesis else path.parent / "synthesis.json"
    merged = 0
    if extra.exists():
        try:
            merged = B.merge_synthesis(bundle, json.loads(extra.read_text()))
        except ValueError:
            merged = 0
    _emit(args, bundle)
    if merged:
        print(f"merged {merged} findings of {extra}", file=sys.stderr)
    return 0


def doctor(args: argparse.Namespace) -> int:
    root = args.projects_root or transcripts.default_root()
    found = transcripts.has_logs(root)
    print(f"projects root: {root}\nexists: {'://' in root or os.path.isdir(root)}")
    logs = transcripts.listing(session(), root).select("project") if found else None
    print(f"transcripts: {logs.count() if found else 0}")
    for r in transcripts.by_project(logs).collect() if found else ():
        print(f"  {r.project} ({r.transcripts})")
    if not found:
        print("none found: set CLAUDE_CONFIG_DIR or --projects-root")
    return 0


def map_(args: argparse.Namespace) -> int:
    m = symbol_map.build(session(), args.repo, args.max_modules, args.verify_cmd)
    text = json.dumps(m, indent=2) if args.format == "json" else symbol_map.render(m)
    if args.out and args.format != "json":
        path = Path(args.out)
        path = path / "CLAUDE.md" if path.is_dir() else path
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
        print(f"{len(m['modules'])} modules are in {path}", file=sys.stderr)
    else:
        print(text)
    return 0


def bench(args: argparse.Namespace) -> int:
    """The tables of an experiment's runs."""
    spark = session()
    rows = runs.runs(spark, args.results, args.kind)
    if args.kind == "bench":
        pairs = experiments.paired(rows.where("error is null"))
        tables = [pairs.orderBy("task"), experiments.overall(pairs), rows.where("error is not null").agg(F.count("*").alias("errors"), F.min_by("error", "pos").alias("first_error"))]
    elif args.kind == "ladder":
        lifts = experiments.lift(rows)
        tables = [lifts.orderBy("tier"), experiments.cap_tier(lifts)]
    elif args.kind == "pareto":
        tables = [experiments.against_baseline(rows).orderBy("arm")]
    else:
        tables = [experiments.arm_totals(rows).orderBy("arm", "rep")]
    for t in tables:
        for r in t.collect():
            print(json.dumps(r.asDict(recursive=True)))
    return 0


def parser() -> argparse.ArgumentParser:
    """The names of commands and options, their choices and defaults."""
    top = argparse.ArgumentParser(prog="millrace", description="Session logs, source trees and experiments")
    top.add_argument("--version", action="version", version=f"millrace {VERSION}")
    sub = top.add_subparsers(dest="command", required=True)
    price = Price()
    for name, f in (("analyze", analyze), ("extract", extract)):
        p = sub.add_parser(name)
        p.set_defaults(run=f)
        p.add_argument("--mode", choices=("tokens", "repo", "both"), default="tokens")
        p.add_argument("--repo", default=".")
        p.add_argument("--scope-repo", action="store_true", help="only sessions of --repo")
        p.add_argument("--projects-root")
        p.add_argument("--max-sessions", type=int)
        p.add_argument("--since", type=float, metavar="DAYS")
        p.add_argument("--fail-under", metavar="GRADE")
        p.add_argument("--top", type=int, default=12)
        p.add_argument("--budget", type=int)
        p.add_argument("--out")
        p.add_argument("--format", choices=("terminal", "markdown", "json"), default="terminal")
        p.add_argument("--color", choices=("auto", "always", "never"), default="auto")
        for field in ("input", "output", "cache_read", "cache_write"):
            p.add_argument(f"--price-{field.replace('_', '-')}", type=float, default=getattr(price, field))
    p = sub.add_parser("render")
    p.set_defaults(run=render_saved)
    p.add_argument("bundle")
    p.add_argument("--synthesis")
    p.add_argument("--format", choices=("terminal", "markdown", "json"), default="terminal")
    p.add_argument("--color", choices=("auto", "always", "never"), default="auto")
    p = sub.add_parser("doctor")
    p.set_defaults(run=doctor)
    p.add_argument("--projects-root")
    p = sub.add_parser("map")
    p.set_defaults(run=map_)
    p.add_argument("--repo", default=".")
    p.add_argument("--out")
    p.add_argument("--max-modules", type=int, default=40)
    p.add_argument("--verify-cmd")
    p.add_argument("--format", choices=("markdown", "json"), default="markdown")
    p = sub.add_parser("bench")
    p.set_defaults(run=bench)
    p.add_argument("results")
    p.add_argument("--kind", choices=tuple(runs.SCHEMAS), default="bench")
    return top


def main(argv: list[str] | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if not argv or argv[0] not in (*COMMANDS, "-h", "--help", "--version"):
        argv = ["analyze", *argv]
    args = parser().parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    raise SystemExit(main())
