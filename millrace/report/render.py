"""A bundle as terminal text, Markdown or a digest for an agent."""

from __future__ import annotations

import json
import os
import sys
import textwrap
from pathlib import Path
from typing import Any

from millrace.report.budget import Budget
from millrace.report.formats import human_tokens, money, percent

WIDTH = 78
SHARD_CHARS = 8000
_COLORS = {"high": "31", "medium": "33", "low": "36", "info": "90", "good": "32", "accent": "35", "dim": "90"}
_GLYPHS = "▁▂▃▄▅▆▇█"


def projection_lines(p: dict[str, Any] | None) -> list[str]:
    """What ``operators.sessions.savings`` says, in words."""
    if not p:
        return []
    span = lambda name, shown: " to ".join(shown(p[f"{name}_{end}"]) for end in ("low", "high"))
    out = ["A map of the tree has little to save here: no session reads files again."]
    if p["map_tokens_high"] > 0:
        out = [
            f"With a map of the tree: some {span('map_tokens', human_tokens)} tokens less ({span('map_usd', money)}), {span('pct', percent)} of all.",
            f"From {p['map_eligible_sessions']} of {p['total_sessions']} sessions that read files again, {human_tokens(p['eligible_context_tokens'])} tokens, at {span('rate', percent)}.",
        ]
    lost = p["cache_reclaimable_usd"]
    return [*out, *([f"Cache misses: some {money(lost)} more."] if lost > 0 else [])]


class Style:
    """Colors or none. NO_COLOR is stronger than MILLRACE_COLOR, a choice of the caller is stronger than both."""

    def __init__(self, force: bool | None = None):
        env = os.environ
        self.on = force if force is not None else not env.get("NO_COLOR") and (bool(env.get("MILLRACE_COLOR")) or sys.stdout.isatty())

    def __call__(self, text: str, role: str | None = None, bold: bool = False) -> str:
        codes = ([_COLORS[role]] if role in _COLORS else []) + ["1"] * bold
        return f"\x1b[{';'.join(codes)}m{text}\x1b[0m" if self.on and codes else text


def sparkline(values: list[float]) -> str:
    """A glyph a value, from the least to the greatest."""
    if not values:
        return ""
    low, span = min(values), max(values) - min(values)
    return "".join(_GLYPHS[int((v - low) / span * (len(_GLYPHS) - 1)) if span else 0] for v in values)


def bar(value: float, most: float, width: int = 24) -> str:
    n = round(width * value / most) if most > 0 else 0
    return "█" * n + "░" * (width - n)


def _wrapped(text: str, indent: str) -> list[str]:
    return textwrap.wrap(text, WIDTH, initial_indent=indent, subsequent_indent=indent) or [indent.rstrip()]


def _finding(f: dict[str, Any], n: int, style: Style) -> list[str]:
    severity = f.get("severity", "info")
    cost = f"  (~${f['impact_usd']:,.2f})" if f.get("impact_usd") else ""
    out = [f"  {n}. {style(f'[{severity.upper()}]', severity, True)} {f.get('title', '')}{cost}"]
    out += _wrapped(f.get("evidence", ""), "     ") + _wrapped(f"> {f.get('recommendation', '')}", "     ")
    return out + [style(f"       {p}", "dim") for p in (f.get("locations") or [])[:4]]


def terminal(bundle: dict[str, Any], style: Style | None = None) -> str:
    style = style or Style()
    meta, verdict = bundle["meta"], bundle["verdict"]
    out = ["=" * WIDTH, style(f"  {meta['mode_label']}", "accent", True), f"  {meta['subtitle']}", "=" * WIDTH, "", f"  Grade {style(verdict['grade'], 'accent', True)}: {verdict['headline']}", ""]
    if lines := projection_lines(bundle.get("projection")):
        out += ["  To be saved (estimate)", *(x for line in lines for x in _wrapped(line, "    ")), ""]
    out += [f"  {k['label']:<26}{style(k['value'], k.get('role'))}" for k in bundle["kpis"]]
    if trend := bundle.get("trend"):
        out += ["", f"  {trend['label']}: {sparkline(trend['values'])}  {trend['note']}"]
    for chart in bundle["charts"]:
        most = max((r["value"] for r in chart["rows"]), default=0)
        out += ["", f"  {chart['title']}", *(f"    {r['label']:<26}{style(bar(r['value'], most), r['role'])} {r['note']}" for r in chart["rows"])]
    out += ["", f"  Findings ({len(bundle['findings'])})"]
    for n, f in enumerate(bundle["findings"], 1):
        out += _finding(f, n, style)
    return "\n".join([*out, "", f"  {bundle['footer']}"])


def markdown(bundle: dict[str, Any]) -> str:
    meta, verdict = bundle["meta"], bundle["verdict"]
    out = [f"# {meta['mode_label']}", "", f"> {meta['subtitle']}", "", f"**Grade {verdict['grade']}**: {verdict['headline']}", ""]
    if lines := projection_lines(bundle.get("projection")):
        out += ["## To be saved (estimate)", "", *(f"- {x}" for x in lines), ""]
    if bundle["kpis"]:
        out += ["| Measure | Value |", "| --- | --- |", *(f"| {k['label']} | {k['value']} |" for k in bundle["kpis"]), ""]
    if trend := bundle.get("trend"):
        out += [f"{trend['label']}: `{sparkline(trend['values'])}` {trend['note']}", ""]
    for chart in bundle["charts"]:
        most = max((r["value"] for r in chart["rows"]), default=0)
        out += [f"## {chart['title']}", "", *(f"- `{bar(r['value'], most, 12)}` {r['label']}: {r['note']}" for r in chart["rows"]), ""]
    out += [f"## Findings ({len(bundle['findings'])})", ""]
    for n, f in enumerate(bundle["findings"], 1):
        out += [f"### {n}. [{f.get('severity', 'info').upper()}] {f.get('title', '')}", "", f.get("evidence", ""), "", f"**Do:** {f.get('recommendation', '')}", ""]
        if f.get("locations"):
            out += [*(f"- `{p}`" for p in f["locations"][:8]), ""]
    return "\n".join([*out, f"_{bundle['footer']}_"])


_TASK = """Read the findings above and the shards beside this file, no more than the budget allows. For each one that matters
write what to change, where and why, as a JSON list of findings with the same fields, into synthesis.json."""


def digest(bundle: dict[str, Any]) -> str:
    verdict = bundle["verdict"]
    out = [f"# Digest: {bundle['meta']['mode_label']}", "", f"> {bundle['meta']['subtitle']}", "", f"**Grade {verdict['grade']}**: {verdict['headline']}", ""]
    if lines := projection_lines(bundle.get("projection")):
        out += ["## To be saved (estimate)", *(f"- {x}" for x in lines), ""]
    out += ["## Measures", *(f"- {k['label']}: {k['value']}" for k in bundle["kpis"]), "", "## Findings, by rank"]
    for n, f in enumerate(bundle["findings"], 1):
        out += [f"{n}. [{f.get('severity', '').upper()}] {f.get('title', '')}", f"   shown by: {f.get('evidence', '')}", f"   do: {f.get('recommendation', '')}"]
    return "\n".join([*out, "", "## Your task", _TASK])


def _trimmed(text: str, most: int) -> str:
    return text if len(text) <= most else text[: most - 20] + "\n... [cut]\n"


_SHARD = ("waste_score", "cache_hit_ratio", "reread_files", "repeated_cmds", "big_outputs", "tool_histogram")


def write_digest(out: Path, bundle: dict[str, Any], tokens: dict[str, Any] | None, repo: dict[str, Any] | None, budget: Budget) -> None:
    """The digest and its shards, worst first: each list stops at the first shard that would go over the allowance."""
    text = digest(bundle)
    budget.charge_chars(len(text), "digest.md")
    (out / "digest.md").write_text(text)
    folder = out / "shards"
    folder.mkdir(exist_ok=True)
    sessions = [{"session": s["session_id"]} | {k: s[k] for k in _SHARD} for s in (tokens or {}).get("worst_sessions", [])]
    lists = [[(f"session-{i:02d}", s) for i, s in enumerate(sessions)], [(f"repo-{f['id']}", f) for f in (repo or {}).get("findings", [])]]
    allowance, spent, written = budget.allowance(), 0, 0
    for shards in lists:
        for name, shard in shards:
            blob = json.dumps(shard, indent=2)
            if spent + len(blob) // 4 > allowance:
                break
            (folder / f"{name}.json").write_text(_trimmed(blob, SHARD_CHARS))
            spent += len(blob) // 4
            written += 1
    budget.charge(spent, f"{written} shards")
