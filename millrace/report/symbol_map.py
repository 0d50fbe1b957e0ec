"""The map of a tree: its modules with what they offer, and how its tests are run."""

from __future__ import annotations

import json
import os
from typing import Any

from pyspark.sql import SparkSession

from millrace.operators import repo as R
from millrace.operators import surface
from millrace.sources import files


def _read(path: str) -> str:
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            return f.read()
    except OSError:
        return ""


def _scripts(repo: str) -> list[str]:
    try:
        held = json.loads(_read(os.path.join(repo, "package.json")) or "{}").get("scripts", {})
    except (ValueError, AttributeError):
        return []
    return list(held) if isinstance(held, dict) else []


def build(spark: SparkSession, repo: str, most: int = surface.MOST_MODULES, command: str | None = None) -> dict[str, Any]:
    tree = files.tree(spark, repo, most=1 << 40)
    found = surface.modules(R.classified(tree)).persist()  # counted and listed
    listed = surface.listed(found, most).collect()
    found.unpersist()
    if command is None:
        command = surface.verify_command(tree, _scripts(repo), "pytest" in _read(os.path.join(repo, "pyproject.toml"))).first().command
    root = os.path.abspath(repo)
    return {
        "repo": root, "name": os.path.basename(root), "verify_cmd": command, "truncated": listed[0].truncated if listed else 0,
        "modules": [{"path": r.path, "summary": r.summary, "symbols": list(r.symbols)} for r in listed],
    }


def render(m: dict[str, Any]) -> str:
    out = [f"# {m['name']}: map", "", "Trust this map before looking through the tree.", ""]
    for mod in m["modules"]:
        said = [mod["summary"]] * bool(mod["summary"]) + [", ".join(mod["symbols"])] * bool(mod["symbols"])
        out.append(f"- `{mod['path']}`" + (" — " + ": ".join(said) if said else ""))
    if m["truncated"]:
        out.append(f"- (+{m['truncated']} more modules; search for what isn't listed)")
    out += ["", "## How to work", "", "- Read a file once and whole before editing it; don't read it again."]
    if m["verify_cmd"]:
        out.append(f"- Check with `{m['verify_cmd']}`, once, at the end.")
    return "\n".join([*out, "- Change little, in the style that is there.", ""])
