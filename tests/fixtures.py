"""Made-up session logs, and what the rules say of them in plain Python."""

from __future__ import annotations

import json
import random
from collections import Counter
from pathlib import Path

#: Two projects whose logs have the same names; one folder needs care in a path.
PROJECTS = ("-srv-my mill%20#1", "-srv-loom")
PER_PROJECT = 6
FILES = ["/srv/gears.py", "/srv/my mill/shaft.py", "/srv/notes.md"]
COMMANDS = ["make  grist", "ls", "ls   -a"]


def session(seed: int) -> list[dict]:
    """Events of one log: notes, turns of both kinds with calls and results, compactions."""
    rng = random.Random(seed)
    thrifty, out = rng.random() < 0.6, [{"type": "note", "cwd": f"/srv/{seed % 3}", "version": f"0.{seed}", "timestamp": f"2031-02-{seed % 27 + 1:02d}T08:00:00Z"}]
    for n in range(rng.randrange(2, 9)):
        calls = [{"type": "tool_use", "name": "Read", "input": {"file_path": rng.choice(FILES)}} for _ in range(rng.randrange(3))]
        calls += [{"type": "tool_use", "name": "Bash", "input": {"command": rng.choice(COMMANDS)}} for _ in range(rng.randrange(2))]
        used = {"input_tokens": rng.randrange(200, 90_000), "output_tokens": rng.randrange(50, 3000), "cache_read_input_tokens": rng.randrange(60_000, 300_000) if thrifty else rng.randrange(900), "cache_creation_input_tokens": rng.choice([0, 4000])}
        out.append({"type": "assistant", "gitBranch": f"b{n}", "timestamp": f"t{n}", "message": {"content": [{"type": "text", "text": "so"}, *calls], "usage": used}})
        results = [{"type": "tool_result", "is_error": rng.random() < 0.2, "content": "r" * rng.choice([3, 500, 61_000 if rng.random() < 0.2 else 9])} for _ in calls]
        out.append({"type": "user", "message": {"content": results}} | ({"subtype": "compact_boundary"} if rng.random() < 0.25 else {}))
    return out


def every() -> dict[tuple[str, str], list[dict]]:
    """The events by project and session."""
    return {(p, f"run {n}"): session(100 * i + n) for i, p in enumerate(PROJECTS) for n in range(PER_PROJECT)}


def write(root: Path) -> Path:
    for (project, name), events in every().items():
        (root / project).mkdir(parents=True, exist_ok=True)
        (root / project / f"{name}.jsonl").write_text("".join(json.dumps(e) + "\n" for e in events))
    return root


def plain(events: list[dict]) -> dict:
    """Metrics of a session by the published rules."""
    turns = [e for e in events if e["type"] in ("assistant", "user")]
    sums = {k: sum(e["message"].get("usage", {}).get(k, 0) for e in turns) for k in ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")}
    blocks = [b for e in turns for b in e["message"]["content"]]
    calls, results = [b for b in blocks if b["type"] == "tool_use"], [b for b in blocks if b["type"] == "tool_result"]
    i, o, r, w = sums.values()
    ratio = r / (i + r + w) if i + r + w else 0.0
    reads = {f: n for f, n in Counter(c["input"]["file_path"] for c in calls if c["name"] == "Read").items() if n >= 3}
    runs = {c: n for c, n in Counter(" ".join(c["input"]["command"].split()) for c in calls if c["name"] == "Bash").items() if n >= 2}
    errors, compactions, big = sum(b["is_error"] for b in results), sum("subtype" in e for e in turns), sum(len(b["content"]) >= 60_000 for b in results)
    denial = round(errors / len(calls), 4) if calls else 0.0
    score = (34 * (1 - round(ratio, 4) / 0.55) if round(ratio, 4) < 0.55 else 0) + min(20, 6 * sum(n - 1 for n in reads.values())) + min(16, 8 * big) + min(14, 7 * sum(n - 1 for n in runs.values()))
    score += (min(10, 200 * denial) if denial > 0.04 else 0) + min(6, 3 * max(0, compactions - 1))
    return {
        "turns": len(turns), "assistant_turns": sum(e["type"] == "assistant" for e in turns), "input_tokens": i, "output_tokens": o, "cache_read_tokens": r, "cache_creation_tokens": w, "ratio": ratio,
        "tool_calls": len(calls), "tool_errors": errors, "denial_ratio": denial, "big_outputs": big, "compactions": compactions, "reread_files": reads, "repeated_cmds": runs, "tool_histogram": dict(Counter(c["name"] for c in calls)),
        "cost": (3 * i + 15 * o + 0.3 * r + 3.75 * w) / 1e6, "waste": 2.7 * i / 1e6 if ratio < 0.55 else 0.0, "waste_score": round(min(100, score), 1),
        "branch": [e["gitBranch"] for e in turns if "gitBranch" in e][-1], "repo": events[0]["cwd"], "version": events[0]["version"], "started": events[0]["timestamp"], "ended": [e["timestamp"] for e in turns if "timestamp" in e][-1],
    }
