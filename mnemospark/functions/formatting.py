"""Results as text: trees, diagrams, and JSON within a budget of bytes."""

from __future__ import annotations

import json
import re


def tree(symbols: list[dict]) -> str:
    """Files with their symbols, calls and memories, as an indented list."""
    out: list[str] = []
    last = None
    for s in sorted(symbols, key=lambda s: (s["file_path"], s["name"])):
        if s["file_path"] != last:
            last = s["file_path"]
            out.append(last)
        notes = [f"{k} {', '.join(s[c])}" for k, c in (("calls", "calls"), ("called by", "called_by"), ("memories", "memories")) if s.get(c)]
        out.append(f"  {s['name']}" + (f"  ({'; '.join(notes)})" if notes else ""))
    return "\n".join(out)


def label(text: str, width: int = 60) -> str:
    return re.sub(r"\s+", " ", re.sub(r"""[\[\]{}()"'`<>|]""", "", text)).strip()[:width]


def mermaid(edges: list[tuple[str, str, str]]) -> str:
    """A flow chart of (from, label, to)."""
    number: dict[str, int] = {}
    lines = ["graph LR"]
    for a, kind, b in edges:
        i, j = (number.setdefault(x, len(number)) for x in (a, b))
        lines.append(f'  n{i}["{label(a)}"] -->|{label(kind)}| n{j}["{label(b)}"]')
    return "\n".join(lines)


def within_bytes(payload: dict, budget: int) -> dict:
    """The payload, its longest lists cut from the end until its JSON fits; what was cut is counted."""
    out = {k: list(v) if isinstance(v, list) else v for k, v in payload.items()}
    omitted: dict[str, int] = {}
    size = lambda: len(json.dumps(out | ({"omitted": omitted} if omitted else {}), ensure_ascii=False).encode())
    while size() > budget:
        lists = [k for k, v in out.items() if isinstance(v, list) and v]
        if not lists:
            break
        k = max(lists, key=lambda k: len(out[k]))
        out[k].pop()
        omitted[k] = omitted.get(k, 0) + 1
    return out | ({"omitted": omitted} if omitted else {})
