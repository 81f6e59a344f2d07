"""Reports of checks as text, JSON, Markdown and HTML. The rows are a suite's checks, a short list."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame

from tessera.plans.gates import RANK

COLUMNS = ["suite", "name", "cls", "value", "threshold", "severity", "status"]


def shown(value: float | None) -> str:
    """Four decimals below 1000, else one; nothing for null."""
    if value is None:
        return ""
    return f"{value:.4f}" if abs(value) < 1000 else f"{value:.1f}"


def rows_of(checks: DataFrame) -> list[dict]:
    rows = [{c: r[c] for c in COLUMNS} for r in checks.select(*COLUMNS).collect()]  # one for each check
    return sorted(rows, key=lambda r: (-RANK.index(r["status"]), r["suite"], r["name"], r["cls"] or ""))


def overall(rows: list[dict]) -> str:
    found = {r["status"] for r in rows}
    return next((s for s in ("FAIL", "WARN", "ERROR") if s in found), "PASS")


def succeeded(rows: list[dict]) -> bool:
    """Whether a run ends with exit code 0."""
    return overall(rows) in ("PASS", "WARN", "INFO")


def _cells(row: dict) -> list[str]:
    return [shown(row[c]) if c in ("value", "threshold") else row[c] or "" for c in COLUMNS]


def as_text(rows: list[dict]) -> str:
    table = [COLUMNS, *map(_cells, rows)]
    wide = [max(map(len, column)) for column in zip(*table, strict=True)]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(line, wide, strict=True)).rstrip() for line in table) + f"\noverall: {overall(rows)}\n"


def as_json(rows: list[dict]) -> str:
    return json.dumps({"overall": overall(rows), "counts": {s: sum(r["status"] == s for r in rows) for s in RANK}, "checks": rows}, ensure_ascii=False, indent=2)


def as_markdown(rows: list[dict]) -> str:
    line = lambda cells: "| " + " | ".join(c.replace("|", "\\|") for c in cells) + " |"
    return "\n".join([f"# Checks: {overall(rows)}", "", line(COLUMNS), line(["---"] * len(COLUMNS)), *(line(_cells(r)) for r in rows), ""])


def as_html(rows: list[dict]) -> str:
    line = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{html.escape(c)}</{tag}>" for c in cells) + "</tr>"
    body = "\n".join(line(_cells(r), "td") for r in rows)
    return f"<!doctype html>\n<meta charset=utf-8>\n<h1>Checks: {overall(rows)}</h1>\n<table>\n{line(COLUMNS, 'th')}\n{body}\n</table>\n"
