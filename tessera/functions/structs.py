"""Records inside texts: tag strings, JSON inside answers."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_tags(fields: dict[str, Column]) -> Column:
    """Tag string of a flat record: ``<s_name>value</s_name>`` for each field, nulls empty."""
    return F.concat(*(F.concat(F.lit(f"<s_{n}>"), F.coalesce(c.cast("string"), F.lit("")), F.lit(f"</s_{n}>")) for n, c in fields.items()))


def tag_field(tags: Column, name: str) -> Column:
    """Value of a field in a tag string, null where it is missing or empty."""
    return F.nullif(F.regexp_extract(tags, f"<s_{name}>(.*?)</s_{name}>", 1), F.lit(""))


def balanced_json(text: str | None) -> str | None:
    """The first balanced object of a text; braces inside strings do not count."""
    depth, start, quoted, escaped = 0, -1, False, False
    for i, c in enumerate(text or ""):
        if quoted:
            quoted, escaped = not (c == '"' and not escaped), c == "\\" and not escaped
        elif c == '"' and depth:
            quoted = True
        elif c == "{":
            start, depth = (i, 1) if depth == 0 else (start, depth + 1)
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                return text[start : i + 1]
    return None


def answer_json(text: str | None) -> dict | None:
    """The object in an answer: a fenced block, else the first balanced object, else the whole text."""
    fenced = re.search(r"```(?:json)?\s*(.*?)```", text or "", re.S)
    for part in ([fenced[1]] if fenced else []) + [balanced_json(text), text]:
        try:
            found = json.loads(part)
        except (TypeError, ValueError, RecursionError):
            continue
        if isinstance(found, dict):
            return found
    return None


def _confidence(found: dict | None) -> float:
    """What an answer says, 0.5 where it says nothing that is a finite number; 0.4 without an answer."""
    if found is None:
        return 0.4
    try:
        said = float(found.get("confidence"))
    except (TypeError, ValueError, OverflowError):
        return 0.5
    return said if math.isfinite(said) else 0.5


def parse_answers(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, doc, confidence): what does not parse keeps its first 200 characters at confidence 0.4."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [answer_json(t) for t in b[column]]
            doc = [json.dumps(f, sort_keys=True) if f is not None else json.dumps({"suggested": (t or "")[:200]}) for f, t in zip(found, b[column], strict=True)]
            yield pd.DataFrame({key: b[key], "doc": doc, "confidence": [_confidence(f) for f in found]})

    return rows.select(key, column).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, doc string, confidence double")
