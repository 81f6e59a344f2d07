"""Numbers in strings, tolerant comparison, and rules that fill records from recognised text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"-?\d+(?:\.\d+)?"


def first_number(s: Column) -> Column:
    """The first number in a string, null without one."""
    return F.regexp_extract(s, f"({NUMBER})", 1).try_cast("double")


def numerical_match(a: Column, b: Column, absolute: float = 0.01, relative: float = 0.001) -> Column:
    """Within either tolerance; two nulls match, one does not."""
    close = F.abs(a - b) <= F.greatest(F.lit(absolute), F.lit(relative) * F.greatest(F.abs(a), F.abs(b)))
    return F.when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), False).otherwise(close)


def fill_measure(text: Column, hint: Column, signed_lower: bool = False) -> Column:
    """struct(nominal, upper, lower, reason): the hint or first number; ± before +a/-b. ``lower`` is a magnitude unless signed."""
    nominal = F.coalesce(hint, first_number(text))
    even = F.regexp_extract(text, r"±\s*(\d+(?:\.\d+)?)", 1).try_cast("double")
    pair = r"\+\s*(\d+(?:\.\d+)?)\s*/\s*-\s*(\d+(?:\.\d+)?)"
    upper = F.coalesce(even, F.regexp_extract(text, pair, 1).try_cast("double"))
    lower = F.coalesce(even, F.regexp_extract(text, pair, 2).try_cast("double")) * (-1 if signed_lower else 1)
    found = nominal.isNotNull()
    return F.struct(nominal.alias("nominal"), F.when(found, upper).alias("upper"), F.when(found, lower).alias("lower"), F.when(found, "").otherwise("no_numeric_in_ocr").alias("reason"))


# Symbol and the pattern that tells it, the first that matches wins.
SYMBOLS = [
    ("⌖", r"[⌖⌖]|TRUE\s*POSITION|Position|\bPOS\b"),
    ("⏤", r"[⏤⏤]|STRAIGHT|Straightness|\bSTR\b"),
    ("⊥", r"[⊥⊥]|PERPEND|Perpendicular|\bPERP\b"),
    ("∥", r"[∥∥]|PARALLEL|Parallelism|\bPARA\b"),
    ("⌭", r"[⌭⌭]|CYLIND|Cylindricity|\bCYL\b"),
    ("○", r"\bROUND|Roundness|Circular(?:ity)?|\bCIRC\b"),
    ("⌒", r"[⌒⌒]|Profile.*Line"),
    ("⌓", r"[⌓⌓]|Profile.*Surface"),
    ("∠", r"[∠∠]|ANGUL|Angularity|\bANG\b"),
    ("⌯", r"[⌯⌯]|Symmetry|\bSYM\b"),
    ("◎", r"[◎◎]|Concentricity|\bCON\b|\bCONC\b"),
    ("⌰", r"[⌰⌰]|Total.*Run"),
    ("↗", r"[↗↗]|Run.*[Oo]ut|\bRO\b"),
    ("⌗", r"[⌗⌗]|Flatness|\bFLAT\b"),
]


def fill_gdt(text: Column) -> Column:
    """struct(symbol, tolerance, datum, reason); at most three different datums, numbers blanked before the scan."""
    symbol = F.coalesce(*(F.when(text.rlike("(?iu)" + p), s) for s, p in SYMBOLS))
    letters = F.regexp_extract_all(F.regexp_replace(text, NUMBER, " "), F.lit(r"\b([A-D](?:\s*[-‐]\s*[A-D])?)\b"), F.lit(1))
    datums = F.slice(F.filter(F.array_distinct(F.transform(letters, lambda d: F.regexp_replace(d, " ", ""))), lambda d: F.length(d) <= 3), 1, 3)
    found = symbol.isNotNull()
    return F.struct(symbol.alias("symbol"), F.when(found, first_number(text)).alias("tolerance"), F.when(found & (F.size(datums) > 0), datums).alias("datum"), F.when(found, "").otherwise("no_gdt_symbol_match").alias("reason"))


def fill_roughness(text: Column) -> Column:
    """struct(ra, reason): after ``Ra``, else the first number with a warning."""
    ra = F.regexp_extract(text, r"(?i)R\s*a\s*[:=]?\s*(\d+(?:\.\d+)?)", 1).try_cast("double")
    some = first_number(text)
    return F.struct(F.coalesce(ra, some).alias("ra"), F.when(ra.isNotNull(), "").when(some.isNotNull(), "fallback_first_numeric").otherwise("no_numeric_in_ocr").alias("reason"))
