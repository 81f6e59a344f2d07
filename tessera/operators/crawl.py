"""Records of repositories: normal form, keyword scores, staged filters, summaries. Keyword lists are parameters."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import clean_html

# File kinds that are kept.
EXTENSIONS = [".dxf", ".dwg", ".pdf", ".png", ".jpg", ".jpeg", ".tif", ".tiff", ".svg"]
LARGEST, SMALLEST = 500 * 1024 * 1024, 1024

# Words that score (high 10, medium 5, low 2; 5 are enough), words that reject, words of a category.
INCLUDED = {
    10: ["welding", "weld", "weldment", "CNC", "milling", "machining", "lathe", "turning", "boring", "grinding", "drilling", "tapping", "sheet metal", "fabrication"],
    5: [
        "mechanical drawing", "engineering drawing", "technical drawing", "manufacturing drawing", "machine design",
        "mechanical part", "assembly drawing", "detail drawing", "shop drawing", "production drawing",
    ],
    2: ["GD&T", "tolerance", "dimensioning", "surface roughness", "surface finish", "ISO 2553", "ISO 1101", "ASME Y14", "KS B", "JIS B", "DXF", "DWG", "CAD"],
}
WEIGHTS = {word: weight for weight, words in INCLUDED.items() for word in words}
EXCLUDED = [
    "architectural", "architecture", "building design", "floor plan", "building plan", "house plan", "civil engineering",
    "structural engineering", "urban planning", "urban design", "landscape", "interior design", "construction management",
    "electrical schematic", "circuit diagram", "circuit board", "PCB", "wiring diagram", "electronic schematic", "logic diagram",
    "HVAC", "plumbing", "piping diagram", "P&ID", "fire protection",
    "medical", "anatomical", "anatomy", "chemical engineering", "biomedical", "pharmaceutical",
    "geological", "geographic", "cartography", "fashion design", "textile", "food processing", "software architecture", "UML",
    "flowchart", "network diagram",
]
CATEGORIES = {
    "welding": ["welding", "weld", "weldment", "weld joint", "fillet weld", "butt weld", "groove weld", "ISO 2553", "welding symbol"],
    "cnc_machining": ["CNC", "milling", "machining", "boring", "drilling", "tapping", "grinding", "5-axis", "3-axis", "machining center"],
    "lathe_turning": ["lathe", "turning", "chuck", "spindle", "facing", "threading", "knurling", "rotational", "cylindrical"],
    "design": ["machine design", "mechanical design", "assembly", "detail drawing", "GD&T", "tolerance", "dimensioning", "part drawing", "component"],
    "sheet_metal": ["sheet metal", "bending", "stamping", "punching", "laser cutting", "forming", "flat pattern", "bend allowance"],
}
LICENCES = ["cc-by-4.0", "cc-by-sa-4.0", "cc-by-nc-4.0", "cc-by-nc-sa-4.0", "cc-by-3.0", "cc-by-nc-3.0", "cc-zero", "cc0-1.0", "mit", "apache-2.0", "gpl-3.0", "open"]


def first_of(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def present(text: Column, keyword: str) -> Column:
    """Whether a keyword stands as whole words, in any case."""
    return F.coalesce(text.rlike(rf"(?iU)\b{re.escape(keyword)}\b"), F.lit(False))


def hits(text: Column, keywords: list[str]) -> Column:
    """The keywords that are there, in the order of the list."""
    return F.array_compact(F.array(*(F.when(present(text, k), k) for k in keywords)))


def searchable_text(title: Column, description: Column, keywords: Column, subjects: Column, notes: Column) -> Column:
    """What keywords are looked up in: title, description without markup, lists of keywords and subjects, notes."""
    return F.concat_ws(" ", title, clean_html(description), keywords, subjects, notes)


def licence_id(record: Column) -> Column:
    """Licence of a record (a variant): the id of an object, else the text itself; an object without an id as JSON."""
    at = lambda path, kind: F.try_variant_get(record, path, kind)
    return F.coalesce(at("$.license.id", "string"), at("$.license", "string"), F.to_json(at("$.license", "variant")))


def allowed_licence(licence: Column, access: Column, allowed: list[str] = LICENCES) -> Column:
    """Whether an allowed licence stands in the licence or the access right, in any case; nulls are empty."""
    texts = [F.lower(F.coalesce(c, F.lit(""))) for c in (licence, access)]
    return reduce(lambda a, b: a | b, (c.contains(x) for c in texts for x in allowed))


def include_score(text: Column, weights: dict[str, int]) -> Column:
    """Weights of the different keywords that are there."""
    return reduce(lambda a, b: a + b, (F.when(present(text, k), w).otherwise(0) for k, w in weights.items()))


def category(text: Column, keywords: dict[str, list[str]], other: str = "uncategorized") -> Column:
    """The category with most keywords there; ties by order; none: ``other``."""
    n = [reduce(lambda a, b: a + b, (present(text, k).cast("int") for k in words)) for words in keywords.values()]
    best = F.greatest(*n) if len(n) > 1 else n[0]
    return F.when(best == 0, other).otherwise(F.coalesce(*(F.when(c == best, name) for name, c in zip(keywords, n, strict=True))))


def eligible_file(extension: Column, size: Column) -> Column:
    """Kept kinds up to the largest size; small ones go, size 0 (unknown) stays."""
    return extension.isin(EXTENSIONS) & (size <= LARGEST) & ~((size > 0) & (size < SMALLEST))


def staged_filter(text: Column, excluded: list[str], weights: dict[str, int], files: Column, least: int = 5, licensed: Column | None = None) -> Column:
    """The first reason for which a record is rejected, or ``accepted``. ``licensed``: none, and licences are not looked at."""
    hit = reduce(lambda a, b: a | b, (present(text, k) for k in excluded))
    reason = F.when(hit, "excluded")
    if licensed is not None:
        reason = reason.when(~F.coalesce(licensed, F.lit(False)), "licence")
    return reason.when(include_score(text, weights) < least, "low_score").when(files < 1, "no_files").otherwise("accepted")


def crawl_summary(records: DataFrame, by: str, counted: dict[str, Column]) -> DataFrame:
    """Sums of each category or source and of all (``_all``); without one: ``uncategorized``."""
    keyed = records.withColumn(by, F.coalesce(F.col(by), F.lit("uncategorized")))
    out = keyed.rollup(by).agg(F.count(F.lit(1)).alias("records"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for n, c in counted.items()), F.grouping(by).alias("whole"))
    return out.withColumn(by, F.when(F.col("whole") == 1, "_all").otherwise(F.col(by))).drop("whole")


def download_url(file: Column, buckets: str) -> Column:
    """Address of a file (a variant): its links self, content, download, then url, then bucket and key under ``buckets``."""
    at = lambda path: F.try_variant_get(file, path, "string")
    bucket, key = first_of(at("$.bucket")), first_of(at("$.key"))
    return F.coalesce(at("$.links.self"), at("$.links.content"), at("$.links.download"), at("$.url"), F.concat(F.lit(buckets.rstrip("/") + "/"), bucket, F.lit("/"), key))
