"""Enrichment with provenance: a knowledge table with precedence, and full records from drawing documents.

The knowledge table has one row for each (name, key). A file ``<name>.json`` in a folder replaces the built-in rows of
its name as a whole, and its content hash is their version; a file that does not parse changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import documents as D
from tessera.plans.enrichment import PROCESSES, is_ambiguous

ALTERNATIVES = "array<struct<value string, weight double, note string>>"
SCHEMA = f"name string, key string, value string, alternatives {ALTERNATIVES}, confidence double, source string, rationale string, version string"
MATERIALS, TOLERANCES, ROUGHNESS = "material_catalog", "iso_2768_defaults", "machining_roughness_table"

# Name, key, value, alternatives (value, weight), confidence, source.
BUILT_IN = [
    (MATERIALS, "stainless", "SUS304 No.2D", [("SUS304 BA", 0.30), ("SUS316L No.2D", 0.15), ("SUS430 No.2D", 0.10)], 0.78, "KS D 3705 / cross_standard_map"),
    (MATERIALS, "stainless steel", "SUS304 No.2D", [("SUS304 BA", 0.30)], 0.78, "KS D 3705"),
    (MATERIALS, "carbon steel", "SS400", [("S45C", 0.25), ("SM490A", 0.10)], 0.72, "KS D 3503"),
    (MATERIALS, "aluminum", "AL6061-T6", [("AL5052", 0.35), ("AL7075-T6", 0.20)], 0.74, "AMS-QQ-A-250"),
    (MATERIALS, "brass", "C2680", [("C2600", 0.30)], 0.70, "KS D 5201"),
    (TOLERANCES, "default", "ISO 2768-mK", [], 0.95, "iso_2768_defaults.json"),
    (ROUGHNESS, "default", "Ra 3.2 μm", [("Ra 1.6 μm", None), ("Ra 6.3 μm", None)], 0.65, "machining_roughness_table.json"),
    (ROUGHNESS, "precise", "Ra 1.6 μm", [("Ra 0.8 μm", None)], 0.78, "heuristics.py:precision_fit_implies_ra1.6"),
]
# Tolerance classes of precise fits.
PRECISE = ["h6", "h7", "k6", "H6", "H7", "K6"]
CATEGORIES = ["material", "tolerance_general", "surface_roughness_default", "process_sequence", "qc_checklist"]


def built_in(spark: SparkSession) -> DataFrame:
    rows = [(n, k, v, [(a, w, None) for a, w in more], sure, source, "", "built-in") for n, k, v, more, sure, source in BUILT_IN]
    return spark.createDataFrame(rows, SCHEMA)


def read_knowledge(spark: SparkSession, folder: str | None = None) -> DataFrame:
    """The knowledge table: built-in rows, those of a name replaced by the folder's file of that name where it parses.

    A file holds an object of entries (``primary`` or ``default``, ``alternatives``, ``confidence`` (0.75 without one),
    ``source`` (the file's name), ``rationale``), or is one entry itself, under the key ``default``.
    """
    base = built_in(spark)
    if folder is None:
        return base
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1).alias("name"), F.try_parse_json("value").alias("doc"), F.sha2("value", 256).alias("version"))
    good = raw.where(D.as_object(F.col("doc")).isNotNull())
    member = lambda e, p, kind="string": F.try_variant_get(e, f"$.{p}", kind)
    value = lambda e: F.coalesce(member(e, "primary"), member(e, "default"))
    whole = F.when(value(F.col("doc")).isNotNull(), F.create_map(F.lit("default"), F.col("doc"))).otherwise(D.as_object(F.col("doc")))
    entries = good.select("name", "version", F.explode(whole).alias("key", "e"))
    told = F.transform(D.as_list(member("e", "alternatives", "variant")), lambda a: F.struct(F.coalesce(member(a, "value"), F.try_variant_get(a, "$", "string")).alias("value"), member(a, "weight", "double").alias("weight"), member(a, "note").alias("note")))
    rows = entries.select("name", F.lower(F.trim("key")).alias("key"), value("e").alias("value"), F.coalesce(told, F.array().cast(ALTERNATIVES)).cast(ALTERNATIVES).alias("alternatives"), F.coalesce(member("e", "confidence", "double"), F.lit(0.75)).alias("confidence"),
                          F.coalesce(member("e", "source"), F.concat("name", F.lit(".json"))).alias("source"), F.coalesce(member("e", "rationale"), F.lit("")).alias("rationale"), "version")
    # a file that replaces the roughness table without a precise entry keeps none, as any other replaced table
    return base.join(good.select("name").distinct(), "name", "left_anti").unionByName(rows.where("value IS NOT NULL").select(*base.columns))


def drawing_facts(docs: DataFrame, key: str, column: str = "doc") -> DataFrame:
    """(key, material, tolerance, n_measures, has_roughness, precise) of drawing documents; a null document has no row.

    ``precise``: a measure's tolerance class names a precise fit.
    """
    anns = F.flatten(F.transform(D.as_list(F.try_variant_get(column, "$.views", "variant")), lambda v: F.coalesce(D.as_list(F.try_variant_get(v, "$.annotations", "variant")), F.array().cast("array<variant>"))))
    told = F.transform(anns, lambda a: F.struct(F.try_variant_get(a, "$.class", "string").alias("cls"), F.try_variant_get(a, "$.parsed.tolerance_class", "string").alias("fit")))
    rows = docs.where(F.col(column).isNotNull()).select(key, F.try_variant_get(column, "$.title_block.material", "string").alias("material"), F.try_variant_get(column, "$.title_block.tolerance", "string").alias("tolerance"), F.coalesce(told, F.array().cast("array<struct<cls string, fit string>>")).alias("a"))
    fits = lambda x: (x["cls"] == "Measure") & F.coalesce(x["fit"].rlike("|".join(PRECISE)), F.lit(False))
    return rows.select(key, F.nullif("material", F.lit("")).alias("material"), F.nullif("tolerance", F.lit("")).alias("tolerance"), F.size(F.filter("a", lambda x: x["cls"] == "Measure")).alias("n_measures"), F.exists("a", lambda x: F.coalesce(x["cls"] == "Roughness", F.lit(False))).alias("has_roughness"), F.coalesce(F.exists("a", fits), F.lit(False)).alias("precise"))


def drawing_gaps(facts: DataFrame, key: str, categories: list[str] | None = None) -> DataFrame:
    """The facts with (category, reason, original), a row for each gap of the wanted categories."""
    gap = lambda name, when, reason, original=F.lit(None).cast("string"): F.when(when, F.struct(F.lit(name).alias("category"), reason.alias("reason"), original.alias("original")))
    material = F.col("material")
    found = [
        gap("material", material.isNull() | is_ambiguous(material), F.when(material.isNull(), "missing").otherwise("ambiguous"), material),
        gap("tolerance_general", F.col("tolerance").isNull(), F.lit("missing")),
        gap("surface_roughness_default", ~F.col("has_roughness"), F.lit("no_roughness_annotation")),
        gap("process_sequence", F.lit(True), F.lit("always_suggest")),
        gap("qc_checklist", F.lit(True), F.lit("always_suggest")),
    ]
    rows = facts.select("*", F.explode(F.array_compact(F.array(*found))).alias("g")).select(*facts.columns, "g.*")
    return rows if categories is None else rows.where(F.col("category").isin(categories))


class StandIn:
    """A provider that always answers the same, as expressions: struct(suggested, alternatives, confidence, rationale)."""

    def answer(self, category: Column, original: Column) -> Column:
        text = F.when(category == "material", "SUS304 No.2D").otherwise("mock_suggestion")
        return F.struct(text.alias("suggested"), F.array().cast(ALTERNATIVES).alias("alternatives"), F.lit(0.65).alias("confidence"), F.lit("no model was asked").alias("rationale"))


def enrich_drawings(docs: DataFrame, key: str, knowledge: DataFrame, provider: StandIn | None = None, least: float = 0.70, categories: list[str] | None = None, column: str = "doc") -> DataFrame:
    """One record for each gap: (key, category, reason, original, suggested, steps, alternatives, confidence, method,
    source, rationale, evidence, version, flagged, hitl_reason).

    The first tier that suggests something wins: the knowledge table, then rules, then the provider; where none does, the
    method is ``hitl``. ``flagged``: a person looks, as the confidence is below ``least``. Evidence is an array of
    (type, value). The knowledge table joins by (name, key), broadcast only if Spark finds it small.
    """
    rows = drawing_gaps(drawing_facts(docs, key, column), key, categories)
    category, precise = F.col("category"), F.col("precise")
    name = F.when(category == "material", MATERIALS).when(category == "tolerance_general", TOLERANCES).when(category == "surface_roughness_default", ROUGHNESS)
    entry = F.when(category == "material", F.lower(F.trim("original"))).when((category == "surface_roughness_default") & precise, "precise").otherwise("default")
    table = knowledge.select(F.struct(*knowledge.columns).alias("kb_row"))
    rows = rows.withColumn("kb_name", name).withColumn("kb_key", entry).join(table, (F.col("kb_name") == F.col("kb_row.name")) & (F.col("kb_key") == F.col("kb_row.key")), "left")
    low = F.lower(F.coalesce("material", F.lit("")))
    steps = F.lit(None).cast("array<string>")
    for words, names in reversed(PROCESSES):
        steps = F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)) if words else F.lit(True), F.array(*map(F.lit, names))).otherwise(steps)
    none, no_proof = F.array().cast(ALTERNATIVES), F.array().cast("array<struct<type string, value string>>")
    proof = lambda kind, value: F.array(F.struct(F.lit(kind).alias("type"), value.cast("string").alias("value")))

    def record(suggested, alternatives, confidence, method, source, rationale, evidence, version=F.lit(None).cast("string")) -> Column:
        return F.struct(suggested.alias("suggested"), alternatives.alias("alternatives"), confidence.cast("double").alias("confidence"), method.alias("method"), source.alias("source"), rationale.alias("rationale"), evidence.alias("evidence"), version.alias("version"))

    known = F.col("kb_row.value").isNotNull()
    method = F.when(category == "surface_roughness_default", "heuristic").otherwise("deterministic")
    seen = F.when(category == "material", proof("kb_entry", F.col("kb_key"))).when(precise & (category == "surface_roughness_default"), proof("tolerance_class", F.lit("precise"))).otherwise(no_proof)
    told = (provider or StandIn()).answer(category, F.col("original"))
    asked = F.nullif(told["suggested"], F.lit(""))
    rule = F.concat(F.lit("by material, measures: "), F.col("n_measures").cast("string"))
    tier = (
        F.when(known, record(F.col("kb_row.value"), F.col("kb_row.alternatives"), F.col("kb_row.confidence"), method, F.col("kb_row.source"), F.col("kb_row.rationale"), seen, F.col("kb_row.version")))
        .when(category == "process_sequence", record(F.array_join(steps, ">"), none, F.lit(0.70), F.lit("heuristic"), F.lit("process_combination_catalog.json (inline)"), rule, proof("material", F.when(low == "", "unknown").otherwise(low))))
        .when(asked.isNotNull(), record(asked, told["alternatives"], told["confidence"], F.lit("llm"), F.lit("provider"), told["rationale"], no_proof))
        .otherwise(record(F.lit(None).cast("string"), none, F.lit(0.0), F.lit("hitl"), F.lit("cascade_failed"), F.lit("no tier suggests anything"), no_proof))
    )
    out = rows.withColumn("kb_tier", tier)
    flagged = (F.col("kb_tier.confidence") < least) | (F.col("kb_tier.method") == "hitl")
    reason = F.when(F.col("kb_tier.method") == "hitl", "no_suggestion_from_any_tier").when(F.col("kb_tier.confidence") < least, F.format_string(f"confidence %.2f < {least}", F.col("kb_tier.confidence")))
    fields = [F.col(f"kb_tier.{c}") for c in ("alternatives", "confidence", "method", "source", "rationale", "evidence", "version")]
    return out.select(key, "category", "reason", "original", F.col("kb_tier.suggested").alias("suggested"), F.when(category == "process_sequence", steps).alias("steps"), *fields, flagged.alias("flagged"), reason.alias("hitl_reason"))
