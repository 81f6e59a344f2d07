"""The knowledge table and enrichment records with their provenance."""

import json

from pyspark.sql import functions as F

from tessera.plans import knowledge as K


def frame(spark, docs):
    return spark.createDataFrame([(k, None if d is None else json.dumps(d)) for k, d in docs.items()], "k string, t string").select("k", F.try_parse_json("t").alias("doc"))


def measure(fit=None, cls="Measure"):
    return {"class": cls, "parsed": {"nominal": 1} | ({"tolerance_class": fit} if fit else {})}


DOCS = {
    "plain": {"title_block": {"material": "stainless", "tolerance": ""}, "views": [{"annotations": [measure()]}, {}]},
    "fine": {"title_block": {"material": " Brass ", "tolerance": "x"}, "views": [{"annotations": [measure("25H7"), measure(cls="GDT")]}]},
    "full": {"title_block": {"material": "SUS304", "tolerance": "x"}, "views": [{"annotations": [measure(cls="Roughness"), measure(None)]}]},
    "empty": {},
    "null": None,
}


def records(spark, knowledge, **more):
    return {(r["k"], r["category"]): r for r in K.enrich_drawings(frame(spark, DOCS), "k", knowledge, **more).collect()}


def test_tiers_and_provenance(spark):
    got = records(spark, K.read_knowledge(spark))
    assert {k for k, _ in got} == {"plain", "fine", "full", "empty"} and len(got) == 5 + 4 + 2 + 5
    r = got["plain", "material"]
    assert (r["reason"], r["original"], r["suggested"], r["confidence"], r["method"], r["version"]) == ("ambiguous", "stainless", "SUS304 No.2D", 0.78, "deterministic", "built-in")
    assert [a["value"] for a in r["alternatives"]] == ["SUS304 BA", "SUS316L No.2D", "SUS430 No.2D"] and r["alternatives"][1]["weight"] == 0.15
    assert [tuple(e) for e in r["evidence"]] == [("kb_entry", "stainless")] and not r["flagged"] and r["hitl_reason"] is None
    assert got["plain", "tolerance_general"]["suggested"] == "ISO 2768-mK" and got["plain", "tolerance_general"]["method"] == "deterministic"
    r = got["plain", "surface_roughness_default"]
    assert (r["suggested"], r["confidence"], r["method"], r["flagged"], r["hitl_reason"]) == ("Ra 3.2 μm", 0.65, "heuristic", True, "confidence 0.65 < 0.7")
    r = got["fine", "surface_roughness_default"]
    assert (r["suggested"], r["confidence"], [a["value"] for a in r["alternatives"]], r["flagged"]) == ("Ra 1.6 μm", 0.78, ["Ra 0.8 μm"], False)
    assert got["fine", "material"]["suggested"] == "C2680" and ("fine", "tolerance_general") not in got
    r = got["full", "process_sequence"]
    assert r["steps"] == ["fiber_laser_cutting", "press_brake_bending", "deburring"] and r["suggested"] == ">".join(r["steps"]) and [tuple(e) for e in r["evidence"]] == [("material", "sus304")]
    assert got["empty", "process_sequence"]["evidence"][0]["value"] == "unknown" and got["empty", "material"]["reason"] == "missing"
    r = got["empty", "material"]
    assert (r["method"], r["suggested"], r["confidence"], r["flagged"]) == ("llm", "SUS304 No.2D", 0.65, True)


def test_a_file_takes_precedence(spark, tmp_path):
    (tmp_path / "material_catalog.json").write_text(json.dumps({"Stainless": {"primary": "X5CrNi18-10", "alternatives": ["X2", {"value": "X3", "weight": 1}]}, "odd": {"source": "none"}}))
    (tmp_path / "iso_2768_defaults.json").write_text("{broken")
    (tmp_path / "machining_roughness_table.json").write_text(json.dumps({"default": "Ra 12.5", "confidence": 0.9, "source": "shop"}))
    table = K.read_knowledge(spark, str(tmp_path))
    rows = {(r["name"], r["key"]): r for r in table.collect()}
    assert set(rows) == {(K.MATERIALS, "stainless"), (K.TOLERANCES, "default"), (K.ROUGHNESS, "default")}
    assert rows[K.TOLERANCES, "default"]["version"] == "built-in" and len(rows[K.MATERIALS, "stainless"]["version"]) == 64
    got = records(spark, table)
    r = got["plain", "material"]
    assert (r["suggested"], r["confidence"], r["source"], [tuple(a) for a in r["alternatives"]]) == ("X5CrNi18-10", 0.75, "material_catalog.json", [("X2", None, None), ("X3", 1.0, None)])
    assert got["plain", "surface_roughness_default"]["suggested"] == "Ra 12.5" and not got["plain", "surface_roughness_default"]["flagged"]
    assert got["fine", "material"]["method"] == "llm"  # brass is no longer known


def test_no_tier(spark):
    class Silent(K.StandIn):
        def answer(self, category, original):
            return super().answer(category, original).withField("suggested", F.lit(""))

    got = records(spark, K.read_knowledge(spark), provider=Silent(), categories=["qc_checklist"])
    assert {c for _, c in got} == {"qc_checklist"}
    r = got["empty", "qc_checklist"]
    assert (r["method"], r["suggested"], r["confidence"], r["flagged"], r["hitl_reason"], r["source"]) == ("hitl", None, 0.0, True, "no_suggestion_from_any_tier", "cascade_failed")
