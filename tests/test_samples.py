"""Tag strings there and back, and samples from files."""

import json

from hypothesis import given
from hypothesis import strategies as st

from tessera.functions.records import document_to_tags, tags_to_document
from tessera.sources import samples as S

WORDS = st.text(st.sampled_from("abcxyz ÄØ-+/."), min_size=1, max_size=12).map(lambda t: "w" + t.strip() + "w")
SCALARS = st.one_of(st.none(), st.booleans(), st.integers(-(10**9), 10**9), st.floats(-1e6, 1e6, allow_nan=False).map(lambda x: round(x, 4)), WORDS)


def members(level: int, value):
    return st.dictionaries(st.sampled_from([f"{c}{level}" for c in "pqrst"]), value, max_size=4)


#: Names differ from level to level; lists are of scalars and stand at the top, as in the records that are trained on.
NESTED = members(0, st.one_of(SCALARS, st.lists(SCALARS, min_size=2, max_size=4), members(1, st.one_of(SCALARS, members(2, SCALARS).filter(bool))).filter(bool)))


@given(NESTED)
def test_tags_there_and_back(document):
    assert tags_to_document(document_to_tags(document)) == document


def test_tags():
    assert document_to_tags({"type": "Measure", "nominal": 25.0, "unit": "mm"}) == "<s_nominal>25.0</s_nominal><s_unit>mm</s_unit>"
    assert document_to_tags({"datum": ["A", "B"], "tolerance": {"upper": 0.1, "lower": None}, "on": True}) == "<s_datum>A<sep/>B</s_datum><s_tolerance><s_upper>0.1</s_upper><s_lower></s_lower></s_tolerance><s_on>true</s_on>"
    assert [document_to_tags(x) for x in ({}, [], None, "x", 3)] == ["", "", "", "x", "3"]


def test_samples_from_files(spark, tmp_path):
    def put(name, document=None, image=True):
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        if image:
            (at.parent / f"{at.name}.jpg").write_bytes(b"x")
        if document is not None:
            (at.parent / f"{at.name}.json").write_text(document if isinstance(document, str) else json.dumps(document))

    put("Measure/d1.rf.abc__View_2", {"nominal": 5, "tolerance": {"upper": 0.1, "lower": -0.1}})
    put("x/d2__View_1__GDT_3.v2", {"type": "GDT", "symbol": "⏤", "datum": ["A", "B"]})
    put("Measure/d3__Roughness_1", {"type": "Roughness", "Ra": 3.2, "on": False})
    put("GDT/a/b/d4", {"type": "", "symbol": "○"})
    put("GDT/a/b/c/d5", {"symbol": "○"})  # the folder is too far up
    put("Measure/d6", {"type": "Other"})
    put("Measure/d7", "{broken")
    put("Measure/d8", None)
    put("Measure/d9", {"nominal": 1}, image=False)
    rows = {r["file"].rpartition("/")[2]: (r["cls"], r["target"], r["group_key"]) for r in S.read_samples(spark, str(tmp_path)).collect()}
    assert rows == {
        "d1.rf.abc__View_2.jpg": ("Measure", "<s_measure><s_nominal>5</s_nominal><s_tolerance><s_upper>0.1</s_upper><s_lower>-0.1</s_lower></s_tolerance>", "d1"),
        "d2__View_1__GDT_3.v2.jpg": ("GDT", "<s_gdt><s_symbol>⏤</s_symbol><s_datum>A<sep/>B</s_datum>", "d2"),
        "d3__Roughness_1.jpg": ("Roughness", "<s_roughness><s_Ra>3.2</s_Ra><s_on>false</s_on>", "d3"),
        "d4.jpg": ("GDT", "<s_gdt><s_symbol>○</s_symbol>", "d4"),
    }
