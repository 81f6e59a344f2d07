"""Records, summaries, suites, reports and paged sources: known values and edge cases."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import records as R
from tessera.operators import summaries
from tessera.plans import reports, suites
from tessera.sources import labels
from tessera.sources import records as P


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tags_and_documents(spark):
    assert R.tags_to_document("<s_nominal>25.4</s_nominal><s_unit></s_unit><s_tol><s_upper>1</s_upper></s_tol><s_datum>A<sep/>B</s_datum>") == {"nominal": 25.4, "unit": None, "tol": {"upper": 1}, "datum": ["A", "B"]}
    assert R.tags_to_document(None) == {} and R.tags_to_document("x <s_a>1") == {} and R.tags_to_document("<s_a><s_b>true</s_b>") == {"b": True}
    rows = spark.createDataFrame([(1, "<s_a>-3</s_a>"), (2, None)], "k int, t string")
    assert {r.k: r.doc for r in R.decode_tags(rows, "k", "t").collect()} == {1: '{"a": -3}', 2: "{}"}


def test_flags(spark):
    m = lambda n, u, low: F.struct(F.lit(n).cast("double").alias("nominal"), F.lit(u).cast("double").alias("upper"), F.lit(low).cast("double").alias("lower"))
    assert tuple(value(spark, R.measure_flags(m(25.0, 0.1, 0.1), m(25.005, 0.1, 0.1)))) == (True, True)
    assert tuple(value(spark, R.measure_flags(m(None, None, None), m(None, None, None)))) == (True, True)
    assert tuple(value(spark, R.measure_flags(m(1.0, 0.1, None), m(2.0, None, None)))) == (False, False)
    g = lambda s, d: F.struct(F.lit(s).alias("symbol"), (F.array(*map(F.lit, d)) if d else F.lit(None).cast("array<string>")).alias("datum"))
    assert tuple(value(spark, R.gdt_flags(g("⊥", ["A", "B"]), g("⊥", ["B", "A"])))) == (True, False)
    assert tuple(value(spark, R.gdt_flags(g("⊥", []), g("∥", [])))) == (False, True)
    assert value(spark, R.roughness_correct(F.lit(3.2), F.lit(3.24))) is True
    assert [value(spark, R.answered(F.lit(a))) for a in (" N/A ", "x ", "", None)] == [None, "x", None, None]
    assert [value(spark, R.internal_class(F.lit(c))) for c in ("Table", "View", None)] == ["TitleBlock", "View", None]
    assert tuple(value(spark, R.patch_name(F.lit("a__PMI_012.jpg")))) == ("a", 12) and tuple(value(spark, R.patch_name(F.lit("a.jpg")))) == ("a.jpg", -1)
    assert [value(spark, c) for c in R.center_to_corners(F.lit(0.5), F.lit(0.5), F.lit(2.0), F.lit(0.5), F.lit(100), F.lit(40))] == [0, 10, 99, 30]
    assert value(spark, R.normalised(F.array(F.lit(5.0), F.lit(5.0)), F.lit(10), F.lit(0))) == [0.5, 5.0]


def test_annotations(spark):
    doc = {"views": [{"view_id": "v", "annotations": [{"class": "GDT", "obb_global": [[1, 2]], "conf": 0.5}, {"class": "GDT", "obb": [[3, 4]]}, {"class": "x"}]}, {"view_id": "w", "annotations": None}]}
    rows = spark.createDataFrame([(1, json.dumps(doc)), (2, "{"), (3, None)], "k int, d string")
    got = sorted((r.view, r.pos, r.cls, r.obb, r.conf) for r in R.annotations(rows, "k", "d").collect())
    assert got == [("v", 0, "GDT", [[1.0, 2.0]], 0.5), ("v", 1, "GDT", [[3.0, 4.0]], 0.0)]


def test_summaries(spark):
    rows = spark.createDataFrame([(1, "", 2.0), (1, "b", None), (1, "a", None), (None, "", 1.0)], "n int, why string, v double")
    got = {r.n: (r.total, r.filled, r.rate, r.top_reason, r.has_v) for r in summaries.fill_report(rows, "n", F.col("why"), {"v": F.col("v")}).collect()}
    assert got == {1: (3, 1, 0.3333, "a", 1), None: (1, 1, 1.0, "", 1)}
    skips = spark.createDataFrame([("x", "f"), ("y", "f"), ("x", "f"), ("x", "g")], "reason string, file string")
    assert {r.category: r["count"] for r in summaries.skip_summary(skips, 10).collect()} == {"x": 2, "y": 1, "TOTAL": 3}
    assert [r["count"] for r in summaries.skip_summary(skips.limit(0), 0).collect()] == [0]
    assert sorted((r.cls, r.n, r.ratio) for r in summaries.class_distribution(rows.limit(0), "why", ["a", "b"]).collect()) == [("a", 0, 0.0), ("b", 0, 0.0)]
    kept, bare = summaries.drop_skipped(spark.createDataFrame([(1, "S"), (1, None), (2, "S")], "k int, c string"), "k", "c", "S")
    assert kept.count() == 1 and [r.k for r in bare.collect()] == [2]
    groups = summaries.group_shuffle(spark.range(4000).select(F.col("id").alias("g")), "g")
    n = {r.split: r["count"] for r in groups.groupBy("split").count().collect()}
    assert sum(n.values()) == 4000 and abs(n["train"] - 2800) < 150 and abs(n["test"] - 400) < 100
    side = lambda name: spark.createDataFrame([("d", "GDT", 5, "a"), ("d", "GDT", 7, "b")], f"k string, c string, o int, {name} string")
    assert sorted((r.x, r.y) for r in summaries.join_by_ordinal(side("x"), side("y").where("o = 7"), "k", "c", "o").collect()) == [("a", "b"), ("b", None)]


def test_label_suites(spark):
    files = spark.createDataFrame([("a",), ("b",)], "file string")
    rows = spark.createDataFrame([("a", 0, [0.5, 0.5, 0.2, 0.2], ""), ("a", 1, [1.5, 0.5, 0.2, 0.2], ""), ("a", None, None, "field_count")], "file string, cls int, values array<double>, error string")
    got = {(r.name, r.cls): (round(r.value, 4), r.status) for r in suites.box_label_suite(files, rows, ["PMI", "View"]).collect()}
    assert got[("empty_label_rate", "")] == (0.5, "FAIL") and got[("parse_error_rate", "")] == (0.3333, "FAIL") and got[("validity_rate", "")] == (0.5, "FAIL")
    assert got[("class_ratio", "PMI")] == (0.5, "PASS") and got[("small_rate", "")] == (0.0, "PASS")
    none = {r.name: r.status for r in suites.box_label_suite(files.limit(0), rows.limit(0), ["PMI"]).collect()}
    assert none["validity_rate"] == "INFO" and none["empty_label_rate"] == "PASS"
    quads = spark.createDataFrame([(0, [0.1, 0.1, 0.5, 0.1, 0.5, 0.3, 0.1, 0.3]), (1, [0.1, 0.1, 0.5, 0.4, 0.4, 0.5, 0.0, 0.2])], "cls int, values array<double>")
    got = {(r.name, r.cls): (r.value, r.status) for r in suites.quad_label_suite(quads, ["Measure", "Roughness"]).collect()}
    assert got == {("validity_rate", ""): (1.0, "PASS"), ("non_axis_aligned_rate", ""): (0.5, "PASS"), ("class_count", "Measure"): (1.0, "INFO"), ("class_count", "Roughness"): (1.0, "WARN")}


def test_run_suite_and_reports(spark):
    docs = spark.createDataFrame([(0.9, 10.0, False), (0.5, 20.0, True)], "f1 double, seconds double, failed boolean")
    rows = reports.rows_of(suites.run_suite(docs))
    assert {r["name"]: (r["value"], r["status"]) for r in rows} == {"field_f1": (0.7, "FAIL"), "seconds_per_drawing": (15.0, "PASS"), "failure_rate": (0.5, "FAIL")}
    assert reports.overall(rows) == "FAIL" and not reports.succeeded(rows) and reports.succeeded([])
    assert json.loads(reports.as_json(rows))["counts"]["FAIL"] == 2 and "| end_to_end | field_f1 |" in reports.as_markdown(rows)
    assert "<td>0.7000</td>" in reports.as_html([r | {"cls": "<b>"} for r in rows]) and "<b>" not in reports.as_html([r | {"cls": "<b>"} for r in rows])
    assert reports.as_text(rows).endswith("overall: FAIL\n") and reports.shown(12345.67) == "12345.7"


def test_annotation_xml(spark, tmp_path):
    box = '<box label="{}" xtl="1.0" ytl="2.0" xbr="3.333" ybr="4.0">{}</box>'
    (tmp_path / "a.xml").write_text(
        '<annotations><image name="d/x.jpg" width="10" height="5">' + box.format("SKIP", '<attribute name="reason"> blur </attribute>') + box.format("SKIP", "") + "</image>"
        '<image name="y.jpg" width="10" height="5">' + box.format("PMI", "") + "</image></annotations>"
    )
    got = sorted((r.reason, r.file) for r in labels.skip_reasons(spark, str(tmp_path / "a.xml")).collect())
    assert got == [("blur", "x.jpg"), ("stage1_fp_other", "x.jpg")]
    r = labels.scaled_boxes(spark, str(tmp_path / "a.xml"), 1.5).where("label = 'PMI'").first()
    assert (r.image, r.width, r.height, r.xtl, r.xbr) == ("y.jpg", 15, 8, 1.5, 5.0)
    rows = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    assert labels.one_of_each(rows, "k", [F.desc("v")]).collect() == [("a", 2)]
    assert [value(spark, labels.is_true(F.lit(v))) for v in (" TB", "0", None)] == [1, 0, 0]


def test_envelopes(spark):
    shapes = [[1], {"results": [1, 2]}, {"data": {"hits": [{"id": 1}]}}, {"hits": {"hits": []}}, {"id": 4}, {"x": 1}]
    assert [len(P.items_of(s)) for s in shapes] == [1, 2, 1, 0, 1, 0] and P.items_of(None) == []
    rows = spark.createDataFrame([(json.dumps(s),) for s in shapes] + [("{",), (None,)], "t string")
    assert [r.n for r in rows.select(F.size(P.items_column(F.col("t"))).alias("n")).collect()] == [1, 2, 1, 0, 1, 0, 0, 0]


@pytest.mark.parametrize("total", [7, None])
def test_paged_source(spark, total):
    class Seven(P.PagedRecords):
        @classmethod
        def name(cls):
            return f"seven_{total}"

        def fetch(self, page, size):
            items = [{"id": i} for i in range(7)][(page - 1) * size : page * size]
            return {"total": total, "results": items} if total else {"results": items}

    spark.dataSource.register(Seven)
    read = lambda **o: sorted(json.loads(r.record)["id"] for r in spark.read.format(f"seven_{total}").options(**o).load().collect())
    assert read(size="2", pages="1") == list(range(7)) and read(size="3", most="4") == [0, 1, 2, 3]
