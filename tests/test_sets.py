"""Lenient labels, folds, sinks, crawl rules, templates and transcripts: known values and edge cases."""

import json

from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.functions import records as R
from tessera.functions import text as T
from tessera.operators import crawl, metrics
from tessera.sources import labels as L
from tessera.sources import sinks


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def each(spark, f, *values):
    kind = next(("double" if isinstance(v, float) else "int" if isinstance(v, int) else "string" for v in values if v is not None), "string")
    return [value(spark, f(F.lit(v).cast(kind))) for v in values]


def test_documents_by_suffix_and_precedence(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.json", "sub/a.enriched.json", "b.alpha.json", "_x.json", "manifest.json"):
        (tmp_path / name).write_text("{}")
    found = L.preferred(L.read_json_documents(spark, str(tmp_path)))
    assert {(r.stem, r.file.endswith("a.enriched.json")) for r in found.collect()} == {("a", True), ("b.alpha", False)}
    flat = L.read_json_documents(spark, str(tmp_path), (".alpha", ".num"), recursive=False)
    assert sorted(r.stem for r in flat.collect()) == ["a", "b"]


def test_lenient_labels(spark):
    lines = spark.createDataFrame([("f", "0 x"), ("f", "4 .5 .5 .5 .5"), ("f", "9 1 1 1 1"), ("f", "-1 1 1 1 1"), ("g", ""), ("g", None)], "file string, line string")
    assert {tuple(r) for r in L.class_counts(lines, "file", "line", 5).collect()} == {("f", 1, 0, 0, 0, 1), ("g", 0, 0, 0, 0, 0)}
    assert sorted(r.cls for r in L.lenient_rows(lines, "line").collect()) == [-1, 4, 9] and [r.cls for r in L.lenient_rows(lines, "line", 5, [4]).collect()] == [4]


def test_training_logs(spark, tmp_path):
    for fold, scores in (("fold_0", ["0.5", "0.9", "0.9"]), ("fold_1", ["0.9", "", "x"])):
        (tmp_path / fold).mkdir()
        rows = [f"{i}, {s},{10 - i}" for i, s in enumerate(scores, 1)]
        (tmp_path / fold / "results.csv").write_text("\n".join(["epoch,  score ,loss", *rows, ""]))
    got = metrics.fold_results(L.read_epochs(spark, str(tmp_path)), "fold", "epoch", "score", ["score"], ["loss"])
    assert {tuple(r) for r in got.collect()} == {(0, 2.0, 0.9, 7.0), (1, 1.0, 0.9, 7.0)}
    assert metrics.best_fold(got, "fold", "score").first().fold == 0 and metrics.best_fold(got.where("score > 1"), "fold", "score").count() == 0


def test_thresholds_and_names():
    nodes = L.read_thresholds(json.dumps({"s1": {"acc": {"Table": {"threshold": 0.9}, "View": {"threshold": 0.8}}}}))
    assert L.threshold_of(nodes, "s1.acc.TitleBlock", {"Table": "TitleBlock"})["threshold"] == 0.9
    assert L.threshold_of(nodes, "s1.acc.View", {})["threshold"] == 0.8 and L.threshold_of(nodes, "s1.acc.Notes", {"Text": "Notes"}) is None
    assert L.class_names({"10": "c", "2": "b", "0": "a"}) == ["a", "b", "c"] and L.class_names(["x"]) == ["x"]


def test_files_with_labels(spark, tmp_path):
    for name, text in (("a.JPG", "x"), ("b.png", "x"), ("c.png", "x"), ("a.txt", "0"), ("b.txt", "")):
        (tmp_path / name).write_text(text)
    images, labels = L.list_files(spark, str(tmp_path)), L.list_files(spark, str(tmp_path), (".txt",))
    assert sorted(r.stem for r in images.collect()) == ["a", "b", "c"] and [r.stem for r in L.labelled(images, labels).collect()] == ["a"]
    assert sorted(r.stem for r in L.seed_stems([images, images]).collect()) == ["a", "b", "c"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(0, "train", "b"), (0, "train", "a"), (0, "val", "c")], "fold int, split string, file string")
    sinks.write_folds(rows, str(tmp_path / "folds"))
    assert [r.value for r in spark.read.text(str(tmp_path / "folds/fold=0/split=train")).collect()] == ["a", "b"]
    sinks.write_reasons(spark.createDataFrame([("r", "x"), ("r", "x"), ("s", "x")], "reason string, file string"), str(tmp_path / "skips"))
    assert [r.value for r in spark.read.text(str(tmp_path / "skips/reason=all")).collect()] == ["x"]
    sinks.write_manifest(rows, str(tmp_path / "m"), mark=True)
    assert all(f.read_bytes().startswith(b"\xef\xbb\xbf") for f in (tmp_path / "m").glob("*.csv")) and L.read_manifest(spark, str(tmp_path / "m")).columns[0] == "fold"
    assert "  1: b\n\nnc: 2" in sinks.data_yaml(["a", "b"], path="p")
    store, batch = str(tmp_path / "store"), spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id int, t string")
    first, second = sinks.append_records(batch, store, "id"), sinks.append_records(batch.union(spark.createDataFrame([(3, "d")], batch.schema)), store, "id")
    assert sorted(map(tuple, first.collect())) == [(1, "a"), (2, "c")] and [tuple(r) for r in second.collect()] == [(3, "d")]
    names = spark.createDataFrame([("1", "d", "a.png"), ("2", "d", "a.png"), ("3", "d", "b")], "file string, folder string, name string")
    assert [r.target for r in sinks.free_name(names, "folder", "name").orderBy("file").collect()] == ["d/a.png", "d/a_1.png", "d/b"]


def test_crawl_rules(spark):
    assert value(spark, crawl.hits(F.lit("A p&id, floor  plan and a FLOOR PLAN; umlaut"), crawl.EXCLUDED)) == ["floor plan", "P&ID"]
    assert each(spark, lambda c: crawl.allowed_licence(c, F.lit(None).cast("string")), "CC-BY-4.0", "x", None) == [True, False, False]
    assert each(spark, lambda c: crawl.licence_id(F.parse_json(c)), '{"license": {"id": "mit"}}', '{"license": "gpl"}', '{"license": {"x": 1}}', "{}") == ["mit", "gpl", '{"x":1}', None]
    url = lambda c: crawl.download_url(F.parse_json(c), "https://files/")
    assert each(spark, url, '{"links": {"download": "d", "self": "s"}}', '{"url": "u"}', '{"bucket": "b", "key": "k"}', '{"key": "k"}') == ["s", "u", "https://files/b/k", None]
    words = F.array(F.lit("k"))
    assert value(spark, crawl.searchable_text(F.lit("t"), F.lit("<b>d</b>"), words, F.lit(None).cast("array<string>"), F.lit(None).cast("string"))) == "t d k"


def test_texts(spark):
    assert each(spark, T.parts_list_hits, "Bill  of\nmaterials, qty", "수량", "", None) == [3, 1, 0, 0]
    assert each(spark, T.language_by_prefix, "KO_1.png", "x.png", None) == ["Korean", "Unknown", "Unknown"]
    assert each(spark, T.note_lines, " a \r\n\n b", "", None) == [["a", "b"], [], []]
    assert each(spark, T.assistant_answer, "User: q assistant : a\nb ", "<assistant>x</assistant>", "Assistant says", " z ") == ["a\nb", "x", "says", "z"]
    assert value(spark, R.utc_now()).endswith("+00:00")


def test_records(spark):
    made = json.loads(value(spark, R.template("Measure", F.lit("a.png"), F.lit("12.5 mm"))))
    assert made == {"type": "Measure", "nominal": None, "tolerance": None, "unit": "mm", "_review": {"source_image": "a.png", "completed": False, "ocr_hint": "12.5 mm", "ocr_numeric": "12.5"}}
    assert json.loads(value(spark, R.template("GDT", F.lit("a"), F.lit(None).cast("string"))))["_review"] == {"source_image": "a", "completed": False}
    assert value(spark, R.without_review(F.create_map(F.lit("a"), F.lit("1"), F.lit("_meta"), F.lit("2")))) == {"a": "1"}
    assert each(spark, R.route, "Table", "Notes", "Other", None) == ["title_block", "notes", None, None]
    assert each(spark, lambda c: R.confident(c, 0.25), 0.25, 0.2, None) == [True, False, False]
    no = F.lit(None).cast("string")
    notes = value(spark, R.region_record(F.lit("Notes"), F.lit("a\nb"), no))
    assert notes.items == ["a", "b"] or notes["items"] == ["a", "b"]
    assert value(spark, R.region_record(F.lit("title"), F.lit("t"), no))["fields"] == {"_raw_text": "t"} and value(spark, R.region_record(F.lit("title"), F.lit("t"), F.lit("e")))["raw"] is None
    rows = spark.createDataFrame([("d", 1, {"a": "1", "b": "2"}, ["x"]), ("d", 2, {"a": "", "b": "3"}, None), ("d", 3, None, ["y"])], "k string, o int, fields map<string,string>, items array<string>")
    merged = R.merge_regions(rows, "k", "o").first()
    assert (merged.title_block, merged.notes) == ({"a": "1", "b": "3"}, ["x", "y"])


def test_sizes_and_sets(spark):
    quad = [(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (10, 0), (10, 4.2), (0, 4.2))]
    assert tuple(value(spark, G.upright_size(quad))) == (10, 4) and tuple(value(spark, G.upright_size([quad[0]] * 4))) == (1, 1)
    assert each(spark, lambda w: G.large_enough(w, F.lit(20.0)), 5.0, 4.9, None) == [True, False, False]
    rows = spark.range(100)
    drawn = sorted(r.id for r in metrics.sample_rows(rows, "id", 10).collect())
    assert len(set(drawn)) == 10 and drawn == sorted(r.id for r in metrics.sample_rows(rows.repartition(3), "id", 10).collect())
    assert [r.id for r in metrics.unmatched(spark.createDataFrame([(1,), (1,), (2,), (None,)], "id int"), spark.createDataFrame([(2,)], "id int"), "id").orderBy(F.desc("id")).collect()] == [1, None]
    runs = spark.createDataFrame([(True, 1.26), (False, 2.0)], "ok boolean, s double")
    assert tuple(metrics.batch_summary(runs, "ok", "s").first()) == (2, 1, 1, 3.3, 1.65) and tuple(metrics.batch_summary(runs.limit(0), "ok", "s").first()) == (0, 0, 0, 0.0, 0.0)
    cells = spark.createDataFrame([(0, 0, 3), (0, 1, 1), (2, 1, 4), (2, 0, 4)], "actual int, predicted int, n long")
    assert tuple(metrics.confusion_rate(cells, 2).first()) == (1, 4, 0.25) and tuple(metrics.false_positive_rate(cells, 1, 2).first()) == (4, 8, 0.5)
    assert {tuple(r) for r in metrics.class_accuracy(cells, 2).collect()} == {(0, 0.75)} and tuple(metrics.confusion_rate(cells.limit(0), 2).first()) == (0, 0, 0.0)


def test_split_by_exact_numbers_of_groups(spark):
    import hashlib
    import math

    from tessera.operators import splits

    def sizes(n):
        test = min(math.ceil(0.1 * n), max(0, n - 1))
        valid = min(math.ceil(0.2 / (0.7 + 0.2) * (n - test)), max(0, n - test - 1))
        return n - test - valid, valid, test

    assert [splits.split_sizes(n) for n in range(400)] == [sizes(n) for n in range(400)]
    assert [splits.split_sizes(n) for n in (0, 1, 2, 3)] == [(0, 0, 0), (1, 0, 0), (1, 0, 1), (1, 1, 1)]
    for n in (0, 1, 2, 3, 57):
        rows = spark.createDataFrame([(f"g{k % n}", k) for k in range(3 * n)] + [(None, 0)], "g string, k int")
        got = {r["g"]: r["split"] for r in splits.group_split(rows, "g").collect()}
        order = lambda seed, names: sorted(names, key=lambda g: hashlib.md5(f"{seed}/{g}".encode()).hexdigest())
        names = [f"g{k}" for k in range(n)]
        test = order(42, names)[: sizes(n)[2]]
        valid = order(43, [g for g in names if g not in test])[: sizes(n)[1]]
        assert got == {g: "test" if g in test else "valid" if g in valid else "train" for g in names}
    many = spark.range(300_000).selectExpr("id AS g")
    counts = {r["split"]: r["count"] for r in splits.group_split(many, "g").groupBy("split").count().collect()}
    assert counts == dict(zip(("train", "valid", "test"), sizes(300_000)))
