"""Known values of the rules, and invariants of what no SQL expresses."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.functions import numbers as N
from tessera.functions import structs as S
from tessera.functions import text as T
from tessera.operators import matching, metrics, splits
from tessera.plans import enrichment, gates
from tessera.sources import labels, sinks
from tessera.streaming import incremental


def value(spark, column, **inputs):
    rows = spark.range(1).select(*(F.lit(v).alias(k) for k, v in inputs.items())) if inputs else spark.range(1)
    return rows.select(column.alias("x")).first()["x"]


def test_precision_recall(spark):
    r = spark.range(1).select(*metrics.precision_recall_f1(F.lit(8), F.lit(2), F.lit(3))).first()
    assert (r.precision, r.recall, r.f1) == (0.8, 0.7273, 0.7619)
    r = spark.range(1).select(*metrics.precision_recall_f1(F.lit(0), F.lit(0), F.lit(0))).first()
    assert (r.precision, r.recall, r.f1) == (0.0, 0.0, 0.0)


def test_text_rules(spark):
    s = F.lit
    assert value(spark, T.fuzzy_match(s("DWG-001-A"), s("DWG-001-B"))) is True
    assert value(spark, F.levenshtein(s("kitten"), s("sitting"))) == 3 and value(spark, T.edit_ratio(s(""), s(""))) == 0.0
    assert value(spark, T.normalize_text(s("  a \t b  c "))) == "A B C" and value(spark, T.squeeze_text(s(" a b "))) == "AB"
    assert value(spark, T.split_notes(s("1. cut it\n2. bend it"))) == ["1. cut it", "2. bend it"]
    assert value(spark, T.split_notes(s("  cut ; bend.\n paint "))) == ["cut", "bend", "paint"]
    assert value(spark, T.bullet_items(s("- a\n\n2) b\n* c"))) == ["a", "b", "c"]
    assert value(spark, T.group_key_patch(s("d/11_jpeg.rf.8b46c563d114.jpg"))) == "11_jpeg"
    assert value(spark, T.group_key_patch(s("drawing__View_00__Measure_03.jpg"))) == "drawing"
    assert value(spark, T.group_key_pmi(s("0_Q-_01_jpg.rf.3979__PMI_000.jpg"))) == "0_Q-_01_jpg"
    assert [value(spark, T.language_by_script(s(x))) for x in ("도면", "図", "лист", "dwg", "")] == ["ko", "ja", "ru", "en", "en"]
    assert value(spark, T.pattern_count(s("Ø25.4 R2 90° 25 mm"), T.DIMENSIONS)) == 4 and value(spark, T.pattern_count(F.lit(None).cast("string"), T.DIMENSIONS)) == 0


@pytest.mark.parametrize(("a", "b", "same"), [(25.0, 25.005, True), (25.0, 26.0, False), (None, None, True), (1.0, None, False), (10000.0, 10009.0, True)])
def test_numbers(spark, a, b, same):
    assert value(spark, N.numerical_match(F.lit(a).cast("double"), F.lit(b).cast("double"))) is same


def test_filled_records(spark):
    none = F.lit(None).cast("double")
    m = value(spark, N.fill_measure(F.lit("Ø25.4 ±0.05"), none))
    assert (m.nominal, m.upper, m.lower, m.reason) == (25.4, 0.05, 0.05, "")
    m = value(spark, N.fill_measure(F.lit("8 +0.2 / -0.1"), none, signed_lower=True))
    assert (m.upper, m.lower) == (0.2, -0.1)
    assert value(spark, N.fill_measure(F.lit("none"), none)).reason == "no_numeric_in_ocr"
    g = value(spark, N.fill_gdt(F.lit("PERP 0.02 A B A C D")))
    assert (g.symbol, g.tolerance, g.datum) == ("⊥", 0.02, ["A", "B", "C"])
    assert value(spark, N.fill_roughness(F.lit("R a = 3.2"))).ra == 3.2 and value(spark, N.fill_roughness(F.lit("1.6"))).reason == "fallback_first_numeric"


def test_geometry(spark):
    box = lambda *v: tuple(F.lit(float(x)) for x in v)
    assert value(spark, G.bbox_iou(box(0, 0, 2, 2), box(1, 1, 3, 3))) == pytest.approx(1 / 7)
    assert value(spark, G.bbox_iou(box(0, 0, 0, 0), box(0, 0, 0, 0))) == 0.0
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    assert matching.polygon_iou(square, [(x + 1, y + 1) for x, y in square]) == pytest.approx(1 / 7)
    assert matching.polygon_iou(square, square[::-1]) == pytest.approx(1.0) and matching.polygon_iou(square, [(9, 9)] * 4) == 0.0
    quad = [(F.lit(x), F.lit(y)) for x, y in square]
    assert value(spark, G.quad_area(quad)) == 4.0 and value(spark, G.is_simple_quad(quad)) is True
    assert value(spark, G.is_simple_quad([quad[0], quad[2], quad[1], quad[3]])) is False
    assert value(spark, G.scale_points(F.lit("1,2;x,1;3;4,5"), F.lit(2.0))) == "2.00,4.00;8.00,10.00"


def test_greedy_match(spark):
    cols = "k int, cls string, pos int, x1 double, y1 double, x2 double, y2 double"
    p = spark.createDataFrame([(1, "a", 0, 0.0, 0.0, 2.0, 2.0, 0.5), (1, "a", 1, 0.0, 0.0, 2.0, 2.1, 0.9), (1, "b", 2, 0.0, 0.0, 2.0, 2.0, 0.9), (2, "a", 0, None, 0.0, 2.0, 2.0, None)], cols + ", conf double")
    g = spark.createDataFrame([(1, "a", 7, 0.0, 0.0, 2.0, 2.0), (3, "a", 1, 0.0, 0.0, 1.0, 1.0)], cols)
    got = {(r.k, r.cls, r.pos): r.gt_pos for r in matching.match_predictions(p, g, "k").collect()}
    assert got == {(1, "a", 1): 7, (1, "a", 0): None, (1, "b", 2): None, (2, "a", 0): None}
    m = {r.cls: (r.tp, r.fp, r.fn) for r in matching.detection_metrics(matching.match_predictions(p, g, "k"), g).collect()}
    assert m == {"a": (1, 2, 1), "b": (0, 1, 0), "_all": (1, 3, 1)}
    assert [r.pos for r in matching.suppress(p.where("k = 1 and cls = 'a'"), "k").collect()] == [1]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_notes_match_as_one_by_one(spark):
    import random

    draw = random.Random(5)
    note = lambda: draw.choice([None, "", "".join(draw.choice("ab") for _ in range(draw.randrange(1, 7)))])
    sides = [[(draw.choice([None, 1, 2, 3]), i, note()) for i in range(60)] for _ in range(2)]
    want = {}
    for k in (None, 1, 2, 3):
        p, g = ([r[2] or "" for r in rows if r[0] == k] for rows in sides)
        free, tp = list(range(len(g))), 0
        for x in p:
            ratio, j = min(((edit_distance(x, g[j]) / max(len(x), len(g[j]), 1), j) for j in free), default=(2.0, -1))
            if ratio <= 0.3:
                free.remove(j)
                tp += 1
        want[k] = (len(p), len(g), tp)
    p, g = (spark.createDataFrame(rows, "k int, pos int, note string") for rows in sides)
    assert {r.k: (r.n_pred, r.n_gt, r.tp) for r in matching.match_notes(p, g, "k", 0.3).collect()} == want
    assert matching.match_notes(p.limit(0), g.where("k = 1"), "k").first().tp == 0


def test_fuzzy_pairs_are_all_pairs(spark):
    import itertools
    import random

    draw = random.Random(3)
    names = {"".join(draw.choice("abc") for _ in range(draw.randrange(1, 15))) for _ in range(150)} | {"blue anvil", "old anvil", "", "é일b語xyzw", "일b語xyzw"}
    rows = spark.createDataFrame([(x,) for x in [*names, "blue anvil", None]], "s string")
    for most in (0.1, 0.3, 0.5):
        want = {tuple(sorted(p, key=str.encode)) for p in itertools.combinations(names, 2) if edit_distance(*p) / max(map(len, p)) <= most}
        got = matching.fuzzy_pairs(rows, "s", most).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
        assert most < 0.3 or ("é일b語xyzw", "일b語xyzw") in want or ("일b語xyzw", "é일b語xyzw") in want


def test_fuzzy_pairs_query_takes_every_name(spark, tmp_path):
    import itertools

    from tessera import catalogue_records as Q

    names = ["blue anvil", "glue anvil", "old anvil", "old anvils", "cold plate", "Bold plate", "nut"]
    rows = spark.createDataFrame([(n, "Brand#1") for n in [*names, "nut"]], "p_name string, p_brand string")
    rows.write.parquet(f"{tmp_path}/part.parquet")
    want = {tuple(sorted(p)) for p in itertools.combinations(names, 2) if edit_distance(*p) / max(map(len, p)) <= 0.3}
    assert ("blue anvil", "glue anvil") in want  # first letters differ
    got = Q.fuzzy_pairs(spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_folds_fill_the_smallest_first(spark):
    import random

    rows = spark.range(15000).select(F.when(F.col("id") < 5000, F.lit(-1)).otherwise(F.col("id")).alias("g"))
    load = {r.fold: r.load for r in splits.group_kfold(rows, "g", 5).groupBy("fold").agg(F.sum("n").alias("load")).collect()}
    assert sorted(load.values()) == [2500] * 4 + [5000]
    draw = random.Random(7)
    for _ in range(300):
        folds = draw.randrange(1, 7)
        one = [0] * folds
        many = [0] * folds
        for n in sorted(draw.sample(range(1, 40), draw.randrange(1, 6)), reverse=True):
            groups, dealt = draw.randrange(1, 40), []
            for _ in range(groups):
                f = min(range(folds), key=lambda i: (one[i], i))
                one[f] += n
                dealt.append(f)
            spans = splits._deal(many, n, groups)
            turn = [next((low, t) for low, t in reversed(spans) if low <= r) for r in range(groups)]
            assert [t[(r - low) % len(t)] for r, (low, t) in enumerate(turn)] == dealt and many == one


def test_splits_do_not_leak(spark):
    rows = spark.range(5000).select((F.col("id") % 137).alias("g"))
    folds = splits.group_kfold(rows, "g", 5)
    assert folds.count() == 137 and folds.select("g").distinct().count() == 137
    load = [r[0] for r in folds.groupBy("fold").agg(F.sum("n")).select("sum(n)").collect()]
    assert max(load) - min(load) <= 74
    two = splits.train_valid(rows, "g", 0.8)
    train = two.where("split = 'train'").agg(F.sum("n")).first()[0]
    assert abs(train - 4000) <= 40 and splits.leaks(rows.join(two, "g"), "g").count() == 0


def test_train_valid_skips_what_does_not_fit(spark):
    draw = random.Random(5)
    for sizes in ([10], [10, 1], [draw.choice([1, 1, 2, 9, 60]) for _ in range(40)], [draw.randint(1, 30) for _ in range(25)], [100, *[1] * 30]):
        rows = spark.createDataFrame([(g,) for g, n in enumerate(sizes) for _ in range(n)], "g long")
        for share in (0.4, 0.8):
            order = [r.g for r in rows.distinct().orderBy(F.xxhash64(F.lit(42), "g")).collect()]
            target, count, want = int(share * sum(sizes)), 0, set()
            for g in order:
                if count + sizes[g] / 2 <= target or not want:
                    want.add(g)
                    count += sizes[g]
            got = splits.train_valid(rows, "g", share).collect()
            assert {r.g for r in got if r.split == "train"} == want and {r.g: r.n for r in got} == dict(enumerate(sizes))


def test_deal_equal_is_one_by_one():
    draw = random.Random(6)
    for _ in range(200):
        loads, size, n = [draw.randrange(60) for _ in range(draw.randint(1, 7))], draw.randint(1, 25), draw.randrange(90)
        want = list(loads)
        for _ in range(n):
            want[want.index(min(want))] += size
        counts, got = splits.deal_equal(loads, size, n)
        assert got == want and sum(counts) == n


def test_answers_without_a_number_of_confidence(spark):
    from tessera.functions import records, structs

    said = ['{"confidence": null}', '{"confidence": "high"}', '{"confidence": 0.9}', '{"confidence": [1]}', "none", None, '{"confidence": NaN}']
    got = {r.k: r.confidence for r in structs.parse_answers(spark.createDataFrame(list(enumerate(said)), "k int, t string"), "k", "t").collect()}
    assert got == {0: 0.5, 1: 0.5, 2: 0.9, 3: 0.5, 4: 0.4, 5: 0.4, 6: 0.5}
    assert records._scalar("9" * 5000) == "9" * 5000


def test_overlap_with_no_polygon_is_null(spark):
    quad = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    rows = spark.createDataFrame([(1, quad, None), (2, quad, quad)], "k int, a array<struct<x:double,y:double>>, b array<struct<x:double,y:double>>")
    assert {r.k: r.iou for r in matching.polygon_ious(rows, "k").collect()} == {1: None, 2: 1.0}


@pytest.mark.parametrize(("v", "t", "d", "s", "want"), [(0.9, 0.8, "ge", "critical", "PASS"), (0.7, 0.8, "ge", "critical", "FAIL"), (0.7, 0.8, "ge", "warning", "WARN"), (0.7, 0.8, "le", "info", "PASS"), (None, 0.8, "ge", "critical", "INFO"), (0.7, 0.8, "between", "critical", "INFO")])
def test_gate(spark, v, t, d, s, want):
    assert value(spark, gates.status(F.lit(v).cast("double"), F.lit(t), F.lit(d), F.lit(s))) == want


def test_overall_of_nothing_passes(spark):
    assert gates.overall(spark.createDataFrame([], "status string")).first().overall == "PASS"
    assert gates.overall(spark.createDataFrame([("ERROR",), ("WARN",)], "status string")).first().overall == "WARN"


def test_enrichment(spark):
    docs = spark.createDataFrame([(1, "stainless", "", False, True), (2, "aluminum", "x", True, False), (3, None, None, False, False)], "k int, material string, tolerance string, has_roughness boolean, precise boolean")
    rows = {(r.k, r.category): (r.suggested, r.method, r.flagged) for r in enrichment.enrich(enrichment.gaps(docs, "k")).collect()}
    assert rows[1, "material"] == ("SUS304 No.2D", "deterministic", False) and rows[1, "surface_roughness_default"][0] == "Ra 1.6 μm"
    assert (2, "material") not in rows and (2, "tolerance_general") not in rows
    assert rows[3, "material"] == ("review material", "llm", True) and rows[3, "surface_roughness_default"][2] is True


def test_nested(spark):
    assert S.answer_json('x {"a": "}", "b": {"c": 1}} y') == {"a": "}", "b": {"c": 1}} and S.answer_json("nothing {") is None and S.answer_json(None) is None


def test_label_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_text("# note\n1 0.5 0.5 0.1 0.1\n\n1 0.5\nz 1 1 1 1\n2 0.1 y 0.2 0.3\n")
    (tmp_path / "a" / "empty.txt").write_text("")
    got = [(r.line_no, r.cls, r.error) for r in labels.read_labels(spark, str(tmp_path / "a")).orderBy("line_no").collect()]
    assert got == [(2, 1, ""), (4, None, "field_count"), (5, None, "not_a_number"), (6, 2, "not_a_number")]
    (tmp_path / "list.txt").write_text("a # x\n#b\n\nc\na\n")
    assert sorted(r.key for r in labels.read_list(spark, str(tmp_path / "list.txt")).collect()) == ["a", "c"]
    (tmp_path / "m.csv").write_text("﻿name, v \n a ,\n", encoding="utf-8")
    assert labels.read_manifest(spark, str(tmp_path / "m.csv")).collect() == [("a", "")]
    (tmp_path / "j").mkdir()
    for name, text in (("p.enriched.json", '{"a": 1}'), ("bad.json", "{"), ("_x.json", "{}"), ("manifest.json", "{}")):
        (tmp_path / "j" / name).write_text(text)
    assert {r.stem: r.bad for r in labels.read_json_documents(spark, str(tmp_path / "j")).select("stem", "bad").collect()} == {"p": False, "bad": True}
    rows = spark.createDataFrame([("train", 1, 0.5), ("valid", 2, 0.25)], "split string, c int, v double").withColumn("line", sinks.label_line(F.col("c"), F.col("v")))
    sinks.write_labels(rows, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out/split=valid")).first()[0] == "2 0.250000"


def test_incremental(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"id": 1}\n{"id": 1}\n{"id": 2}\n')
    seen = []
    schema = spark.createDataFrame([], "id long").schema
    for _ in range(2):
        incremental.ingest(spark, str(tmp_path / "in"), schema, "id", lambda df, _: seen.extend(r.id for r in df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert sorted(seen) == [1, 2]


def test_rotated_suppression_and_matching(spark):
    quad = lambda x, y, a=4.0: (x, y, x + a, y + a, x, y + 2 * a, x - a, y + a)  # noqa: E731 a square on its corner
    names = "k int, cls string, pos int, conf double, " + ", ".join(f"{c} double" for c in matching.QUADS.columns)
    rows = [(1, "a", 1, 0.9, *quad(0.0, 0.0)), (1, "a", 2, 0.8, *quad(0.5, 0.0)), (1, "a", 3, 0.7, *quad(20.0, 0.0)), (1, "b", 4, 0.6, *quad(0.0, 0.0)), (2, "a", 5, None, *quad(0.0, 0.0)), (2, "a", 6, 0.1, *[None] * 8)]
    boxes = spark.createDataFrame(rows, names)
    stay = lambda most: sorted(r.pos for r in matching.suppress(boxes, "k", most, matching.QUADS).collect())
    assert stay(0.5) == [1, 3, 4, 5, 6] and stay(0.99) == [1, 2, 3, 4, 5, 6]
    got = {r.pos: (r.gt_pos, r.iou) for r in matching.match_predictions(boxes, boxes.where("pos in (2, 3, 5)"), "k", shape=matching.QUADS).collect()}
    assert got == {1: (2, pytest.approx(0.777777, abs=0.1)), 2: (None, 0.0), 3: (3, 1.0), 4: (None, 0.0), 5: (5, 1.0), 6: (None, 0.0)}
    merged = matching.fold_union([boxes, boxes], "k", 0.5, matching.QUADS)
    assert sorted(r.pos for r in merged.where("pos < 4294967296").collect()) == [1, 3, 4, 5, 6]
    assert matching.fold_union([boxes.limit(0)], "k", 0.5, matching.QUADS).count() == 0


def test_recall_and_gates_without_truth(spark):
    hits = spark.createDataFrame([(1, 1), (1, None), (2, None)], "k int, gt_pos int")
    truth = spark.createDataFrame([(1,), (1,), (3,)], "k int")
    assert tuple(matching.drawing_recall(hits, truth, "k").first()) == (2, 0.25) and tuple(matching.drawing_recall(hits, truth, "k", 1.0).first()) == (3, 0.5)
    totals = spark.createDataFrame([("a", 9, 1), ("b", 0, 0)], "cls string, tp long, fn long")
    passed = lambda **how: {r.cls: (round(r.missing, 6), r.passed) for r in matching.missing_gate(totals, {"a": 0.1, "b": 0.5}, **how).collect()}
    assert passed() == {"a": (0.1, False), "b": (1.0, False)} and passed(unseen=0.0, strict=False) == {"a": (0.1, True), "b": (0.0, True)}
