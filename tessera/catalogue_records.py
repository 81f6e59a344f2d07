"""Queries of records, summaries and validation suites."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalogue import _CASCADE, _E, _LEAVES, _TEXTS, _compared, _detections, _dims, _drawings, _texts, query, table
from tessera.functions import geometry as G
from tessera.functions import numbers as N
from tessera.functions import records as R
from tessera.functions import structs as S
from tessera.functions import text as T
from tessera.operators import matching, summaries
from tessera.plans import enrichment, suites
from tessera.sources import records as P


@query(rf"{_TEXTS} SELECT k, n, nullif(regexp_extract(s, '(-?\d+(?:\.\d+)?)', 1), '') AS hint FROM s")
def numeric_hint(spark, sf_dir):
    return _texts(spark, sf_dir).select("k", "n", R.numeric_hint(F.col("s")).alias("hint"))


@query(rf"""{_TEXTS}, f AS (SELECT n, CASE WHEN s LIKE 'Flatness%' THEN '' ELSE 'no_gdt_symbol_match' END AS reason, s LIKE 'Flatness%' AS sym FROM s)
SELECT n, count(*) AS total, count(*) FILTER (reason = '') AS filled, round(count(*) FILTER (reason = '') / count(*), 4) AS rate, coalesce(max(nullif(reason, '')), '') AS top_reason, count(*) FILTER (sym) AS has_symbol, count(*) FILTER (sym) AS has_tolerance FROM f GROUP BY n""")
def fill_report(spark, sf_dir):
    rows = _texts(spark, sf_dir).withColumn("g", N.fill_gdt(F.col("s")))
    return summaries.fill_report(rows, "n", F.col("g.reason"), {"symbol": F.col("g.symbol"), "tolerance": F.col("g.tolerance")})


@query(f"""SELECT vec_id, concat_ws(',', CASE WHEN label >= 8 THEN 'class_out_of_range' END, CASE WHEN e0 < 0 OR e0 > 1 OR e1 < 0 OR e1 > 1 THEN 'center_out_of_range' END,
 CASE WHEN e2 <= 0 OR e2 > 1 THEN 'width_out_of_range' END, CASE WHEN e3 <= 0 OR e3 > 1 THEN 'height_out_of_range' END) AS issues FROM {_E}""")
def bbox_validate(spark, sf_dir):
    e = [F.col(f"e{i}") for i in range(4)]
    return _dims(spark, sf_dir, 4).select("vec_id", F.array_join(G.bbox_issues(F.col("label"), *e, 8), ",").alias("issues"))


@query("SELECT o_custkey AS frame, count(*) FILTER (o_orderstatus <> 'F') AS kept FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderstatus <> 'F') > 0 UNION ALL SELECT o_custkey, 0 FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderstatus <> 'F') = 0")
def skip_filter(spark, sf_dir):
    kept, bare = summaries.drop_skipped(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", "F")
    frame = F.col("o_custkey").alias("frame")
    return kept.groupBy(frame).agg(F.count(F.lit(1)).alias("kept")).unionByName(bare.select(frame, F.lit(0).cast("long").alias("kept")))


def _half_even(x: str) -> str:
    return f"CAST(round_even({x}, 0) AS INT)"


_X1, _Y1 = f"greatest(0, least({_half_even('p_size * 1.5 - 10')}, 39))", f"greatest(0, least({_half_even('p_retailprice / 20')}, 79))"


@query(f"SELECT p_partkey, {_X1} AS x1, {_Y1} AS y1, greatest({_X1} + 1, least({_half_even('p_size * 2.5')}, 40)) AS x2, greatest({_Y1} + 1, least({_half_even('p_retailprice / 15')}, 80)) AS y2 FROM part")
def clamp_boxes(spark, sf_dir):
    size, price = F.col("p_size"), F.col("p_retailprice")
    corners = G.clamp_bbox((size * 1.5 - 10, price / 20, size * 2.5, price / 15), F.lit(40), F.lit(80))
    return table(spark, sf_dir, "part").select("p_partkey", *(c.alias(n) for c, n in zip(corners, ("x1", "y1", "x2", "y2"), strict=True)))


@query("SELECT l_returnflag AS cls, CAST(count(*) AS BIGINT) AS n, round(count(*) / (SELECT count(*) FROM lineitem WHERE l_returnflag IN ('A', 'R')), 4) AS ratio FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1 UNION ALL SELECT 'X', 0, 0.0")
def class_distribution(spark, sf_dir):
    return summaries.class_distribution(table(spark, sf_dir, "lineitem"), "l_returnflag", ["A", "R", "X"])


@query("WITH s AS (SELECT DISTINCT o_orderpriority AS reason, o_custkey AS file FROM orders), c AS (SELECT CASE WHEN grouping(reason) = 1 THEN 'TOTAL' ELSE reason END AS category, count(*) AS count FROM s GROUP BY GROUPING SETS ((reason), ())) SELECT category, count, round(count / (SELECT count(*) FROM s), 4) AS ratio_of_skip, round(count / 150000.0, 4) AS ratio_of_total FROM c")
def skip_summary(spark, sf_dir):
    skips = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("reason"), F.col("o_custkey").alias("file"))
    return summaries.skip_summary(skips, 150000)


_CLIP = f"SELECT label, greatest({', '.join(f'abs(e{i} - least(greatest(e{i}, 0.0), 1.0))' for i in range(4))}) AS d FROM {_E}"


@query(f"WITH d AS ({_CLIP}), f AS (SELECT label, count(*) AS n, count(*) FILTER (d > 0) AS c, max(d) AS d FROM d GROUP BY 1) SELECT count(*) AS files, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(c) AS BIGINT) AS changed, max(d) FILTER (d > 0) AS most, min(d) FILTER (d > 0) AS least FROM f")
def clip_summary(spark, sf_dir):
    delta = F.greatest(*(F.abs(F.col(f"e{i}") - G.clamp(F.col(f"e{i}"), 0.0, 1.0)) for i in range(4)))
    return summaries.clip_summary(_dims(spark, sf_dir, 4).withColumn("d", delta), "label", "d")


@query("SELECT p_brand, count(*) AS n, min(p_size) AS min_p_size, avg(p_size) AS avg_p_size, max(p_size) AS max_p_size FROM part GROUP BY 1")
def size_summary(spark, sf_dir):
    return summaries.size_summary(table(spark, sf_dir, "part"), "p_brand", ["p_size"])


@query("SELECT l_orderkey, l_linenumber, l_returnflag, CAST(row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS INT) AS ordinal FROM lineitem")
def class_ordinals(spark, sf_dir):
    rows = summaries.ordinals(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_returnflag"], ["l_linenumber", "l_partkey", "l_suppkey"])
    return rows.select("l_orderkey", "l_linenumber", "l_returnflag", "ordinal")


@query("SELECT p_partkey AS k, (levenshtein(p_name, p_type) + levenshtein(p_brand, p_type)) / 2 AS distance FROM part")
def mean_edit_distance(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("p_a"), F.col("p_type").alias("g_a"), F.col("p_brand").alias("p_b"), F.col("p_type").alias("g_b"))
    return summaries.mean_edit_distance(rows, "k", ["a", "b"])


@query("SELECT a.p_name AS a, b.p_name AS b FROM (SELECT DISTINCT p_name FROM part) a JOIN (SELECT DISTINCT p_name FROM part) b ON a.p_name < b.p_name WHERE levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)) <= 0.3")
def fuzzy_pairs(spark, sf_dir):
    return matching.fuzzy_pairs(table(spark, sf_dir, "part"), "p_name", 0.3)


@query("SELECT a.p_name AS a, b.p_name AS b FROM (SELECT DISTINCT p_name FROM part) a JOIN (SELECT DISTINCT p_name FROM part) b ON a.p_name < b.p_name WHERE levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)) <= 0.3")
def fuzzy_pairs_all(spark, sf_dir):
    return matching.fuzzy_pairs(table(spark, sf_dir, "part"), "p_name", 0.3)


@query(r"SELECT conv_id, turn, len(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '^\s*(?:[-*•]|\d+[.)])\s*', ''))), lambda x: x <> ''))::INT AS items FROM conversations")
def bullet_items(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(T.bullet_items(F.col("text"))).alias("items"))


@query("""WITH r AS (SELECT l_linenumber AS n, l_quantity AS g, CASE WHEN l_partkey % 4 = 0 THEN l_quantity + 1 ELSE l_quantity + 0.005 END AS p, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_tax END AS pu, CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE l_tax END AS gu FROM lineitem)
SELECT n, avg(CAST(abs(p - g) <= greatest(0.01, 0.001 * greatest(abs(p), abs(g))) AS INT)) AS nominal, avg(CAST((pu IS NULL) = (gu IS NULL) AS INT)) AS tolerance FROM r GROUP BY n""")
def measure_flags(spark, sf_dir):
    q, k, tax, none = F.col("l_quantity"), F.col("l_partkey"), F.col("l_tax"), F.lit(None).cast("double")
    record = lambda n, u: F.struct(n.alias("nominal"), u.alias("upper"), u.alias("lower"))
    p, g = record(F.when(k % 4 == 0, q + 1).otherwise(q + 0.005), F.when(k % 3 != 0, tax)), record(q, F.when(k % 6 != 0, tax).otherwise(none))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("n"), R.measure_flags(p, g).alias("f"))
    return rows.groupBy("n").agg(F.avg(F.col("f.nominal_correct").cast("int")).alias("nominal"), F.avg(F.col("f.tolerance_correct").cast("int")).alias("tolerance"))


@query("SELECT l_orderkey, l_linenumber, '{\"nominal\": ' || CAST(l_quantity AS BIGINT) || ', \"unit\": ' || CASE WHEN l_linenumber % 2 = 0 THEN '\"mm\"' ELSE 'null' END || '}' AS doc FROM lineitem")
def donut_decode(spark, sf_dir):
    tags = S.to_tags({"nominal": F.col("l_quantity").cast("long"), "unit": F.when(F.col("l_linenumber") % 2 == 0, "mm")})
    rows = table(spark, sf_dir, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("k"), tags.alias("t"))
    return R.decode_tags(rows, "k", "t").select("k.*", "doc")


@query("SELECT o_orderkey, json_array_length(CASE o_orderkey % 4 WHEN 0 THEN '[1,2]' WHEN 1 THEN '[{\"id\": 3}]' WHEN 2 THEN '[4]' ELSE '[]' END)::INT AS items FROM orders")
def record_envelopes(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, '{"results": [1, 2]}').when(k == 1, '{"id": 3}').when(k == 2, '{"data": {"hits": [4]}}').otherwise("broken {")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.size(P.items_column(text)).alias("items"))


@query(f"{_CASCADE} SELECT method, count(*) AS n, count(*) FILTER (confidence < 0.70) AS flagged FROM e GROUP BY 1")
def hitl_gate(spark, sf_dir):
    rows = enrichment.enrich(enrichment.gaps(_drawings(spark, sf_dir), "k"))
    return rows.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.count_if("flagged").alias("flagged"))


@query(f"""{_CASCADE}, v AS (SELECT avg(CAST(method = 'llm' AS INT)) AS llm_method_rate, avg(CAST(confidence < 0.70 AS INT)) AS flag_rate, avg(CAST(coalesce(suggested, '') = '' AS INT)) AS empty_rate, 1.0::DOUBLE AS provenance FROM e)
SELECT name, value, CASE WHEN (name = 'provenance' AND value >= 1) OR (name <> 'provenance' AND value <= CASE name WHEN 'llm_method_rate' THEN 0.4 WHEN 'flag_rate' THEN 0.25 ELSE 0.1 END) THEN 'PASS' WHEN name = 'provenance' THEN 'FAIL' ELSE 'WARN' END AS status FROM (UNPIVOT v ON COLUMNS(*) INTO NAME name VALUE value)""")
def enrichment_suite(spark, sf_dir):
    rows = enrichment.enrich(enrichment.gaps(_drawings(spark, sf_dir), "k"))
    return suites.enrichment_suite(rows).select("name", "value", "status")


@query("""WITH r AS (SELECT p_brand AS lang, CASE WHEN p_size < 5 THEN 'manual_review' WHEN p_size < 30 THEN 'stage1_titleblock' ELSE 'stage2_no_titleblock' END AS d, p_retailprice > 1400 AS a FROM part),
v AS (SELECT '' AS cls, avg(CAST(d = 'manual_review' AS INT)) AS value, 'manual_review_rate' AS name FROM r UNION ALL SELECT '', 0.0, 'error_rate' UNION ALL SELECT '', avg(CAST((d = 'stage1_titleblock') = a AS INT)) FILTER (d <> 'manual_review'), 'classifier_accuracy' FROM r
 UNION ALL SELECT lang, avg(CAST((d = 'stage1_titleblock') = a AS INT)) FILTER (d <> 'manual_review'), 'per_language_accuracy' FROM r GROUP BY lang)
SELECT name, cls, round(value, 6) AS value, CASE name WHEN 'manual_review_rate' THEN CASE WHEN value <= 0.2 THEN 'PASS' ELSE 'WARN' END WHEN 'error_rate' THEN 'PASS' WHEN 'classifier_accuracy' THEN CASE WHEN value >= 0.85 THEN 'PASS' ELSE 'FAIL' END
 ELSE CASE WHEN value IS NULL THEN 'INFO' WHEN value >= 0.8 THEN 'PASS' ELSE 'WARN' END END AS status FROM v""")
def sorter_suite(spark, sf_dir):
    size = F.col("p_size")
    part = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "filename")
    decision = F.when(size < 5, "manual_review").when(size < 30, "stage1_titleblock").otherwise("stage2_no_titleblock")
    manifest = part.select("filename", "p_brand", decision.alias("decision"))
    checks = suites.sorter_suite(manifest, part.select("filename", (F.col("p_retailprice") > 1400).alias("actual")), F.col("p_brand"))
    return checks.select("name", "cls", F.round("value", 6).alias("value"), "status")


_F1 = "2 * count(*) FILTER (hit) / (count(*) FILTER (hp) + count(*) FILTER (hg))"


@query(f"""{_LEAVES}, f AS (SELECT CASE WHEN grouping(grp) = 1 THEN '' ELSE grp END AS cls, {_F1} AS value FROM c GROUP BY GROUPING SETS ((grp), ())), l AS (SELECT {_F1} AS f FROM c WHERE hp OR hg GROUP BY path),
h AS (SELECT count(*) FILTER (hp AND (path NOT IN ('status', 'price', 'priority') OR NOT hg OR NOT hit)) / count(*) FILTER (hp) AS value FROM c)
SELECT 'field_f1' AS name, cls, round(value, 6) AS value, 'INFO' AS status FROM f UNION ALL SELECT 'hallucination_rate', '', round(value, 6), CASE WHEN value <= 0.1 THEN 'PASS' ELSE 'FAIL' END FROM h UNION ALL SELECT 'language_f1_gap', '', round(max(f) - min(f), 6), 'INFO' FROM l""")
def numeric_suite(spark, sf_dir):
    checks = suites.field_suite(_compared(spark, sf_dir), "numeric", "grp", ["status", "price", "priority"], "path")
    return checks.select("name", "cls", F.round("value", 6).alias("value"), "status")


@query()
def detection_suite(spark, sf_dir):
    predictions, truth = _detections(spark, sf_dir)
    matches = matching.match_predictions(predictions, truth, "k")
    return suites.detection_suite(matches, truth, "k").select("name", "cls", F.round("value", 6).alias("value"), "status")
