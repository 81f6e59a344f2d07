"""Further queries: crawled records, nested documents, points, provenance and cost."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.catalogue import _CASCADE, _E, _quad, _dims, _drawings, query, table
from tessera.functions import geometry as G
from tessera.functions import structs as S
from tessera.functions import text as T
from tessera.operators import crawl, matching
from tessera.operators import documents as D
from tessera.plans import enrichment

_WEIGHTS = {"small": 10, "ring": 5, "bolt": 5, "large": 2, "red": 2}
_KINDS = {"fasteners": ["bolt", "screw"], "rings": ["ring", "small"], "plates": ["plate", "large"]}
_has = lambda k: f"regexp_matches(p_name, '(?i)\\b{k}\\b')"
_SCORE = " + ".join(f"CASE WHEN {_has(k)} THEN {w} ELSE 0 END" for k, w in _WEIGHTS.items())


@query(f"SELECT p_partkey, CAST({_SCORE} AS INT) AS score FROM part")
def keyword_score(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", crawl.include_score(F.col("p_name"), _WEIGHTS).alias("score"))


_N = [" + ".join(f"CAST({_has(k)} AS INT)" for k in words) for words in _KINDS.values()]


@query(f"WITH c AS (SELECT p_partkey, {', '.join(f'({n}) AS n{i}' for i, n in enumerate(_N))} FROM part) SELECT p_partkey, CASE WHEN greatest(n0, n1, n2) = 0 THEN 'uncategorized' WHEN n0 = greatest(n0, n1, n2) THEN 'fasteners' WHEN n1 = greatest(n0, n1, n2) THEN 'rings' ELSE 'plates' END AS category FROM c")
def category_classify(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", crawl.category(F.col("p_name"), _KINDS).alias("category"))


@query(f"SELECT reason, count(*) AS n FROM (SELECT CASE WHEN {_has('plate')} OR {_has('screw')} THEN 'excluded' WHEN {_SCORE} < 5 THEN 'low_score' WHEN p_size % 4 < 1 THEN 'no_files' ELSE 'accepted' END AS reason FROM part) GROUP BY 1")
def staged_filter(spark, sf_dir):
    reason = crawl.staged_filter(F.col("p_name"), ["plate", "screw"], _WEIGHTS, F.col("p_size") % 4)
    return table(spark, sf_dir, "part").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH f AS (SELECT page_id, url || CASE page_id % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '.exe' ELSE '.svg' END AS p, length(html) AS z FROM pages)
SELECT page_id, '.' || lower(list_last(string_split(list_last(string_split(p, '/')), '.'))) AS ext, '.' || lower(list_last(string_split(list_last(string_split(p, '/')), '.'))) IN ('.pdf', '.svg') AND z <= 524288000 AND NOT (z > 0 AND z < 1024) AS kept FROM f""")
def file_eligibility(spark, sf_dir):
    k = F.col("page_id") % 3
    path = F.concat("url", F.when(k == 0, ".PDF").when(k == 1, ".exe").otherwise(".svg"))
    ext = F.concat(F.lit("."), T.file_extension(path))
    return table(spark, sf_dir, "pages").select("page_id", ext.alias("ext"), crawl.eligible_file(ext, F.length("html")).alias("kept"))


@query("""WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'D' || o_orderkey END AS doi, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS title, 'a, b,' || o_orderpriority AS keywords FROM orders)
SELECT 'm_' || id AS id, coalesce(nullif(doi, ''), nullif(title, ''), 'none') AS name, array_to_string(list_filter(list_transform(string_split(keywords, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS keywords FROM r""")
def normalize_record(spark, sf_dir):
    k = F.col("o_orderkey")
    doi, title = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("D"), k.cast("string"))), F.when(k % 5 != 0, F.col("o_orderstatus"))
    words = F.filter(F.transform(F.split(F.concat(F.lit("a, b,"), "o_orderpriority"), ","), lambda x: F.trim(x)), lambda x: x != "")
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("m_"), k.cast("string")).alias("id"), F.coalesce(crawl.first_of(doi, title), F.lit("none")).alias("name"), F.array_join(words, "|").alias("keywords"))


@query("WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND user_id % 3 = 0) SELECT user_id, event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.user_id = e.user_id) ORDER BY event_id LIMIT 100")
def incremental_limit(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    done = events.where("event_type = 'signup' and user_id % 3 = 0").select("user_id").distinct()
    return events.join(done, "user_id", "left_anti").orderBy("event_id").limit(100).select("user_id", "event_id")


@query(f"""WITH p AS (SELECT vec_id, unnest([{', '.join(f"{{'a': atan2(e{2 * i + 1} - (e1 + e3 + e5 + e7) / 4, e{2 * i} - (e0 + e2 + e4 + e6) / 4), 'x': e{2 * i}, 'y': e{2 * i + 1}}}" for i in range(4))}], recursive := true) FROM {_E}),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY a) AS n FROM p), s AS (SELECT vec_id, arg_min(n, x + y) AS f FROM r GROUP BY 1)
SELECT vec_id, round(sum(CASE (n - f + 4) % 4 WHEN 0 THEN 1 WHEN 1 THEN 10 WHEN 2 THEN 100 ELSE 1000 END * (x + 2 * y)), 5) AS code FROM r JOIN s USING (vec_id) GROUP BY vec_id""")
def order_points(spark, sf_dir):
    rows = _dims(spark, sf_dir, 8).select("vec_id", G.order_points(_quad()).alias("p"))
    code = sum((F.col("p")[i]["x"] * 10**i + F.col("p")[i]["y"] * 2 * 10**i for i in range(1, 4)), F.col("p")[0]["x"] + F.col("p")[0]["y"] * 2)
    return rows.select("vec_id", F.round(code, 5).alias("code"))


@query(f"WITH a AS (SELECT vec_id, degrees(atan2(e3 - e1, e2 - e0)) + 90 AS a FROM {_E}) SELECT vec_id, round(a - 180 * floor(a / 180) - 90, 2) AS angle FROM a")
def obb_angle(spark, sf_dir):
    return _dims(spark, sf_dir, 4).select("vec_id", G.edge_angle((F.col("e0"), F.col("e1")), (F.col("e2"), F.col("e3"))).alias("angle"))


@query("SELECT p_partkey, printf('%.2f,%.2f', p_size * 1.5, (p_partkey % 10) * 1.5) AS points FROM part")
def scale_points(spark, sf_dir):
    raw = F.concat(F.col("p_size").cast("string"), F.lit(","), (F.col("p_partkey") % 10).cast("string"), F.lit(";bad;1,x"))
    return table(spark, sf_dir, "part").select("p_partkey", G.scale_points(raw, F.lit(1.5)).alias("points"))


@query()
def polygon_iou(spark, sf_dir):
    e = lambda i: F.col(f"e{i}")
    box = lambda *a: F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in G.corners(*a)))
    pairs = _dims(spark, sf_dir, 8).select("vec_id", box(e(0), e(1), F.abs(e(2)) + 1, F.abs(e(3)) + 1, e(4)).alias("a"), box(e(5), e(6), F.abs(e(7)) + 1, F.abs(e(3)) + 1, e(2)).alias("b"))
    return matching.polygon_ious(pairs, "vec_id")


@query("SELECT l_orderkey, l_linenumber, '<s_nominal>' || CAST(l_quantity AS BIGINT) || '</s_nominal><s_unit>' || CASE WHEN l_linenumber % 2 = 0 THEN 'mm' ELSE '' END || '</s_unit>' AS tags, CASE WHEN l_linenumber % 2 = 0 THEN 'mm' END AS unit FROM lineitem")
def donut_encode(spark, sf_dir):
    tags = S.to_tags({"nominal": F.col("l_quantity").cast("long"), "unit": F.when(F.col("l_linenumber") % 2 == 0, "mm")})
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", tags.alias("tags")).withColumn("unit", S.tag_field(F.col("tags"), "unit"))


@query("SELECT o_orderkey, f.path, f.value FROM orders CROSS JOIN LATERAL (VALUES ('a.status', o_orderstatus), ('a.ids', '[' || o_orderkey || ', ' || o_custkey || ']'), ('b[0].p', o_orderpriority)) AS f(path, value)")
def flatten_nested(spark, sf_dir):
    doc = F.to_json(F.struct(F.struct(F.col("o_orderstatus").alias("status"), F.array("o_orderkey", "o_custkey").alias("ids")).alias("a"), F.array(F.struct(F.col("o_orderpriority").alias("p"))).alias("b")))
    found = D.leaves(table(spark, sf_dir, "orders").select("o_orderkey", F.try_parse_json(doc).alias("doc")), "doc")
    return found.select("o_orderkey", "path", D.leaf_text(F.col("node")).alias("value"))


@query()
def parse_llm_json(spark, sf_dir):
    k = F.col("event_id")
    text = F.when(k % 3 == 0, F.concat(F.lit("Sure: ```json\n"), "props", F.lit("\n```"))).when(k % 3 == 1, F.concat(F.lit("It is "), "props", F.lit(" }"))).otherwise("no object {")
    return S.parse_answers(table(spark, sf_dir, "events").select("event_id", text.alias("t")), "event_id", "t")


@query(f"""{_CASCADE} SELECT method, count(*) AS n, count(*) FILTER (suggested IS NULL) AS empty, round(1 - count(*) FILTER (suggested IS NULL) / (count(*) * 3), 4) AS provenance,
 round(CAST(sum(CASE method WHEN 'llm' THEN 0.001 ELSE 0.0 END) AS DOUBLE), 6) AS cost FROM e GROUP BY method""")
def provenance_cost(spark, sf_dir):
    costs = spark.createDataFrame([("deterministic", 0.0), ("heuristic", 0.0)], "m string, unit double")
    rows = enrichment.enrich(enrichment.gaps(_drawings(spark, sf_dir), "k")).join(F.broadcast(costs), F.col("method") == F.col("m"), "left")
    n, none = F.count(F.lit(1)), F.count_if(F.col("suggested").isNull())
    return rows.groupBy("method").agg(n.alias("n"), none.alias("empty"), F.round(1 - none / (n * 3), 4).alias("provenance"), F.round(F.sum(F.coalesce("unit", F.lit(0.001))), 6).alias("cost"))


@query(f"{_CASCADE}, x AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN 'SS400' ELSE 'SUS304 No.2D' END AS expert FROM part) SELECT count(*) AS n, round(avg(CAST(suggested = expert AS INT)), 6) AS accuracy FROM e JOIN x USING (k) WHERE category = 'material'")
def material_accuracy(spark, sf_dir):
    expert = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.when(F.col("p_partkey") % 4 == 0, "SS400").otherwise("SUS304 No.2D").alias("expert"))
    rows = enrichment.enrich(enrichment.gaps(_drawings(spark, sf_dir), "k")).where("category = 'material'").join(expert, "k")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("suggested") == F.col("expert")).cast("int")), 6).alias("accuracy"))


@query("SELECT o_orderpriority AS lang, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def decision_crosstab(spark, sf_dir):
    out = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("lang")).pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    return out.select("lang", *(F.col(c).alias(c.lower()) for c in "FOP"))


@query()
def note_match(spark, sf_dir):
    notes = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 10).alias("k"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("note"))
    return matching.match_notes(notes.withColumn("note", F.regexp_replace("note", "^s", "z")), notes, "k", 0.3)


@query("SELECT user_id, value AS last_value FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def last_wins(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf_dir, "events").withColumn("r", F.row_number().over(w)).where("r = 1").select("user_id", F.col("value").alias("last_value"))
