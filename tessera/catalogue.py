"""Queries of the quality and dataset operators on the shared tables, with the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.functions import numbers as N
from tessera.functions import text as T
from tessera.operators import matching, metrics, splits
from tessera.plans import enrichment, gates
from tessera.sources import labels as L

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PRF = """round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 4) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 4) AS recall,
 round(CASE WHEN 2 * tp + fp + fn > 0 AND tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) ELSE 0.0 END, 4) AS f1"""

# --- metrics -----------------------------------------------------------------------------------------------


@query(f"""WITH c AS (SELECT count(*) FILTER (toxic = 1 AND quality = 0) AS tp, count(*) FILTER (toxic = 1 AND quality <> 0) AS fp,
 count(*) FILTER (toxic <> 1 AND quality = 0) AS fn, count(*) FILTER (toxic <> 1 AND quality <> 0) AS tn FROM labels)
SELECT tp, fp, fn, tn, {PRF}, round((tp + tn) / (tp + fp + fn + tn), 4) AS accuracy FROM c""")
def binary_confusion_prf(spark, sf_dir):
    c = table(spark, sf_dir, "labels").agg(*metrics.counts(F.col("toxic") == 1, F.col("quality") == 0))
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return c.select("*", *metrics.precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn")), F.round((F.col("tp") + F.col("tn")) / total, 4).alias("accuracy"))


@query(f"""WITH r AS (SELECT source, toxic = 1 AS p, quality = 0 AS a FROM labels JOIN documents USING (doc_id)),
c AS (SELECT CASE WHEN grouping(source) = 1 THEN '_all' ELSE coalesce(source, '_unknown') END AS source, count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND a) AS fn
 FROM r GROUP BY GROUPING SETS ((source), ()))
SELECT source, tp, fp, fn, {PRF} FROM c""")
def prf_by_group_with_overall(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    c = metrics.by_key_and_overall(rows, "source", metrics.counts(F.col("toxic") == 1, F.col("quality") == 0)[:3])
    return c.select("source", "tp", "fp", "fn", *metrics.precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn")))


@query(f"""WITH p AS (SELECT DISTINCT o_custkey AS k FROM orders), g AS (SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING'),
c AS (SELECT count(*) FILTER (p.k IS NOT NULL AND g.k IS NOT NULL) AS tp, count(*) FILTER (g.k IS NULL) AS fp, count(*) FILTER (p.k IS NULL) AS fn FROM p FULL JOIN g ON p.k = g.k)
SELECT tp, fp, fn, {PRF} FROM c""")
def set_prf(spark, sf_dir):
    p = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("p")).distinct()
    g = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("g"))
    c = p.join(g, F.col("p") == F.col("g"), "full_outer").agg(F.count_if(F.col("p").isNotNull() & F.col("g").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    return c.select("*", *metrics.precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn")))


@query("""WITH e AS (SELECT CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS a, event_id FROM events),
p AS (SELECT a AS actual, CAST((a + event_id % 3) % 6 AS INT) AS predicted FROM e)
SELECT CAST(x AS INT) AS actual, CAST(y AS INT) AS predicted, count(p.actual) AS n FROM range(5) t(x) CROSS JOIN range(5) u(y) LEFT JOIN p ON p.actual = x AND p.predicted = y GROUP BY 1, 2""")
def confusion_matrix_dense(spark, sf_dir):
    kinds = {"click": 0, "error": 1, "purchase": 2, "signup": 3}
    a = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in kinds.items()), F.lit(4))
    pairs = table(spark, sf_dir, "events").select(a.alias("a"), ((a + F.col("event_id") % 3) % 6).alias("p"))
    return metrics.confusion_matrix(pairs, "a", "p", 5)


@query("""SELECT coalesce(nullif(l_returnflag, 'A'), '_unknown') AS cls, CAST(sum(trunc(l_quantity)) AS BIGINT) AS quantity, count(*) AS n FROM lineitem GROUP BY 1""")
def aggregate_per_class(spark, sf_dir):
    cls = F.coalesce(F.nullif(F.col("l_returnflag"), F.lit("A")), F.lit("_unknown"))
    return table(spark, sf_dir, "lineitem").groupBy(cls.alias("cls")).agg(F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.count(F.lit(1)).alias("n"))


_LEAVES = """WITH g AS (SELECT o_orderkey AS k, o_orderpriority AS grp, o_orderstatus AS status, o_totalprice AS price, o_orderpriority AS priority, CAST(NULL AS VARCHAR) AS extra FROM orders),
p AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice * 1.01 ELSE o_totalprice * 1.0005 END AS price,
 CASE WHEN o_orderkey % 3 = 0 THEN 'UNKNOWN' ELSE o_orderpriority END AS priority, CASE WHEN o_orderkey % 11 = 0 THEN 'x' END AS extra FROM orders),
c AS (SELECT g.k, g.grp, f.path, f.hp, f.hg, coalesce(f.hit, false) AS hit FROM g JOIN p ON g.k = p.k CROSS JOIN LATERAL (VALUES
 ('status', p.status IS NOT NULL, g.status IS NOT NULL, p.status = g.status), ('price', p.price IS NOT NULL, g.price IS NOT NULL, abs(p.price - g.price) <= greatest(0.01, 0.001 * greatest(abs(p.price), abs(g.price)))),
 ('priority', p.priority IS NOT NULL, g.priority IS NOT NULL, p.priority = g.priority), ('extra', p.extra IS NOT NULL, g.extra IS NOT NULL, p.extra = g.extra)) AS f(path, hp, hg, hit))"""


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as truth and a changed copy as prediction, compared field by field. Leaves stay typed in one pass."""
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(k, F.col("o_orderpriority").alias("grp"), "o_orderstatus", "o_totalprice", "o_orderpriority")
    fields = ["status", "price", "priority", "extra"]
    gt = orders.select(k.alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"), F.lit(None).cast("string").alias("extra"))
    pred = orders.select(
        k.alias("k"), F.when(k % 7 != 0, F.col("o_orderstatus")).alias("status"), (F.col("o_totalprice") * F.when(k % 5 == 0, 1.01).otherwise(1.0005)).alias("price"),
        F.when(k % 3 == 0, "UNKNOWN").otherwise(F.col("o_orderpriority")).alias("priority"), F.when(k % 11 == 0, "x").alias("extra"),
    )
    compared = metrics.compare_leaves(metrics.leaves(pred, "k", fields), metrics.leaves(gt, "k", fields), "k")
    return compared.join(orders.select(k.alias("k"), "grp"), "k")


@query(f"""{_LEAVES}, t AS (SELECT k, count(*) FILTER (hit) AS tp, count(*) FILTER (hp) - count(*) FILTER (hit) AS fp, count(*) FILTER (hg) - count(*) FILTER (hit) AS fn FROM c GROUP BY k)
SELECT k, tp, fp, fn, {PRF} FROM t""")
def field_f1_per_doc(spark, sf_dir):
    return metrics.field_f1(_compared(spark, sf_dir), ["k"])


_TOTALS = f"""{_LEAVES}, t AS (SELECT CASE WHEN grouping(grp) = 1 THEN '_all' ELSE grp END AS grp, count(*) FILTER (hit) AS tp, count(*) FILTER (hp) - count(*) FILTER (hit) AS fp, count(*) FILTER (hg) - count(*) FILTER (hit) AS fn
 FROM c GROUP BY GROUPING SETS ((grp), ())), v AS (SELECT grp, tp, fp, fn, {PRF} FROM t)"""


@query(f"{_TOTALS} SELECT grp, tp, fp, fn, precision, recall, f1, CASE WHEN f1 >= 0.85 THEN 'PASS' WHEN grp = '_all' THEN 'FAIL' ELSE 'WARN' END AS status FROM v")
def field_f1_gate(spark, sf_dir):
    tp = F.count_if(F.col("hit"))
    totals = metrics.by_key_and_overall(_compared(spark, sf_dir), "grp", [tp.alias("tp"), (F.count_if(F.col("has_pred")) - tp).alias("fp"), (F.count_if(F.col("has_gt")) - tp).alias("fn")])
    f1 = totals.select("grp", "tp", "fp", "fn", *metrics.precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn")))
    severity = F.when(F.col("grp") == "_all", "critical").otherwise("warning")
    return f1.withColumn("status", gates.status(F.col("f1"), F.lit(0.85), F.lit("ge"), severity))


@query(f"""{_LEAVES} SELECT grp, count(*) FILTER (hp) AS n_pred, count(*) FILTER (hp AND (path NOT IN ('status', 'price', 'priority') OR NOT hg OR NOT hit)) AS n_wrong,
 count(*) FILTER (hp AND (path NOT IN ('status', 'price', 'priority') OR NOT hg OR NOT hit)) / greatest(1, count(*) FILTER (hp)) AS rate FROM c GROUP BY grp""")
def hallucination_rate(spark, sf_dir):
    return metrics.hallucination_rate(_compared(spark, sf_dir), ["status", "price", "priority"], ["grp"])


@query(f"""{_LEAVES} SELECT path, count(*) FILTER (hg) AS n_gt, count(*) FILTER (hit) AS hit, count(*) FILTER (hg AND NOT hp) AS missed, count(*) FILTER (hp AND NOT hg) AS extra FROM c
GROUP BY path HAVING count(*) FILTER (hp OR hg) > 0 ORDER BY n_gt DESC, path LIMIT 15""")
def field_breakdown(spark, sf_dir):
    hp, hg = F.col("has_pred"), F.col("has_gt")
    return _compared(spark, sf_dir).groupBy("path").agg(F.count_if(hg).alias("n_gt"), F.count_if(F.col("hit")).alias("hit"), F.count_if(hg & ~hp).alias("missed"), F.count_if(hp & ~hg).alias("extra")).orderBy(F.desc("n_gt"), "path").limit(15)


@query("""SELECT l_returnflag, count(*) AS n, count(*) FILTER (abs(l_extendedprice - l_quantity * p_retailprice) <= greatest(0.01, 0.001 * greatest(abs(l_extendedprice), abs(l_quantity * p_retailprice)))) AS matched
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def numeric_match_rate(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_if(N.numerical_match(F.col("l_extendedprice"), F.col("l_quantity") * F.col("p_retailprice"))).alias("matched"))


@query("""SELECT p_partkey, levenshtein(p_name, p_type) AS distance, round(levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type)), 6) AS ratio, levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type)) <= 0.8 AS fuzzy FROM part""")
def edit_distance_pairs(spark, sf_dir):
    a, b = F.col("p_name"), F.col("p_type")
    return table(spark, sf_dir, "part").select("p_partkey", F.levenshtein(a, b).cast("long").alias("distance"), F.round(T.edit_ratio(a, b), 6).alias("ratio"), T.fuzzy_match(a, b, 0.8).alias("fuzzy"))


# --- text --------------------------------------------------------------------------------------------------


@query(r"""SELECT p_partkey, upper(trim(regexp_replace('  ' || p_name || '  ' || p_type, '\s+', ' ', 'g'))) AS spaced, upper(regexp_replace(p_name || ' ' || p_type, '\s+', '', 'g')) AS squeezed FROM part""")
def normalize_text_pair(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.normalize_text(F.concat(F.lit("  "), "p_name", F.lit("  "), "p_type")).alias("spaced"), T.squeeze_text(F.concat_ws(" ", "p_name", "p_type")).alias("squeezed"))


_SCRIPT = "p_name || CASE p_partkey % 4 WHEN 0 THEN '도면' WHEN 1 THEN '図面' WHEN 2 THEN 'лист' ELSE '' END"


@query(f"""SELECT lang, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(s, '[가-힣]') THEN 'ko' WHEN regexp_matches(s, '[぀-ヿ一-鿿]') THEN 'ja' WHEN regexp_matches(s, '[Ѐ-ӿ]') THEN 'ru' ELSE 'en' END AS lang FROM (SELECT {_SCRIPT} AS s FROM part)) GROUP BY 1""")
def language_by_script(spark, sf_dir):
    k = F.col("p_partkey") % 4
    s = F.concat("p_name", F.when(k == 0, "도면").when(k == 1, "図面").when(k == 2, "лист").otherwise(""))
    return table(spark, sf_dir, "part").groupBy(T.language_by_script(s).alias("lang")).agg(F.count(F.lit(1)).alias("n"))


_HITS = " + ".join(f"CAST(contains(s, '{k}') AS INT)" for k in ("RING", "BOLT", "SMALL", "LARGE", "SMALLRING"))


@query(f"""SELECT p_partkey, hits, CASE WHEN hits >= 2 THEN 'stage1_titleblock' WHEN hits = 0 AND p_size / 100.0 < 0.25 THEN 'stage2_no_titleblock' ELSE 'manual_review' END AS decision
FROM (SELECT p_partkey, p_size, {_HITS} AS hits FROM (SELECT *, upper(replace(p_name, ' ', '')) AS s FROM part))""")
def keyword_hits(spark, sf_dir):
    hits = F.size(T.keyword_hits(F.col("p_name"), ["ring", "bolt", "small", "large", "small ring"]))
    return table(spark, sf_dir, "part").select("p_partkey", hits.alias("hits"), T.titleblock_decision(hits, F.col("p_size") / 100.0, 2, 0.25).alias("decision"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS clean FROM pages""")
def html_clean(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.clean_html(F.col("html")).alias("clean"))


@query(r"""WITH s AS (SELECT p_partkey, p_name || ' R' || p_size || ' 4xM' || p_size || ' ' || p_size || 'mm Ra' || (p_size % 7) || '.2 Rz 6' AS s FROM part)
SELECT p_partkey, len(regexp_extract_all(s, '\bR\s*\d+(?:\.\d+)?')) + len(regexp_extract_all(s, '\bM\s*\d+(?:\.\d+)?')) + len(regexp_extract_all(s, '\d+(?:\.\d+)?\s*(?:mm|MM|μm|um)')) AS dims,
 len(regexp_extract_all(s, '\bRa\s*\d+(?:\.\d+)?')) + len(regexp_extract_all(s, '\bRz\s*\d+(?:\.\d+)?')) AS roughness FROM s""")
def dimension_counts(spark, sf_dir):
    size = F.col("p_size").cast("string")
    s = F.concat("p_name", F.lit(" R"), size, F.lit(" 4xM"), size, F.lit(" "), size, F.lit("mm Ra"), (F.col("p_size") % 7).cast("string"), F.lit(".2 Rz 6"))
    return table(spark, sf_dir, "part").select("p_partkey", T.pattern_count(s, T.DIMENSIONS).cast("long").alias("dims"), T.pattern_count(s, T.ROUGHNESS).cast("long").alias("roughness"))


@query(r"""WITH s AS (SELECT o_orderkey, o_orderkey % 9 || '_jpg.rf.' || o_custkey || '__PMI_' || o_orderkey || '.jpg' AS a, o_orderkey % 9 || '__Measure_' || o_custkey || '__View_1.jpg' AS b FROM orders)
SELECT o_orderkey, split_part(split_part(regexp_replace(a, '\.[^.]*$', ''), '__PMI_', 1), '.rf.', 1) AS pmi, split_part(split_part(regexp_replace(b, '\.[^.]*$', ''), '.rf.', 1), '__View_', 1) AS patch, split_part(regexp_replace(a, '\.[^.]*$', ''), '.rf.', 1) AS plain FROM s""")
def group_keys(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    head = (k % 9).cast("string")
    a, b = F.concat(head, F.lit("_jpg.rf."), c, F.lit("__PMI_"), k.cast("string"), F.lit(".jpg")), F.concat(head, F.lit("__Measure_"), c, F.lit("__View_1.jpg"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.group_key_pmi(a).alias("pmi"), T.group_key_patch(b).alias("patch"), T.group_key_plain(a).alias("plain"))


@query(r"""WITH c AS (SELECT conv_id, turn, list_transform(string_split_regex(text, '[\n\.;]+'), lambda x: trim(x)) AS p, regexp_extract_all(text, '(?:^|\s)(\d+\s*[\.\)]\s*[^.\n]+)', 1) AS q FROM conversations)
SELECT conv_id, turn, CAST(CASE WHEN len(q) >= 2 THEN len(q) ELSE len(list_filter(p, lambda x: x <> '')) END AS INT) AS items FROM c""")
def split_notes(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(T.split_notes(F.col("text"))).alias("items"))


# --- filled records ----------------------------------------------------------------------------------------

_TEXTS = """WITH s AS (SELECT l_orderkey AS k, l_linenumber AS n, CASE l_linenumber % 4 WHEN 0 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR) || ' ±0.' || l_linenumber WHEN 1 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR) || ' +0.2 / -0.1'
 WHEN 2 THEN 'Flatness 0.' || l_linenumber || ' A B-C' ELSE 'Ra ' || l_linenumber || '.5' END AS s FROM lineitem)"""


def _texts(spark, sf_dir):
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("int").cast("string")
    line = n.cast("string")
    s = F.when(n % 4 == 0, F.concat(q, F.lit(" ±0."), line)).when(n % 4 == 1, F.concat(q, F.lit(" +0.2 / -0.1"))).when(n % 4 == 2, F.concat(F.lit("Flatness 0."), line, F.lit(" A B-C"))).otherwise(F.concat(F.lit("Ra "), line, F.lit(".5")))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), n.alias("n"), s.alias("s"))


@query(rf"""{_TEXTS}, m AS (SELECT n, TRY_CAST(nullif(regexp_extract(s, '(-?\d+(?:\.\d+)?)', 1), '') AS DOUBLE) AS nominal, TRY_CAST(nullif(regexp_extract(s, '±\s*(\d+(?:\.\d+)?)', 1), '') AS DOUBLE) AS pm,
 TRY_CAST(nullif(regexp_extract(s, '\+\s*(\d+(?:\.\d+)?)\s*/\s*-\s*(\d+(?:\.\d+)?)', 1), '') AS DOUBLE) AS u, TRY_CAST(nullif(regexp_extract(s, '\+\s*(\d+(?:\.\d+)?)\s*/\s*-\s*(\d+(?:\.\d+)?)', 2), '') AS DOUBLE) AS l FROM s)
SELECT n, count(*) AS rows, round(sum(nominal), 4) AS nominal, round(sum(coalesce(pm, u)), 4) AS upper, round(sum(coalesce(pm, l)), 4) AS lower FROM m GROUP BY n""")
def fill_measure(spark, sf_dir):
    rows = _texts(spark, sf_dir).withColumn("m", N.fill_measure(F.col("s"), F.lit(None).cast("double")))
    return rows.groupBy("n").agg(F.count(F.lit(1)).alias("rows"), *(F.round(F.sum(f"m.{c}"), 4).alias(c) for c in ("nominal", "upper", "lower")))


@query(f"""{_TEXTS} SELECT CASE WHEN s LIKE 'Flatness%' THEN '⌗' END AS symbol, CASE WHEN s LIKE 'Flatness%' THEN 'A,B-C' ELSE '' END AS datum, CASE WHEN s LIKE 'Flatness%' THEN '' ELSE 'no_gdt_symbol_match' END AS reason, count(*) AS n FROM s GROUP BY ALL""")
def fill_gdt(spark, sf_dir):
    rows = _texts(spark, sf_dir).withColumn("g", N.fill_gdt(F.col("s")))
    return rows.groupBy(F.col("g.symbol").alias("symbol"), F.coalesce(F.array_join("g.datum", ","), F.lit("")).alias("datum"), F.col("g.reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(rf"""{_TEXTS}, r AS (SELECT n, TRY_CAST(nullif(regexp_extract(s, '(?i)R\s*a\s*[:=]?\s*(\d+(?:\.\d+)?)', 1), '') AS DOUBLE) AS ra, TRY_CAST(nullif(regexp_extract(s, '(-?\d+(?:\.\d+)?)', 1), '') AS DOUBLE) AS f FROM s)
SELECT n, CASE WHEN ra IS NOT NULL THEN '' WHEN f IS NOT NULL THEN 'fallback_first_numeric' ELSE 'no_numeric_in_ocr' END AS reason, count(*) AS rows, round(sum(coalesce(ra, f)), 4) AS ra FROM r GROUP BY ALL""")
def fill_roughness(spark, sf_dir):
    rows = _texts(spark, sf_dir).withColumn("r", N.fill_roughness(F.col("s")))
    return rows.groupBy("n", F.col("r.reason").alias("reason")).agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("r.ra"), 4).alias("ra"))


# --- geometry ----------------------------------------------------------------------------------------------


def _dims(spark, sf_dir, n):
    """The first n numbers of each vector, as float64."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", *(F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(n)))


_E = "(SELECT vec_id, label, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(8)) + " FROM embeddings)"


def _quad():
    return [(F.col(f"e{2 * i}"), F.col(f"e{2 * i + 1}")) for i in range(4)]


_TURNS = [f"((e{2 * ((i + 1) % 4)} - e{2 * i}) * (e{2 * ((i + 2) % 4) + 1} - e{2 * ((i + 1) % 4) + 1}) - (e{2 * ((i + 1) % 4) + 1} - e{2 * i + 1}) * (e{2 * ((i + 2) % 4)} - e{2 * ((i + 1) % 4)}))" for i in range(4)]


@query(f"""SELECT label, sum(CAST(e0 < 0 OR e0 > 1 OR e1 < 0 OR e1 > 1 AS BIGINT))::BIGINT AS bad_center, sum(CAST(e2 <= 0 OR e2 > 1 AS BIGINT))::BIGINT AS bad_width, sum(CAST(e3 <= 0 OR e3 > 1 AS BIGINT))::BIGINT AS bad_height,
 count(*) FILTER (NOT (label >= 8) AND NOT (e0 < 0 OR e0 > 1 OR e1 < 0 OR e1 > 1) AND NOT (e2 <= 0 OR e2 > 1) AND NOT (e3 <= 0 OR e3 > 1)) AS valid FROM {_E} GROUP BY label""")
def label_quality_rates(spark, sf_dir):
    issues = G.bbox_issues(F.col("label"), F.col("e0"), F.col("e1"), F.col("e2"), F.col("e3"), 8)
    rows = _dims(spark, sf_dir, 4).withColumn("issues", issues)
    has = lambda x: F.count_if(F.array_contains("issues", x))
    return rows.groupBy("label").agg(has("center_out_of_range").alias("bad_center"), has("width_out_of_range").alias("bad_width"), has("height_out_of_range").alias("bad_height"), F.count_if(F.size("issues") == 0).alias("valid"))


@query(f"""SELECT vec_id, round(abs({' + '.join(f'(e{2 * i} * e{2 * ((i + 1) % 4) + 1} - e{2 * ((i + 1) % 4)} * e{2 * i + 1})' for i in range(4))}) / 2, 6) AS area,
 (least({', '.join(_TURNS)}) >= 0 AND greatest({', '.join(_TURNS)}) > 0) OR (greatest({', '.join(_TURNS)}) <= 0 AND least({', '.join(_TURNS)}) < 0) AS simple FROM {_E}""")
def quad_validate(spark, sf_dir):
    return _dims(spark, sf_dir, 8).select("vec_id", F.round(G.quad_area(_quad()), 6).alias("area"), G.is_simple_quad(_quad()).alias("simple"))


_EDGES = ", ".join(f"{{'l': sqrt((e{2 * ((i + 1) % 4)} - e{2 * i}) ** 2 + (e{2 * ((i + 1) % 4) + 1} - e{2 * i + 1}) ** 2), 'i': {-i}, 'a': degrees(atan2(e{2 * ((i + 1) % 4) + 1} - e{2 * i + 1}, e{2 * ((i + 1) % 4)} - e{2 * i}))}}" for i in range(4))


@query(f"""WITH a AS (SELECT list_max([{_EDGES}]).a AS a FROM {_E}), b AS (SELECT CASE WHEN a >= 90 THEN a - 180 WHEN a < -90 THEN a + 180 ELSE a END AS a FROM a)
SELECT CAST(least(floor((a + 90) / 15), 11) AS INT) AS bin, count(*) AS n, count(*) FILTER (abs(a) < 3 OR abs(abs(a) - 90) < 3) AS aligned FROM b GROUP BY 1""")
def angle_histogram(spark, sf_dir):
    rows = _dims(spark, sf_dir, 8).select(G.long_edge_angle(_quad()).alias("a"))
    return rows.groupBy(F.least(F.floor((F.col("a") + 90) / 15), F.lit(11)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.count_if(G.is_axis_aligned(F.col("a"))).alias("aligned"))


@query(f"""SELECT vec_id, {', '.join(f'least(greatest(e{i}, 0.0), 1.0) AS c{i}' for i in range(4))}, greatest({', '.join(f'abs(e{i} - least(greatest(e{i}, 0.0), 1.0))' for i in range(4))}) AS delta FROM {_E}""")
def clip_coords(spark, sf_dir):
    clipped = {f"c{i}": G.clamp(F.col(f"e{i}"), 0.0, 1.0) for i in range(4)}
    rows = _dims(spark, sf_dir, 4).withColumns(clipped)
    return rows.select("vec_id", *clipped, F.greatest(*(F.abs(F.col(f"e{i}") - F.col(f"c{i}")) for i in range(4))).alias("delta"))


_PAD = "greatest(30, least(CAST(trunc({} * {}) AS INT), 80))"


@query(f"""WITH b AS (SELECT p_partkey, p_size * 4.0 AS w, (p_partkey % 50 + 1) * 3.0 AS h FROM part)
SELECT p_partkey, {_PAD.format('w', 0.4)} AS x2, {_PAD.format('h', 0.4)} AS y2, CASE WHEN greatest(w, h) / greatest(least(w, h), 1.0) < 1.5 THEN {_PAD.format('greatest(w, h)', 0.6)} ELSE {_PAD.format('w', 0.4)} END AS x3,
 CASE WHEN greatest(w, h) / greatest(least(w, h), 1.0) < 1.5 THEN 'square_diagonal' ELSE 'per_axis' END AS strategy FROM b""")
def padding_rules(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * F.lit(4.0)).alias("w"), ((F.col("p_partkey") % 50 + 1) * F.lit(3.0)).alias("h"))
    x, y = G.padding_per_axis(F.col("w"), F.col("h"))
    pad = G.padding_by_aspect(F.col("w"), F.col("h"))
    return rows.select("p_partkey", x.alias("x2"), y.alias("y2"), pad["pad_x"].alias("x3"), pad["strategy"].alias("strategy"))


_BOX = "(SELECT l_orderkey AS k, l_linenumber AS pos, l_quantity AS x1, l_linenumber * 4.0 AS y1, l_quantity + 20 AS x2, l_linenumber * 4.0 + 12 AS y2, 1 - l_discount AS conf, l_returnflag AS cls FROM lineitem)"


def _boxes(spark, sf_dir):
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), n.alias("pos"), q.alias("x1"), (n * 4.0).alias("y1"), (q + 20).alias("x2"), (n * 4.0 + 12).alias("y2"), (1 - F.col("l_discount")).alias("conf"), F.col("l_returnflag").alias("cls"))


@query(f"""WITH p AS (SELECT a.k, a.pos AS i, b.pos AS j, greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS o FROM {_BOX} a JOIN {_BOX} b ON a.k = b.k AND a.pos < b.pos)
SELECT k, i, j, round(o / (480.0 - o), 6) AS iou FROM p WHERE o / (480.0 - o) >= 0.3""")
def bbox_iou_pairs(spark, sf_dir):
    boxes = _boxes(spark, sf_dir)
    names = ("x1", "y1", "x2", "y2")
    other = boxes.select("k", F.col("pos").alias("j"), *(F.col(c).alias("b" + c) for c in names))
    iou = G.bbox_iou(tuple(map(F.col, names)), tuple(F.col("b" + c) for c in names))
    return boxes.join(other, "k").where("pos < j").select("k", F.col("pos").alias("i"), "j", iou.alias("raw")).where("raw >= 0.3").select("k", "i", "j", F.round("raw", 6).alias("iou"))


def _detections(spark, sf_dir):
    boxes = _boxes(spark, sf_dir)
    shift = F.col("pos") % 3 * 2.0
    return boxes.where("pos % 5 <> 0").withColumn("x1", F.col("x1") + shift).withColumn("x2", F.col("x2") + shift), boxes.drop("conf")


# Ranked boxes, the overlaps of each class, then one rank after the other: what is taken travels as a list.
_RANKED = "r AS (SELECT *, row_number() OVER (PARTITION BY k, cls ORDER BY conf DESC, pos, x1) AS rank FROM p)"
_OVERLAP = "(greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1)))"
_SHIFTED = f"p AS (SELECT k, pos, x1 + pos % 3 * 2.0 AS x1, y1, x2 + pos % 3 * 2.0 AS x2, y2, conf, cls FROM {_BOX} WHERE pos % 5 <> 0)"
_MATCHED = f"""WITH RECURSIVE {_SHIFTED}, {_RANKED}, g AS (SELECT *, row_number() OVER (PARTITION BY k, cls ORDER BY pos, x1) AS i FROM {_BOX}),
 o AS (SELECT a.k, a.cls, a.rank, b.pos AS gt, b.i, {_OVERLAP} / (480.0 - {_OVERLAP}) AS iou FROM r a JOIN g b ON a.k = b.k AND a.cls = b.cls),
 c AS (SELECT k, cls, rank, list({{'pos': gt, 'i': i, 'iou': iou}} ORDER BY iou DESC, i) AS near FROM o WHERE iou >= 0.5 GROUP BY ALL),
 w AS (SELECT r.k, r.cls, r.rank, r.pos, r.conf, coalesce(near, []) AS near FROM r LEFT JOIN c ON r.k = c.k AND r.cls = c.cls AND r.rank = c.rank),
 m AS (SELECT k, cls, rank, pos, conf, near[1] AS got, CASE WHEN len(near) > 0 THEN [near[1].i] ELSE [] END AS used FROM w WHERE rank = 1 UNION ALL
 SELECT k, cls, rank, pos, conf, got, CASE WHEN got IS NULL THEN used ELSE list_append(used, got.i) END FROM (SELECT w.k, w.cls, w.rank, w.pos, w.conf, list_filter(w.near, lambda n: NOT list_contains(m.used, n.i))[1] AS got, m.used FROM m JOIN w ON m.k = w.k AND m.cls = w.cls AND w.rank = m.rank + 1)),
 matched AS (SELECT k, cls, pos, conf, got.pos AS gt_pos, coalesce(got.iou, 0.0) AS iou FROM m)"""
_KEPT = f"""WITH RECURSIVE p AS (SELECT * FROM {_BOX}), {_RANKED}, c AS (SELECT b.k, b.cls, b.rank, list(a.rank) AS near FROM r a JOIN r b ON a.k = b.k AND a.cls = b.cls AND a.rank < b.rank WHERE {_OVERLAP} / (480.0 - {_OVERLAP}) >= 0.3 GROUP BY ALL),
 w AS (SELECT r.*, coalesce(near, []) AS near FROM r LEFT JOIN c ON r.k = c.k AND r.cls = c.cls AND r.rank = c.rank),
 m AS (SELECT w.*, true AS stays, [rank] AS kept FROM w WHERE rank = 1 UNION ALL
 SELECT w.*, NOT list_has_any(w.near, m.kept), CASE WHEN list_has_any(w.near, m.kept) THEN m.kept ELSE list_append(m.kept, w.rank) END FROM m JOIN w ON m.k = w.k AND m.cls = w.cls AND w.rank = m.rank + 1)"""


@query(f"{_MATCHED} SELECT k, cls, pos, conf, gt_pos, round(iou, 6) AS iou FROM matched")
def greedy_match(spark, sf_dir):
    return matching.match_predictions(*_detections(spark, sf_dir), "k").withColumn("iou", F.round("iou", 6))


@query(f"""{_MATCHED}, t AS (SELECT cls, count(gt_pos) AS tp, count(*) - count(gt_pos) AS fp, 0 AS gt FROM matched GROUP BY cls UNION ALL SELECT cls, 0, 0, count(*) FROM {_BOX} GROUP BY cls)
SELECT coalesce(cls, '_all') AS cls, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, (sum(gt) - sum(tp))::BIGINT AS fn, (sum(gt) - sum(tp)) / sum(gt) AS missing_rate FROM t GROUP BY ROLLUP (cls)""")
def detection_metrics(spark, sf_dir):
    predictions, truth = _detections(spark, sf_dir)
    return matching.detection_metrics(matching.match_predictions(predictions, truth, "k"), truth)


@query(f"{_MATCHED}, d AS (SELECT k, count(gt_pos) AS tp FROM matched GROUP BY k), t AS (SELECT k, count(*) AS gt FROM {_BOX} GROUP BY k) SELECT count(*) AS drawings, round(avg(coalesce(tp, 0) / gt), 9) AS recall FROM t LEFT JOIN d USING (k)")
def drawing_recall(spark, sf_dir):
    predictions, truth = _detections(spark, sf_dir)
    return matching.drawing_recall(matching.match_predictions(predictions, truth, "k"), truth, "k").withColumn("recall", F.round("recall", 9))


@query(f"{_KEPT} SELECT k, cls, pos, conf, x1, y1, x2, y2 FROM m WHERE stays")
def nms(spark, sf_dir):
    return matching.suppress(_boxes(spark, sf_dir), "k", 0.3)


def _turned(boxes: DataFrame) -> DataFrame:
    """The boxes as quadrilaterals, every drawing turned and sheared alike: overlaps stay what they were."""
    points = [("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2")]
    x = [(F.col(a) * 0.8 - F.col(b) * 0.6).alias(f"x{i}") for i, (a, b) in enumerate(points, 1)]
    y = [(F.col(a) * 0.75 + F.col(b) * 0.5).alias(f"y{i}") for i, (a, b) in enumerate(points, 1)]
    return boxes.select(*(c for c in boxes.columns if c not in matching.BOXES.columns), *x, *y)


@query(f"{_KEPT} SELECT k, cls, pos, conf FROM m WHERE stays")
def rotated_nms(spark, sf_dir):
    return matching.suppress(_turned(_boxes(spark, sf_dir)), "k", 0.3, matching.QUADS).select("k", "cls", "pos", "conf")


@query(f"{_MATCHED} SELECT k, cls, pos, gt_pos, round(iou, 6) AS iou FROM matched")
def rotated_match(spark, sf_dir):
    predictions, truth = _detections(spark, sf_dir)
    return matching.match_predictions(_turned(predictions), _turned(truth), "k", shape=matching.QUADS).select("k", "cls", "pos", "gt_pos", F.round("iou", 6).alias("iou"))


@query(f"{_KEPT.replace('conf DESC, pos', 'conf DESC, pos % 2 = 0, pos')} SELECT k, cls, pos, conf FROM m WHERE stays")
def fold_union(spark, sf_dir):
    boxes, odd = _boxes(spark, sf_dir), F.col("pos") % 2 == 1
    kept = matching.fold_union([boxes.where(odd), boxes.where(~odd)], "k", 0.3)
    return kept.select("k", "cls", (F.col("pos") % (1 << 32)).alias("pos"), "conf")


# --- labels, ranking, sets ---------------------------------------------------------------------------------

_LINES = "(SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN '# note' WHEN vec_id % 7 = 0 THEN label || ' 0.5 0.5' WHEN vec_id % 5 = 0 THEN 'x 0.1 0.2 0.3 0.4' ELSE label || ' 0.5 0.5 0.25 0.125' END AS line FROM embeddings)"


@query(f"""SELECT vec_id, CASE WHEN line LIKE '#%' THEN 'skip' WHEN len(string_split(line, ' ')) <> 5 THEN 'field_count' WHEN TRY_CAST(split_part(line, ' ', 1) AS INT) IS NULL THEN 'not_a_number' ELSE '' END AS error,
 CASE WHEN line NOT LIKE '#%' AND len(string_split(line, ' ')) = 5 THEN TRY_CAST(split_part(line, ' ', 1) AS INT) END AS cls FROM {_LINES}""")
def label_parse(spark, sf_dir):
    k, c = F.col("vec_id"), F.col("label").cast("string")
    line = F.when(k % 11 == 0, "# note").when(k % 7 == 0, F.concat(c, F.lit(" 0.5 0.5"))).when(k % 5 == 0, "x 0.1 0.2 0.3 0.4").otherwise(F.concat(c, F.lit(" 0.5 0.5 0.25 0.125")))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", L.parse_label(line, 5).alias("p"))
    return rows.select("vec_id", F.col("p.error").alias("error"), F.col("p.cls").alias("cls"))


@query("""WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS pmi, count(*) FILTER (event_type = 'error') AS iso, count(*) FILTER (event_type = 'signup') AS tab FROM events GROUP BY user_id)
SELECT user_id, pmi, iso, tab, CASE WHEN pmi >= 12 THEN 'manufacturing' WHEN iso >= 12 OR tab >= 14 THEN 'assembly' ELSE 'manual_review_type' END AS decision FROM c""")
def class_pivot_classify(spark, sf_dir):
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    c = table(spark, sf_dir, "events").groupBy("user_id").agg(n("click").alias("pmi"), n("error").alias("iso"), n("signup").alias("tab"))
    return c.withColumn("decision", T.type_by_counts(F.col("pmi"), F.col("iso"), F.col("tab"), 12, 12, 14))


@query("""SELECT user_id, count(*) AS n, round(avg(value), 4) AS avg_conf, min(value) AS low, max(value) AS high, CASE WHEN min(value) < 2 THEN 'low' WHEN avg(value) >= 50 THEN 'auto_pass' ELSE 'review' END AS priority FROM events GROUP BY user_id""")
def priority_queue(spark, sf_dir):
    c = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("a"), F.min("value").alias("low"), F.max("value").alias("high"))
    priority = F.when(F.col("low") < 2, "low").when(F.col("a") >= 50, "auto_pass").otherwise("review")
    return c.select("user_id", "n", F.round("a", 4).alias("avg_conf"), "low", "high", priority.alias("priority"))


_FOLDS = "WITH e AS (SELECT user_id % 5 AS fold, CAST(day(ts) AS INT) AS epoch, max(value) AS score, min(value) AS loss FROM events GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY score DESC, epoch) AS r, row_number() OVER (PARTITION BY fold ORDER BY epoch DESC) AS z FROM e)"


def _folds(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 5).alias("fold"), F.dayofmonth("ts").alias("epoch")).agg(F.max("value").alias("score"), F.min("value").alias("loss"))
    return metrics.fold_results(e, "fold", "epoch", "score", ["score", "loss"], ["loss"])


@query(f"{_FOLDS} SELECT fold, max(CASE WHEN r = 1 THEN epoch END) AS best_epoch, max(CASE WHEN r = 1 THEN score END) AS score, max(CASE WHEN z = 1 THEN loss END) AS last_loss FROM b GROUP BY fold")
def best_epoch(spark, sf_dir):
    return _folds(spark, sf_dir).select("fold", "best_epoch", "score", "last_loss")


@query(f"{_FOLDS} SELECT round(avg(loss), 6) AS mean, round(coalesce(stddev_samp(loss), 0.0), 6) AS std, min(loss) AS low, max(loss) AS high, count(*) AS n FROM b WHERE r = 1")
def kfold_summary(spark, sf_dir):
    x = F.col("loss")
    return _folds(spark, sf_dir).agg(F.round(F.avg(x), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp(x), F.lit(0.0)), 6).alias("std"), F.min(x).alias("low"), F.max(x).alias("high"), F.count(x).alias("n"))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS high FROM events GROUP BY 1")
def timing_percentiles(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg(v), 6).alias("mean"), F.round(F.percentile(v, F.lit(0.5)), 6).alias("median"), F.round(F.percentile(v, F.lit(0.95)), 6).alias("p95"), F.max(v).alias("high"))


_EDGE = [0, 0.5, 0.7, 0.8, 0.9, 0.95, 1.01]


@query("WITH r AS (SELECT l_orderkey, count(*) FILTER (l_returnflag <> 'R') / count(*) AS r FROM lineitem GROUP BY 1) SELECT CAST(CASE " + " ".join(f"WHEN r < {e} THEN {i}" for i, e in enumerate(_EDGE[1:])) + " END AS INT) AS bin, count(*) AS n FROM r GROUP BY 1")
def recall_histogram(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.count_if(F.col("l_returnflag") != "R") / F.count(F.lit(1))).alias("r"))
    return r.groupBy(F.coalesce(*(F.when(F.col("r") < e, i) for i, e in enumerate(_EDGE[1:]))).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{_LEAVES}, t AS (SELECT k, count(*) FILTER (hit) / greatest(1, count(*) FILTER (hg)) AS score FROM c GROUP BY k) SELECT k, round(score, 4) AS score FROM t ORDER BY score, k LIMIT 10")
def worst10(spark, sf_dir):
    c = _compared(spark, sf_dir).groupBy("k").agg((F.count_if(F.col("hit")) / F.greatest(F.lit(1), F.count_if(F.col("has_gt")))).alias("s"))
    return c.orderBy("s", "k").limit(10).select("k", F.round("s", 4).alias("score"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE event_type = 'error') WHERE r <= 3")
def errors_first3(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").where("event_type = 'error'").withColumn("r", F.row_number().over(w)).where("r <= 3").select("user_id", "event_id")


@query("""WITH c AS (SELECT p_brand, count(*) AS n, avg(CAST(p_size > 25 AS INT)) AS acc FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, p_brand) AS r, count(*) OVER () AS m FROM c)
SELECT p_brand, n, round(acc, 4) AS accuracy FROM r WHERE r > m - greatest(1, m // 2)""")
def rare_half_accuracy(spark, sf_dir):
    c = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("p_size") > 25).cast("int")).alias("acc"))
    r = c.withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "p_brand"))).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy()))
    return r.where("r > m - greatest(1, m div 2)").select("p_brand", "n", F.round("acc", 4).alias("accuracy"))


@query("""SELECT 'documents' AS side, count(*) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
UNION ALL SELECT 'labels', count(*) FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE l.doc_id = d.doc_id)""")
def anti_both_sides(spark, sf_dir):
    d, l = (table(spark, sf_dir, t).select("doc_id") for t in ("documents", "labels"))
    side = lambda a, b, name: a.join(b, "doc_id", "left_anti").agg(F.lit(name).alias("side"), F.count(F.lit(1)).alias("n"))
    return side(d, l, "documents").unionByName(side(l, d, "labels"))


@query("WITH q AS (SELECT user_id AS id, event_type AS q, min(event_id) AS pos FROM events GROUP BY 1, 2) SELECT id, q AS first_query, pos FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY q, pos) AS r FROM q) WHERE r = 1")
def dedup_first(spark, sf_dir):
    first = F.min(F.struct(F.col("event_type").alias("q"), F.col("event_id").alias("pos"))).alias("f")
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(first).select("id", F.col("f.q").alias("first_query"), F.col("f.pos").alias("pos"))


@query("SELECT CASE WHEN grouping(o_orderpriority) = 1 THEN 'TOTAL' ELSE o_orderpriority END AS reason, count(DISTINCT o_custkey) AS files, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderpriority), ())")
def reason_summary(spark, sf_dir):
    pairs = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return metrics.by_key_and_overall(pairs, "o_orderpriority", [F.count_distinct("o_custkey").alias("files"), F.sum("n").alias("n")], "TOTAL").withColumnRenamed("o_orderpriority", "reason")


@query("SELECT o_custkey, count(*) FILTER (o_orderkey % 5 <> 0) AS train, count(*) FILTER (o_orderkey % 5 = 0) AS valid FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderkey % 5 = 0) > 0 AND count(*) FILTER (o_orderkey % 5 <> 0) > 0")
def leak_check(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 5 == 0, "valid").otherwise("train").alias("split"))
    return splits.leaks(rows, "o_custkey")


@query()
def kfold_assign(spark, sf_dir):
    return splits.group_kfold(table(spark, sf_dir, "orders"), "o_custkey", 5)


@query()
def split_80_20(spark, sf_dir):
    return splits.train_valid(table(spark, sf_dir, "orders"), "o_custkey", 0.8)


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def exclude_groups(spark, sf_dir):
    out = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return table(spark, sf_dir, "customer").join(out, "c_nationkey", "left_semi").select("c_custkey")


@query("WITH k AS (SELECT DISTINCT conv_id, role FROM conversations), m AS (SELECT conv_id, role, last(text ORDER BY turn) FILTER (trim(text) <> '') AS t FROM conversations GROUP BY 1, 2) SELECT conv_id, role, t AS last_text FROM m")
def title_block_merge(spark, sf_dir):
    last = F.max(F.when(F.trim("text") != "", F.struct("turn", "text")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(last.alias("m")).select("conv_id", "role", F.col("m.text").alias("last_text"))


@query("SELECT event_id, 'k' AS path, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def flatten_props(spark, sf_dir):
    pairs = F.explode(F.from_json("props", "map<string,string>")).alias("path", "value")
    return table(spark, sf_dir, "events").select("event_id", pairs).where("value is not null")


# --- enrichment and gates ----------------------------------------------------------------------------------

_MATERIAL = ["stainless", "SUS304", "aluminum", "brass", "", "carbon steel"]


def _drawings(spark, sf_dir):
    k = F.col("p_partkey")
    mat = F.element_at(F.array(*map(F.lit, _MATERIAL)), (k % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(k.alias("k"), mat.alias("material"), F.when(k % 2 == 0, "ISO 2768-f").otherwise("").alias("tolerance"), (k % 3 == 0).alias("has_roughness"), (k % 5 == 0).alias("precise"))


_GAPS = """WITH d AS (SELECT p_partkey AS k, ['stainless', 'SUS304', 'aluminum', 'brass', '', 'carbon steel'][p_partkey % 6 + 1] AS material, p_partkey % 2 = 0 AS tol, p_partkey % 3 = 0 AS rough, p_partkey % 5 = 0 AS precise FROM part),
g AS (SELECT k, material, precise, 'material' AS category, nullif(material, '') AS original FROM d WHERE material IN ('stainless', 'brass', '', 'carbon steel') UNION ALL SELECT k, material, precise, 'tolerance_general', NULL FROM d WHERE NOT tol
 UNION ALL SELECT k, material, precise, 'surface_roughness_default', NULL FROM d WHERE NOT rough UNION ALL SELECT k, material, precise, 'process_sequence', NULL FROM d UNION ALL SELECT k, material, precise, 'qc_checklist', NULL FROM d)"""


@query(f"{_GAPS} SELECT k, category, original FROM g")
def gap_detect(spark, sf_dir):
    return enrichment.gaps(_drawings(spark, sf_dir), "k").select("k", "category", "original")


_CASCADE = f"""{_GAPS}, e AS (SELECT k, category, CASE WHEN category = 'tolerance_general' THEN 'ISO 2768-mK' WHEN category = 'material' AND original = 'stainless' THEN 'SUS304 No.2D' WHEN category = 'material' AND original = 'brass' THEN 'C2680' WHEN category = 'material' AND original = 'carbon steel' THEN 'SS400'
 WHEN category = 'surface_roughness_default' THEN CASE WHEN precise THEN 'Ra 1.6 μm' ELSE 'Ra 3.2 μm' END
 WHEN category = 'process_sequence' THEN CASE WHEN lower(material) LIKE '%sus%' OR lower(material) LIKE '%stainless%' THEN 'fiber_laser_cutting>press_brake_bending>deburring' WHEN lower(material) LIKE '%al%' THEN 'cnc_milling_3axis>cnc_drilling>deburring>anodize' ELSE 'cnc_milling>cnc_drilling>deburring' END
 ELSE 'review ' || category END AS suggested, CAST(CASE WHEN category = 'tolerance_general' THEN 0.95 WHEN category = 'material' AND original = 'stainless' THEN 0.78 WHEN category = 'material' AND original = 'brass' THEN 0.70 WHEN category = 'material' AND original = 'carbon steel' THEN 0.72
 WHEN category = 'surface_roughness_default' THEN CASE WHEN precise THEN 0.78 ELSE 0.65 END WHEN category = 'process_sequence' THEN 0.70 ELSE 0.6 END AS DOUBLE) AS confidence,
 CASE WHEN category = 'tolerance_general' OR (category = 'material' AND original IS NOT NULL) THEN 'deterministic' WHEN category IN ('surface_roughness_default', 'process_sequence') THEN 'heuristic' ELSE 'llm' END AS method FROM g)"""


@query(f"{_CASCADE} SELECT k, category, suggested, confidence, method, confidence < 0.70 AS flagged FROM e")
def enrichment_cascade(spark, sf_dir):
    return enrichment.enrich(enrichment.gaps(_drawings(spark, sf_dir), "k")).select("k", "category", "suggested", "confidence", "method", "flagged")


@query(f"{_CASCADE} SELECT category, method, count(*) AS n, count(*) FILTER (confidence < 0.70) AS flagged, round(avg(confidence), 4) AS confidence FROM e GROUP BY 1, 2")
def enrich_stats(spark, sf_dir):
    rows = enrichment.enrich(enrichment.gaps(_drawings(spark, sf_dir), "k"))
    return rows.groupBy("category", "method").agg(F.count(F.lit(1)).alias("n"), F.count_if("flagged").alias("flagged"), F.round(F.avg("confidence"), 4).alias("confidence"))


@query(f"""{_TOTALS}, s AS (SELECT CASE WHEN f1 >= 0.85 THEN 'PASS' WHEN grp = '_all' THEN 'FAIL' ELSE 'WARN' END AS s FROM v), n AS (SELECT count(*) FILTER (s = 'PASS') AS pass, CAST(0 AS BIGINT) AS info, CAST(0 AS BIGINT) AS error, count(*) FILTER (s = 'WARN') AS warn, count(*) FILTER (s = 'FAIL') AS fail FROM s)
SELECT *, CASE WHEN fail > 0 THEN 'FAIL' WHEN warn > 0 THEN 'WARN' ELSE 'PASS' END AS overall FROM n""")
def report_status(spark, sf_dir):
    return gates.overall(field_f1_gate(spark, sf_dir))
