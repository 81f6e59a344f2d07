"""Queries of crawl filters, lenient labels, folds, confusion, merged regions and sets of keys."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.catalogue import _LINES, query, table
from tessera.functions import records as R
from tessera.functions import text as T
from tessera.operators import crawl, metrics
from tessera.sources import labels as L

_FOUND = lambda words: " OR ".join(f"regexp_matches(t, '(?i)\\b{w}\\b')" for w in words)
_SCORED = " + ".join(f"CASE WHEN regexp_matches(t, '(?i)\\b{w}\\b') THEN {n} ELSE 0 END" for w, n in crawl.WEIGHTS.items())
_CRAWLED = """(SELECT page_id, concat_ws(' ', url, CASE page_id % 7 WHEN 0 THEN 'CNC milling of parts' WHEN 1 THEN 'Floor Plan' WHEN 2 THEN 'GD&T and tolerance' WHEN 3 THEN 'sheet metal, DXF' WHEN 4 THEN 'cadence' ELSE 'shop drawing' END) AS t,
 CASE page_id % 5 WHEN 0 THEN 'CC-BY-4.0' WHEN 1 THEN 'mit' WHEN 2 THEN NULL ELSE 'proprietary' END AS licence, CASE WHEN page_id % 3 = 0 THEN 'open' ELSE 'closed' END AS access, page_id % 4 AS files FROM pages)"""
_ALLOWED = " OR ".join(f"contains(lower(coalesce(licence, '')), '{x}') OR contains(access, '{x}')" for x in crawl.LICENCES)


def _crawled(spark, sf_dir):
    n = lambda m: F.col("page_id") % m
    words = F.element_at(F.array(*map(F.lit, ["CNC milling of parts", "Floor Plan", "GD&T and tolerance", "sheet metal, DXF", "cadence", "shop drawing", "shop drawing"])), (n(7) + 1).cast("int"))
    licence = F.when(n(5) == 0, "CC-BY-4.0").when(n(5) == 1, "mit").when(n(5) > 2, "proprietary")
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat_ws(" ", "url", words).alias("t"), licence.alias("licence"), F.when(n(3) == 0, "open").otherwise("closed").alias("access"), n(4).alias("files"))
    licensed = crawl.allowed_licence(F.col("licence"), F.col("access"))
    return rows.withColumn("reason", crawl.staged_filter(F.col("t"), crawl.EXCLUDED, crawl.WEIGHTS, F.col("files"), licensed=licensed))


_REASONS = f"(SELECT *, CASE WHEN {_FOUND(crawl.EXCLUDED)} THEN 'excluded' WHEN NOT ({_ALLOWED}) THEN 'licence' WHEN {_SCORED} < 5 THEN 'low_score' WHEN files < 1 THEN 'no_files' ELSE 'accepted' END AS reason FROM {_CRAWLED})"


@query(f"SELECT page_id, reason FROM {_REASONS}")
def licensed_filter(spark, sf_dir):
    return _crawled(spark, sf_dir).select("page_id", "reason")


@query(f"SELECT coalesce(access, '_all') AS access, count(*) AS records, count(*) FILTER (reason = 'accepted') AS accepted, sum(files)::BIGINT AS files FROM {_REASONS} GROUP BY ROLLUP (access)")
def crawl_summary(spark, sf_dir):
    return crawl.crawl_summary(_crawled(spark, sf_dir), "access", {"accepted": (F.col("reason") == "accepted").cast("long"), "files": F.col("files")})


def _lines(spark, sf_dir):
    n, label = F.col("vec_id"), F.col("label").cast("string")
    line = F.when(n % 11 == 0, "# note").when(n % 7 == 0, F.concat(label, F.lit(" 0.5 0.5"))).when(n % 5 == 0, "x 0.1 0.2 0.3 0.4").otherwise(F.concat(label, F.lit(" 0.5 0.5 0.25 0.125")))
    return table(spark, sf_dir, "embeddings").select("vec_id", (n % 50).alias("file"), line.alias("line"))


@query(f"SELECT vec_id % 50 AS file, {', '.join(f'count(*) FILTER (try_cast(string_split(line, {chr(39)} {chr(39)})[1] AS INT) = {c}) AS c{c}' for c in range(5))} FROM {_LINES} GROUP BY 1")
def lenient_counts(spark, sf_dir):
    return L.class_counts(_lines(spark, sf_dir), "file", "line", 5)


@query(f"SELECT vec_id, try_cast(string_split(line, ' ')[1] AS INT) AS cls, len(string_split(line, ' ')) - 1 AS n FROM {_LINES} WHERE len(string_split(line, ' ')) = 5 AND try_cast(string_split(line, ' ')[1] AS INT) IN (1, 2, 3)")
def lenient_rows(spark, sf_dir):
    return L.lenient_rows(_lines(spark, sf_dir), "line", 5, [1, 2, 3]).select("vec_id", "cls", F.size("values").cast("long").alias("n"))


_CELLS = "(SELECT user_id % 4 AS actual, (user_id + (event_id % 3)) % 4 AS predicted, count(*) AS n FROM events GROUP BY ALL)"


def _cells(spark, sf_dir):
    pairs = table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("actual"), ((F.col("user_id") + F.col("event_id") % 3) % 4).alias("predicted"))
    return metrics.confusion_matrix(pairs, "actual", "predicted", 4)


@query(f"SELECT sum(n) FILTER (actual <> predicted)::BIGINT AS confused, sum(n)::BIGINT AS total, sum(n) FILTER (actual <> predicted) / sum(n) AS rate FROM {_CELLS} WHERE actual < 3 AND predicted < 3")
def confusion_rate(spark, sf_dir):
    return metrics.confusion_rate(_cells(spark, sf_dir), 3)


@query(f"SELECT predicted::INT AS cls, sum(CASE WHEN actual = predicted THEN n ELSE 0 END) / sum(n) AS accuracy FROM {_CELLS} WHERE predicted < 3 GROUP BY 1")
def class_accuracy(spark, sf_dir):
    return metrics.class_accuracy(_cells(spark, sf_dir), 3, "predicted")


@query(f"SELECT sum(CASE WHEN predicted = 1 THEN n ELSE 0 END)::BIGINT AS wrong, sum(n)::BIGINT AS total, sum(CASE WHEN predicted = 1 THEN n ELSE 0 END) / sum(n) AS rate FROM {_CELLS} WHERE actual = 3")
def background_rate(spark, sf_dir):
    return metrics.false_positive_rate(_cells(spark, sf_dir), 1, 3)


@query("WITH e AS (SELECT user_id % 5 AS fold, day(ts) AS epoch, max(value) AS score FROM events GROUP BY ALL), b AS (SELECT fold, max(score) AS score FROM e GROUP BY fold) SELECT fold, score FROM b ORDER BY score DESC, fold LIMIT 1")
def best_fold(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 5).alias("fold"), F.dayofmonth("ts").alias("epoch")).agg(F.max("value").alias("score"))
    return metrics.best_fold(metrics.fold_results(e, "fold", "epoch", "score", ["score"], []), "fold", "score").select("fold", "score")


@query("SELECT count(*) AS n_total, count(*) FILTER (o_orderstatus = 'F') AS n_ok, count(*) FILTER (o_orderstatus <> 'F') AS n_err FROM orders")
def batch_summary(spark, sf_dir):
    return metrics.batch_summary(table(spark, sf_dir, "orders").withColumn("ok", F.col("o_orderstatus") == "F"), "ok", "o_totalprice").select("n_total", "n_ok", "n_err")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')")
def unmatched_keys(spark, sf_dir):
    return metrics.unmatched(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_orderpriority LIKE '1%'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT p_partkey, CAST(contains(upper(p_name), 'BOLT') AS INT) + CAST(contains(upper(p_name), 'RING') AS INT) + CAST(contains(upper(p_name), 'S') AS INT) AS hits FROM part")
def parts_list_hits(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.parts_list_hits(F.col("p_name"), ["bolt", "Ring", "S"]).alias("hits"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'ja' THEN 'Japanese' WHEN 'ko' THEN 'Korean' WHEN 'ru' THEN 'Russian' WHEN 'zh' THEN 'Chinese' WHEN 'de' THEN 'German' ELSE 'Unknown' END AS name FROM documents")
def language_by_prefix(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.language_by_prefix(F.concat(F.upper("lang"), F.lit("_"), "doc_id")).alias("name"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN trim(p_name) ELSE p_brand END AS answer FROM part")
def assistant_answer(spark, sf_dir):
    k = F.col("p_partkey") % 3
    told = F.when(k == 0, F.concat("p_name", F.lit("\nAssistant :\n "), "p_brand")).when(k == 1, F.concat(F.lit("<|user|>"), "p_name", F.lit("<|assistant|> "), "p_brand", F.lit("<|end|>"))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", T.assistant_answer(told).alias("answer"))


_ITEMS = "(SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_partkey, l_suppkey) AS n, l_returnflag FROM lineitem)"


@query(f"""SELECT l_orderkey, max(n) FILTER (l_returnflag = 'A')::VARCHAR AS a, max(n) FILTER (l_returnflag = 'N')::VARCHAR AS n, string_agg(n, ',' ORDER BY n) AS notes FROM {_ITEMS} GROUP BY l_orderkey""")
def merge_regions(spark, sf_dir):
    """Every line is a region of its order, numbered in a total order: lines that repeat a number are there, too."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_returnflag", "l_partkey", "l_suppkey"))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", place.alias("place"), F.col("l_returnflag").alias("flag"))
    n = F.col("place").cast("string")
    merged = R.merge_regions(items.select("l_orderkey", "place", F.create_map("flag", n).alias("fields"), F.array(n).alias("items")), "l_orderkey", "place")
    return merged.select("l_orderkey", F.col("title_block")["A"].alias("a"), F.col("title_block")["N"].alias("n"), F.array_join("notes", ",").alias("notes"))
