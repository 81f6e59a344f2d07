"""The registered queries of the training-data operators, over the whole ``documents`` table, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents
from tessera.llm.conversation_repair import damage_conversations, repair_conversations, repaired_sha256
from tessera.llm.exact_dedup import exact_groups
from tessera.llm.exponion import centroid_sha256, cluster_vectors
from tessera.llm.language_kernel import identify_languages
from tessera.llm.license_scan import license_scan, license_sql
from tessera.llm.media_columns import document_media, page_sequences
from tessera.llm.ngram_join import ngram_join
from tessera.llm.packing import pack_documents
from tessera.llm.piece_bpe import encode_pieces
from tessera.llm.quality_nbsvm import score_quality
from tessera.llm.sharding import shard_documents
from tessera.llm.source_mixing import mix_sources
from tessera.llm.suffix_dedup import repeated_spans


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(documents(spark, sf_dir), words=3, num=9, den=10).select("doc_id", "n_shingles", "component_id", "n_links")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir)).drop("hits")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir), weights=(3, 1, 2), share=1.5, most=2).select("doc_id", "size", "source_size", "target", "taken", "finish")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_documents(documents(spark, sf_dir), shards=40)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeated_spans(documents(spark, sf_dir), length=200)
    return rows.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = score_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_media(documents(spark, sf_dir)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def media_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_sequences(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), size=1024, end_id=2)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(documents(spark, sf_dir))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centers = cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=8, rounds=10, size=64, scale=1024, seed="3")
    by = {r["cluster"]: r["inertia"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # one for each centroid
    table = [(j, by.get(j, 0), sum(by.values()), centroid_sha256(c)) for j, c in enumerate(centers)]
    sums = spark.createDataFrame(table, "number int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(sums), F.col("cluster") == F.col("number")).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode_pieces(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), decoded="decoded")
    ids, decoded = F.array_join(F.col("ids").cast("array<string>"), ","), F.col("decoded")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(decoded.cast("binary"), 256).alias("decoded_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found, turns = repair_conversations(damage_conversations(rows))
    found = found.withColumnRenamed("conv_id", "found_id")
    digests = repaired_sha256(turns).withColumnRenamed("conv_id", "digest_id")
    every = rows.select("conv_id").distinct()
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("found_id")), "left").join(digests, F.col("conv_id").eqNullSafe(F.col("digest_id")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_license_scan, op3_source_mixing, op4_sharding, op5_exact_dedup, op6_suffix_dedup, op7_quality_classifier, op8_media_columns, op9_best_fit_packing, op10_language_id, op11_centroid_clustering, op12_sentencepiece, op13_conversation_repair, media_of_pages)}

_OP1 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words
), sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM shingles
), items AS (SELECT doc_id, unnest(s) AS x FROM shingles
), common AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT u, v FROM common JOIN sizes p ON p.doc_id = u JOIN sizes q ON q.doc_id = v WHERE 100 * i >= 90 * (p.n + q.n - i)
), ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reach AS (SELECT doc_id AS a, doc_id AS b FROM sizes UNION SELECT r.a, w.v FROM reach r JOIN ways w ON r.b = w.u)
SELECT s.doc_id, s.n AS n_shingles, min(r.b) AS component_id, (SELECT count(*) FROM ways w WHERE w.u = s.doc_id) AS n_links
FROM sizes s JOIN reach r ON r.a = s.doc_id GROUP BY 1, 2
"""

_OP5 = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(text) AS text_sha256
FROM t WINDOW g AS (PARTITION BY text)
"""

#: Least sharing of the excess: sources in order of what they may have for their weight, those before the cut at their limit.
_OP3 = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(text, '') AS text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), keyed AS (SELECT doc_id, source, size, CAST('0x' || substr(md5('17/' || coalesce(CAST(doc_id AS VARCHAR), '') || '/' || text), 1, 15) AS BIGINT) AS key FROM base
), sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS no FROM base GROUP BY source
), weighed AS (SELECT *, CAST([3.0, 1.0, 2.0][CAST(no % 3 AS INTEGER) + 1] AS DOUBLE) AS weight, 2.0 * size AS most FROM sizes
), steps AS (
  SELECT *, coalesce(sum(most) OVER w, 0) AS over, (SELECT sum(weight) FROM weighed) - coalesce(sum(weight) OVER w, 0) AS free FROM weighed
  WINDOW w AS (ORDER BY most / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), cut AS (
  SELECT CAST((SELECT 1.5 * sum(size) FROM sizes) - over AS DOUBLE) AS left_, CAST(free AS DOUBLE) AS free FROM steps
  WHERE most >= ((SELECT 1.5 * sum(size) FROM sizes) - over) * weight / free ORDER BY most / weight, no LIMIT 1
), targets AS (SELECT source, no, size AS source_size, least(most, left_ * weight / free) AS target FROM weighed, cut
), sent AS (
  SELECT k.doc_id, k.size, k.key, t.source_size, t.target, sum(k.size) OVER (PARTITION BY t.no ORDER BY k.key, k.doc_id ROWS UNBOUNDED PRECEDING) - k.size AS before
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source
), queue AS (
  SELECT doc_id, key, e, size, (before + size / 2.0 + e * source_size) / target AS time FROM sent, (SELECT unnest([0, 1]) AS e) WHERE target > 0 AND size > 0
), used AS (
  SELECT *, sum(size) OVER (ORDER BY time, key, doc_id ROWS UNBOUNDED PRECEDING) - size AS before FROM queue
), taken AS (SELECT doc_id, key, count(*) AS copies FROM used WHERE before + size / 2.0 <= (SELECT 1.5 * sum(size) FROM sizes) GROUP BY ALL)
SELECT doc_id, size, source_size, target, CAST(size * coalesce(copies, 0) AS BIGINT) AS taken, CASE WHEN target > 0 THEN (before + size) / target ELSE 0.0 END AS finish
FROM sent LEFT JOIN taken USING (doc_id, key)
"""


def _cluster_sql(k: int = 8, rounds: int = 10) -> str:
    """Rounds written out: distances to all centroids, the least with the smallest number, floors of the means."""

    def assigned(r: int) -> str:
        gap = "CAST(list_sum(list_transform(list_zip(v.p, c.p), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
        return f"""a{r} AS MATERIALIZED (
  SELECT row, min(struct_pack(d := d, no := no)) AS near FROM (SELECT v.row, c.no, {gap} AS d FROM v, c{r} c) GROUP BY row
)"""

    def means(r: int) -> str:
        return f"""c{r + 1} AS MATERIALIZED (
  SELECT c.no, coalesce(m.p, c.p) AS p FROM c{r} c LEFT JOIN (
    SELECT no, list(CAST(CASE WHEN s % n < 0 THEN (s - s % n) // n - 1 ELSE s // n END AS BIGINT) ORDER BY axis) AS p FROM (
      SELECT a.near.no AS no, g.axis, CAST(sum(v.p[g.axis]) AS BIGINT) AS s, count(*) AS n FROM a{r} a JOIN v USING (row), (SELECT unnest(range(1, 65)) AS axis) g GROUP BY 1, 2) GROUP BY no
  ) m USING (no)
)"""

    steps = ", ".join(x for r in range(rounds) for x in (assigned(r), means(r)))
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS p FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id), p) - 1 AS INTEGER) AS no, p FROM v QUALIFY no < {k}
), {steps}, {assigned(rounds)}
SELECT vec_id, near.no AS cluster, near.d AS distance, CAST(sum(near.d) OVER (PARTITION BY near.no) AS BIGINT) AS cluster_inertia,
  CAST(sum(near.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.p, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (row) JOIN c{rounds} c ON c.no = near.no
"""


def _repair_sql() -> str:
    """From a conversation's end back, for each state the least (cost, audit) of what is left, with the lines it leaves."""

    def more(of: str, cost: str, letter: str, line: str | None) -> str:
        lines = f"list_prepend({line}, {of}.t)" if line else f"{of}.t"
        return f"{{'k': lpad(CAST(CAST(left({of}.k, 9) AS INTEGER) + {cost} AS VARCHAR), 9, '0') || '{letter}' || substr({of}.k, 10), 't': {lines}}}"

    def row(state: str, keeps: dict[str, str], made: str) -> str:
        name = "assistant" if made == "a" else "user"
        ways = [more(state, "2", "D", None), f"CASE WHEN fault NOT IN (1, 2) THEN {more(made, 'more + 1', 'R', f"'{name}:' || text")} END"]
        ways += [f"CASE WHEN fault NOT IN (1, 2) AND left(role, 1) = '{r}' THEN {more(r, 'more', 'K', 'role || chr(58) || text')} END" for r in keeps]
        return f"least({', '.join(ways)}) AS x{state}"

    table = "list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i))"
    return f"""
WITH RECURSIVE crc AS (SELECT {table} AS t
), hits AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ord(c) AS BIGINT)),
    lambda c, b: xor(t[CAST(xor(c, b) % 256 AS INTEGER) + 1], c >> 8), CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS hit FROM conversations, crc
), damaged AS (
  SELECT conv_id, turn, CASE hit WHEN 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE hit WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM hits WHERE hit <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text)) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS tail FROM damaged
), faulty AS (
  SELECT *, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair,
    CASE WHEN tail = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN right(tail, 1) IN ('.', '!', '?') THEN 0 ELSE 3 END AS fault FROM placed
), lines AS (SELECT *, CASE fault WHEN 3 THEN 5 ELSE 0 END AS more FROM faulty
), rest AS (
  SELECT conv_id, max(i) + 1 AS i, {{'k': '000000000', 't': CAST([] AS VARCHAR[])}} AS z, {{'k': '000000010II', 't': ['user:', 'assistant:']}} AS s, {{'k': '000000005I', 't': ['assistant:']}} AS u, {{'k': '000000000', 't': CAST([] AS VARCHAR[])}} AS a
  FROM lines GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, least(xz, {more('u2', '5', 'I', "'user:'")}), least(xs, {more('u2', '5', 'I', "'user:'")}), u2, least(xa, {more('xu', '5', 'I', "'user:'")})
  FROM (
    SELECT *, least(xu, {more('xa', '5', 'I', "'assistant:'")}) AS u2 FROM (
      SELECT r.conv_id, l.i, {row('z', {'s': '', 'u': ''}, 'u')}, {row('s', {'u': ''}, 'u')}, {row('u', {'a': ''}, 'a')}, {row('a', {'u': ''}, 'u')}
      FROM rest r JOIN lines l ON l.conv_id IS NOT DISTINCT FROM r.conv_id AND l.i = r.i - 1))
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM lines GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(CAST(left(z.k, 9) AS BIGINT), 0) AS cost, coalesce(substr(z.k, 10), '') AS audit, sha256(coalesce(array_to_string(z.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counted n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN (SELECT * FROM rest WHERE i = 1) r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
"""

#: The other operators depend on hashes, fitted models, tokenizers or sequential packing, and are tested against brute force.
ORACLE_SQL = {"op1_ngram_jaccard_join": _OP1, "op2_license_scan": license_sql(), "op3_source_mixing": _OP3, "op5_exact_dedup": _OP5, "op11_centroid_clustering": _cluster_sql(), "op13_conversation_repair": _repair_sql()}
