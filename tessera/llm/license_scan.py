"""License scans with a positional index of licence words, as column expressions only.

The index maps every word of the templates to (template, place) postings. A file that has all words of a template's
mandatory key phrase may hold it. Of the words that such templates need, the file's rarest (highest inverse document
frequency; one for each template) are looked up: each occurrence gives the starts that templates would have there,
and the other words are intersected by relative position around them. A template counts where its key phrase stands
in its place and the matched share of its inverse document frequencies is high enough. As every hit needs its key
phrase, and the rarest word of it is looked up, no hit is lost.

Document frequencies are counted over all documents; their table has a row for each template word, so its size
is bounded by the templates, and the index is a literal of the plan. Texts are split into words once; what is
written for the second step are the words of those files only that may hold a template.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize
from tessera.llm.license_texts import TEXTS

#: After lower-casing the same as [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, in a form that is matched much faster.
WORD = r"[a-z0-9\x80-\x{10FFFF}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    """``exact``: all words must stand there. ``key``: these words must stand at their place of the template."""

    label: str
    key: str
    text: str
    exact: bool = False

    @property
    def words(self) -> list[str]:
        return re.findall(r"[a-z0-9]+", self.text.lower())

    @property
    def must(self) -> list[str]:
        return self.words if self.exact else re.findall(r"[a-z0-9]+", self.key.lower())

    @property
    def place(self) -> int:
        """Where the key phrase first stands in the template."""
        words, must = self.words, self.must
        return next(i for i in range(len(words)) if words[i : i + len(must)] == must)


#: Labels that a place of the phrase alone gives.
BASE = tuple(Template(label, phrase, phrase, True) for label, phrase in (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")))
#: Notices and texts known beyond these.
NOTICES = tuple(Template(*t) for t in TEXTS)


def words_of(text: Column) -> Column:
    """A-Z in lower case, then the words."""
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def _strings(some: list[str]) -> Column:
    return F.array(*map(F.lit, some)).cast("array<string>")


def weights(vocabulary: list[str], counts: dict[str, int], total: int) -> dict[str, float]:
    """Inverse document frequency of each word."""
    return {w: math.log((1 + total) / (1 + counts.get(w, 0))) + 1e-6 for w in vocabulary}


def license_scan(docs: DataFrame, templates: tuple[Template, ...] = BASE + NOTICES, least: float = 0.8) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_words, hits, n_base, first_word, last_word, base_labels, labels, score) of every row.

    ``hits``: array of (start word from 0, label, share of the template's weight that stands there, exact). A
    hit of an ``exact`` template needs all its words in a row. Any other needs its key phrase in its place and at
    least ``least`` of its weight; its start is below 0 where the text begins inside the template.
    n_base, first_word, last_word, base_labels: of exact hits (0, null, null and "" without any). labels: of all.
    score: the largest share, 0 without hits, to 9 digits. Labels are distinct, sorted and joined by commas.
    Null and empty texts have no words and no hits. Repeated rows give repeated results. An empty table gives an
    empty table. Other columns are ignored.
    """
    split, must = [t.words for t in templates], [t.must for t in templates]
    vocabulary = sorted({w for t in split for w in t})
    words = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    words = words.withColumn("here", F.array_intersect("words", _strings(vocabulary)))
    whole = F.transform(F.array(*(F.struct(F.lit(n).alias("n"), _strings(sorted(set(m))).alias("must")) for n, m in enumerate(must))), lambda t: F.when(F.size(F.array_except(t["must"], F.col("here"))) == 0, t["n"]))
    words = words.withColumn("may", F.when(F.size("here") > 0, F.array_compact(whole)).otherwise(F.array().cast("array<int>")))
    words = materialize(words.select("doc_id", F.size("words").cast("long").alias("n_words"), "here", "may", F.when(F.size("may") > 0, F.col("words")).alias("words")), "words")
    counted = words.select(F.explode(F.array_append("here", "")).alias("w")).groupBy("w").count().collect()  # at most the vocabulary and one
    counts = {r["w"]: r["count"] for r in counted}
    idf = weights(vocabulary, counts, counts.get("", 0))
    # For each template the word of its key phrase that a file with all of them is looked up by.
    rarest = _strings([max(m, key=lambda w: (idf[w], w)) for m in must])
    index: dict[str, list[tuple[int, int]]] = {}
    for n, t in enumerate(split):
        for i, w in enumerate(t):
            index.setdefault(w, []).append((n, i))
    postings = F.create_map(*(x for w, p in sorted(index.items()) for x in (F.lit(w), F.array(*(F.struct(F.lit(n).alias("n"), F.lit(i).alias("place")) for n, i in p)))))
    known = F.array(*(F.struct(
        F.lit(t.label).alias("label"), _strings(split[n]).alias("words"), F.array(*(F.lit(idf[w]) for w in split[n])).alias("idf"), F.lit(t.exact).alias("exact"),
        F.lit(t.place).alias("from"), F.lit(t.place + len(must[n]) - 1).alias("to"), F.lit(sum(idf[w] for w in split[n])).alias("total"),
    ) for n, t in enumerate(templates)))

    def hit(x: Column) -> Column:
        t = F.get(known, x["n"])
        stands = lambda i: F.coalesce(F.get(F.col("words"), x["start"] + i) == F.get(t["words"], i), F.lit(False))
        firm = F.forall(F.sequence(t["from"], t["to"]), stands)
        got = F.aggregate(F.sequence(F.lit(0), F.size(t["words"]) - 1), F.lit(0.0), lambda sum_, i: sum_ + F.when(stands(i), F.get(t["idf"], i)).otherwise(0.0))
        share = F.when(firm, F.when(t["exact"], 1.0).otherwise(F.round(F.least(got / t["total"], F.lit(1.0)), 9)))
        return F.struct(x["start"].alias("start"), t["label"].alias("label"), share.alias("share"), t["exact"].alias("exact"))

    look = F.array_distinct(F.transform("may", lambda n: F.get(rarest, n)))
    places = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("at"))), lambda x: F.array_contains(F.col("look"), x["w"]))
    starts = F.flatten(F.transform("places", lambda x: F.transform(postings[x["w"]], lambda p: F.struct(p["n"].alias("n"), (x["at"] - p["place"]).alias("start")))))
    some = words.where(F.size("may") > 0).withColumn("look", look).withColumn("places", places).withColumn("starts", F.array_distinct(F.filter(starts, lambda x: F.array_contains(F.col("may"), x["n"]))))
    found = some.select("doc_id", "n_words", F.array_distinct(F.filter(F.transform("starts", hit), lambda h: h["share"] >= least)).alias("hits"))
    none = words.where(F.size("may") == 0).select("doc_id", "n_words", F.array().cast(found.schema["hits"].dataType).alias("hits"))
    base = F.filter("hits", lambda h: h["exact"])
    joined = lambda hits: F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["label"]))), ",")
    return found.unionByName(none).select(
        "doc_id", "n_words", "hits", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda h: h["start"])).cast("long").alias("first_word"), F.array_max(F.transform(base, lambda h: h["start"])).cast("long").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("hits")).alias("labels"), F.coalesce(F.array_max(F.transform("hits", lambda h: h["share"])), F.lit(0.0)).alias("score"),
    )


def license_sql(templates: tuple[Template, ...] = BASE + NOTICES, least: float = 0.8) -> str:
    """The scan as SQL over the table ``documents``, without ``hits``."""
    given = ", ".join(f"({n}, '{t.label}', {t.exact}, {t.place}, {len(t.must)}, {i}, '{w}')" for n, t in enumerate(templates) for i, w in enumerate(t.words))
    return rf"""
WITH template(n, label, exact, place, many, i, w) AS (VALUES {given}
), texts AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), words AS (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS spot FROM texts
), known AS MATERIALIZED (SELECT * FROM words WHERE w IN (SELECT w FROM template)
), idf AS (
  SELECT w, ln((1.0 + (SELECT count(*) FROM texts)) / (1.0 + count(DISTINCT r))) + 1e-6 AS idf FROM (SELECT DISTINCT w FROM template) LEFT JOIN known USING (w) GROUP BY w
), keyed AS MATERIALIZED (
  SELECT r, n, spot - i AS start FROM known JOIN template USING (w) WHERE i BETWEEN place AND place + many - 1 GROUP BY r, n, spot - i, many HAVING count(*) = many
), totals AS (SELECT n, label, exact, sum(idf) AS total FROM template JOIN idf USING (w) GROUP BY ALL
), matched AS (
  SELECT k.r, k.n, k.start, sum(idf.idf) AS got FROM keyed k JOIN template t USING (n) JOIN known o ON o.r = k.r AND o.spot = k.start + t.i AND o.w = t.w JOIN idf ON idf.w = t.w GROUP BY ALL
), hits AS (
  SELECT r, start, label, exact, CASE WHEN exact THEN 1.0 ELSE round(least(got / total, 1.0), 9) END AS share FROM matched JOIN totals USING (n)
), kept AS (SELECT * FROM hits WHERE share >= {least}
), found AS (
  SELECT r, count(DISTINCT CASE WHEN exact THEN start || label END) AS n_base, min(CASE WHEN exact THEN start END) AS first_word, max(CASE WHEN exact THEN start END) AS last_word,
    string_agg(DISTINCT CASE WHEN exact THEN label END, ',' ORDER BY CASE WHEN exact THEN label END) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM kept GROUP BY r
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM texts LEFT JOIN found USING (r)
"""
