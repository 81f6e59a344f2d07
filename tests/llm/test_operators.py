"""The training-data operators against brute force, on small tables with nulls, ties, repeats and very long texts."""

import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import common as C
from tessera.llm import license_scan as LS
from tessera.llm import packing, sharding, suffix_dedup
from tessera.llm.exact_dedup import drop_copies, exact_groups
from tessera.llm.language_kernel import identify_languages, keep_identified
from tessera.llm.media_columns import decode_media, document_media, encode_media, page_sequences, parse_html
from tessera.llm.ngram_join import drop_near_copies, ngram_join
from tessera.llm.quality_nbsvm import score_quality
from tessera.llm.source_mixing import mix_sources, mixed_documents, source_targets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts(seed: int = 3) -> list[str | None]:
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghilmnorstu") for _ in range(r.randint(2, 8))) for _ in range(900)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = [say(r.randint(12, 260)) for _ in range(60)]
    passage = say(70)
    out: list[str | None] = list(base)
    for b in base[:25]:
        w = b.split()
        w[r.randrange(len(w))] = "changed"
        out += [b, " ".join(w).upper(), b + "\n" + say(2)]
    out += [say(40) + " " + passage + " " + say(30) for _ in range(8)]
    out += [None, "", " \n\t", "one", "two words", "one", "é ü ñ", "12 34", "x" * 700, "ab " * 400, say(9000), say(9000)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", None][i % 5 % 3], 1) for i, t in enumerate(texts())]
    rows.append(rows[4])  # a repeated row
    return spark.createDataFrame(rows, SCHEMA).withColumn("size", F.lit("clash")).withColumn("key", F.lit(0)).repartition(5)


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text: str, n: int) -> frozenset:
    w = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def linked_by_brute_force(rows, n, num, den):
    """Of each id: its set, the smallest id reached, and the rows it is linked with (a repeated row is another)."""
    sets = {i: shingles(t, n) for i, t in rows}
    up, many, times = {i: i for i in sets}, Counter(), Counter(i for i, _ in rows)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
            many[a] += times[b]
            many[b] += times[a]
    return {i: (len(s), root(i), many[i] + (times[i] - 1 if s else 0)) for i, s in sets.items()}


@pytest.mark.parametrize(("n", "num", "den"), [(3, 9, 10), (5, 4, 5)])
def test_ngram_join(docs, rows, n, num, den):
    want = linked_by_brute_force(rows, n, num, den)
    got = ngram_join(docs, n, num, den).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got} == {(i, *w) for i, w in want.items()}
    if n == 5:
        kept = drop_near_copies(docs, n, num, den)
        assert kept.columns == docs.columns
        times = Counter(i for i, (size, root, _) in want.items() if root == i or not size)
        assert Counter(r.doc_id for r in kept.select("doc_id").collect()) == times


def near_group(count: int, seed: int) -> list[tuple[int, str]]:
    """A large group of near copies of which many pairs are just under or over the threshold, and some other texts."""
    r = random.Random(seed)
    base = [f"w{r.randrange(500)}" for _ in range(120)]
    out = []
    for i in range(count):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        out.append((i, " ".join(w)))
    return out + [(count + i, " ".join(f"y{r.randrange(60)}" for _ in range(30))) for i in range(20)]


@pytest.mark.parametrize("settings", [{}, {"digest_bits": 7}, {"weight": 4000}])
def test_ngram_join_of_a_large_group(spark, settings):
    rows = near_group(150, 4)
    want = linked_by_brute_force(rows, 5, 4, 5)
    got = ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), 5, 4, 5, **settings).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got} == {(i, *w) for i, w in want.items()}
    assert max(w[2] for w in want.values()) < 149 and len({w[1] for w in want.values()}) > 21


@pytest.mark.parametrize("weight", [2000, 6000])
def test_joining_up_tiles_loses_no_link(spark, weight):
    from tessera.llm import ngram_join as J

    rows = near_group(150, 8)
    want = linked_by_brute_force(rows, 5, 4, 5)
    got = J._joined(spark.createDataFrame(rows, "doc_id long, text string"), 5, 4, 5, False, weight=weight).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(i, w[1]) for i, w in want.items()}


def test_entries_travel_as_arrays_by_bucket(monkeypatch):
    """Every entry of a key and salt is in one bucket, and those that hold two sets are found."""
    import pyarrow as pa

    from tessera.llm import ngram_join as J

    monkeypatch.setattr(J, "WINDOW", 1 << 10)
    monkeypatch.setattr(J, "COMMON", 2)
    some = pa.record_batch({"text": pa.array([t or "" for t in texts()] + ["a b c d e f g h i j k l " + str(i) for i in range(9)])})
    sent = [b for part in (some.slice(0, 70), some.slice(70)) for b in J._entries(3, 4, 5, 64, {}, 16)(iter([part]))]
    by_key, where, n = defaultdict(set), defaultdict(set), 0
    for r in pa.Table.from_batches(sent).to_pylist():
        for key, salt, digest, _ in zip(r["key"], r["salt"], r["digest"], r["spare"], strict=True):
            by_key[key, salt].add(digest)
            where[key, salt].add(r["bucket"])
            n += 1
    assert n > 10 * sum(b.num_rows for b in sent) and {len(b) for b in where.values()} == {1}
    table = pa.Table.from_batches(sent).sort_by("bucket")
    for size in (7, 1000):
        found = pa.Table.from_batches(list(J._shared(iter(table.to_batches(max_chunksize=size)))))
        assert set(found["digest"].to_pylist()) == {d for ds in by_key.values() if len(ds) > 1 for d in ds}
        common = {r["key"] for r in found.to_pylist() if r["common"]}
        assert common == {k for (k, s), ds in by_key.items() if len(ds) > 1 and (len(ds) > 2 or s)}


@pytest.mark.parametrize(("bucket", "many"), [(1 << 20, 12), (128, 84)])
def test_entries_of_many_partitions_share_rows(spark, monkeypatch, bucket, many):
    """On many partitions a task's entries still travel in a row for each bucket, and buckets follow the shingles."""
    from tessera.llm import ngram_join as J

    asked, entries = [], J._entries
    monkeypatch.setattr(J, "BUCKET", bucket, raising=False)  # read on the driver
    monkeypatch.setattr(J, "_entries", lambda *a: asked.append(a) or entries(*a))
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        rows = near_group(80, 6)
        want = linked_by_brute_force(rows, 5, 4, 5)
        got = ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), 5, 4, 5).collect()
        assert {(r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got} == {(i, *w) for i, w in want.items()}
        docs = spark.createDataFrame(rows, "doc_id long, text string").select("text").repartition(3)
        sent = docs.mapInArrow(entries(*asked[0]), "bucket int, key array<long>, salt array<int>, digest array<long>, spare array<int>").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert [a[-1] for a in asked] == [many]
    assert 0 < len(sent) <= 3 * many and sum(len(r["key"]) for r in sent) > 10 * len(sent)


def test_crowded_entries_are_candidates(spark, monkeypatch):
    from tessera.llm import ngram_join as J

    monkeypatch.setattr(J, "TILE", 40)  # read on the driver
    rows = near_group(150, 5)
    want = linked_by_brute_force(rows, 5, 4, 5)
    got = ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), 5, 4, 5).collect()
    assert {(r.doc_id, r.component_id, r.n_links) for r in got} == {(i, *w[1:]) for i, w in want.items()}


@pytest.mark.parametrize("counted", [True, False])
def test_a_common_passage_is_not_compared_all_with_all(spark, monkeypatch, counted):
    """Of sets that only a passage joins (their entries are crowded) those that are linked meet, and no others."""
    from tessera.llm import ngram_join as J

    monkeypatch.setattr(J, "TILE", 40)  # read on the driver
    met, dealt = [], J._dealt
    monkeypatch.setattr(J, "_dealt", lambda plan, *a: met.append({r["digest"] for r in plan.select("digest").collect()}) or dealt(plan, *a))
    r = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(200))
    rows = [(i, f"{passage} " + " ".join(f"w{r.randrange(10**6)}" for _ in range(120))) for i in range(90)]
    rows += [(100 + i, f"{rows[i][1]} more{i}") for i in range(5)]
    want = linked_by_brute_force(rows, 5, 4, 5)
    got = J._joined(spark.createDataFrame(rows, "doc_id long, text string"), 5, 4, 5, counted, weight=4000).collect()
    assert {(x.doc_id, x.component_id) for x in got} == {(i, w[1]) for i, w in want.items()}
    assert not counted or {(x.doc_id, x.n_links) for x in got} == {(i, w[2]) for i, w in want.items()}
    assert len(set().union(*met)) == 10


def test_sums_of_bytes():
    from tessera.llm import ngram_join as J

    r = np.random.Generator(np.random.PCG64(6))
    for width in (64, 256, 1024):
        rows = np.concatenate([r.integers(0, 256, (9, width)), np.full((1, width), 255)]).astype(np.uint8)
        assert (J.row_sums(rows) == rows.sum(axis=1, dtype=np.int64)).all()


def test_bound_never_loses_a_link():
    from tessera.llm import ngram_join as J

    r, limits = np.random.Generator(np.random.PCG64(4)), J.Limits(4, 5)
    base = r.choice(1 << 40, 300, replace=False).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[r.random(300) > r.random() * 0.3], r.integers(0, 1 << 40, r.integers(1, 40)).astype(np.uint64)])) for _ in range(200)]
    sizes = np.array([len(s) for s in sets])
    for groups in (64, 256):
        points = J.count_vectors(np.repeat(np.arange(200), sizes), np.concatenate(sets), np.full(200, groups)).reshape(-1, groups)
        found = {tuple(sorted(p)) for x, y in J.RTree(points, sizes).join(limits) for p in zip(x.tolist(), y.tolist(), strict=True)}
        links = {(a, b) for a, b in itertools.combinations(range(200), 2) if 5 * (i := len(np.intersect1d(sets[a], sets[b]))) >= 4 * (sizes[a] + sizes[b] - i)}
        assert links and links <= found


def test_sieve_passes_all_members(spark):
    some = spark.range(0, 5000, 7).select(F.xxhash64("id").alias("h"))
    passes = C.sieve(some)
    kept = {r.id for r in spark.range(5000).where(passes(F.xxhash64("id"))).collect()}
    assert set(range(0, 5000, 7)) <= kept and len(kept) < 800
    assert spark.range(50).where(C.sieve(some.limit(0))(F.xxhash64("id"))).count() == 0


def test_one_doc_id_with_two_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    data = [(5, a), (5, b), (3, b + " more"), (7, c), (7, c), (7, c + " more"), (8, a + " more"), (9, None), (9, c.upper() + " x"), (None, "p q"), (None, a)]
    docs = spark.createDataFrame([(i, t, None, None, 1) for i, t in data], SCHEMA).withColumn("text_hash", F.lit("clash"))
    kept = [(r.doc_id, (r.text or "-")[0]) for r in drop_near_copies(docs).collect()]
    assert Counter(kept) == Counter([(5, "a"), (3, "b"), (7, "c"), (9, "-"), (None, "p")])


def test_license_scan_without_a_notices_rarest_words(spark):
    filler = [(i, "zz", None, None, 1) for i in range(1000)]
    cut = "permission is hereby granted free of charge to any individual getting a copy of this software"
    rows = [*filler, *((1000 + i, cut, None, None, 1) for i in range(5))]
    got = {r.doc_id: r for r in LS.license_scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1002].labels == "mit" and 0.8 <= got[1002].score < 1 and len(got[1002].hits) == 1 and got[1].score == 0


def scanned_by_brute_force(rows, templates, least=0.8):
    """(n_words, hits) of each text: every template at every start."""
    words = {i: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) for i, t in rows}
    count = Counter(w for some in words.values() for w in set(some))
    idf = lambda w: np.log((1 + len(rows)) / (1 + count[w])) + 1e-6
    out = {}
    for i, some in words.items():
        at, hits = dict(enumerate(some)), set()
        for t in templates:
            if not set(t.must) <= set(some):
                continue
            for start in range(0 if t.exact else -len(t.words), len(some)):
                same = [at.get(start + k) == w for k, w in enumerate(t.words)]
                share = 1.0 if t.exact else sum(idf(w) for w, s in zip(t.words, same, strict=True) if s) / sum(map(idf, t.words))
                if all(same[t.place : t.place + len(t.must)]) and share >= least:
                    hits.add((start, t.label, round(min(share, 1.0), 6), t.exact))
        out[i] = len(some), hits
    return out


def test_license_scan(spark, docs, rows):
    r = random.Random(7)
    extra = [
        "x Under the MIT License, the MIT license. CC BY-NC 4.0 apache license\nVersion 2", "The MIT License", "released under the MIT license.", "mit the license mit cc by",
        "This work is licensed under the GNU General Public License, version 3.", "under the mit license under the mit license under the MIT, license",
    ]
    for t in LS.NOTICES:
        for share in (0.0, 0.03, 0.15, 0.4):
            w = ["other" if r.random() < share else x for x in t.words]
            extra.append("Copyright 2020 someone. " + " ".join(w) + " the end")
        extra.append(" ".join(t.words[1:]))
        extra.append(t.text)
    every = [(i, t) for i, t in dict(rows).items()] + [(500 + i, t) for i, t in enumerate(extra)]
    got = {r.doc_id: r for r in LS.license_scan(spark.createDataFrame(every, "doc_id long, text string")).collect()}
    want = scanned_by_brute_force(every, LS.BASE + LS.NOTICES)
    assert sum(len(h) for _, h in want.values()) > 40
    for i, (n, hits) in want.items():
        assert (got[i].n_words, {(h.start, h.label, round(h.share, 6), h.exact) for h in got[i].hits}) == (n, hits)
        base = [h for h in hits if h[3]]
        assert (got[i].n_base, got[i].first_word, got[i].last_word) == (len(base), min((h[0] for h in base), default=None), max((h[0] for h in base), default=None))
        assert (got[i].base_labels, got[i].labels) == (",".join(sorted({h[1] for h in base})), ",".join(sorted({h[1] for h in hits})))
    g = [got[500 + i] for i in range(6)]
    assert (g[0].n_words, g[0].n_base, g[0].first_word, g[0].last_word, g[0].base_labels, g[0].score) == (17, 3, 1, 13, "apache-2,cc-by-nc,mit", 1.0)
    assert (g[1].n_base, g[1].base_labels, g[2].first_word, g[3].labels, g[4].labels, g[5].n_base) == (0, "", 1, "", "gpl-3", 3)
    assert LS.license_scan(empty(spark)).count() == 0


def targets(spark, sizes):
    rows = source_targets(spark.createDataFrame(sizes, "source string, size long")).collect()
    return {r.source: r.target for r in rows}


def test_targets_share_excess(spark):
    got = targets(spark, [("b", 100), ("a", 1000), (None, 50)])
    assert got[None] == 100 and got["b"] == 200 and got["a"] == pytest.approx(1425)
    assert targets(spark, []) == {} and targets(spark, [("a", 0)]) == {"a": 0}
    r = random.Random(6)
    for _ in range(4):
        sizes = [(s, r.choice([0, 3, 50, 4000])) for s in r.sample(["é", "z", "Z", "\U0001f600", "\uffff", "a", "ab", None], 6)]
        size, order = dict(sizes), sorted((s for s, _ in sizes), key=lambda s: (s is None, [ord(c) for c in s or ""]))
        weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
        left, free, want = 1.5 * sum(size.values()), set(order), {}
        while free:
            total = sum(weight[s] for s in free)
            over = {s for s in free if left * weight[s] / total > 2 * size[s]}
            want |= {s: 2 * size[s] if over else left * weight[s] / total for s in over or free}
            left -= sum(want[s] for s in over)
            free -= over or set(free)
        assert targets(spark, sizes) == pytest.approx(want)


def test_source_mixing(spark, docs, rows):
    got = mix_sources(docs).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mix_sources(docs).collect()))
    size = Counter(len(t.encode().split()) for _, t in rows)
    assert Counter(r["size"] for r in got) == size
    by, longest = defaultdict(int), max(size)
    for r in got:
        by[r.source] += r.taken
        assert r.taken in (0, r["size"], 2 * r["size"])
    for r in got:
        assert abs(by[r.source] - r.target) <= longest and r.target <= 2 * r.source_size
    # The queue by brute force: copies by the virtual time of their middles, cut at the budget.
    order, queue = {s: sorted((r for r in got if r.source == s), key=lambda r: r.row_hash) for s in by}, []
    for some in order.values():
        sent = 0
        for r in some:
            if r["size"] and r.target:
                queue += [((sent + r["size"] / 2 + e * r.source_size) / r.target, r.row_hash, r["size"]) for e in (0, 1)]
            sent += r["size"]
    used, want = 0, Counter()
    for time, key, n in sorted(queue):
        if used + n / 2 > 1.5 * sum(r["size"] for r in got):
            break
        used += n
        want[key] += 1
    assert Counter({r.row_hash: r.copies for r in got if r.copies}) == Counter({k: n // Counter(r.row_hash for r in got)[k] for k, n in want.items()})
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len((r.text or "").encode().split()) for r in mixed.collect()) == pytest.approx(sum(by.values()), abs=2 * 160)
    ordered = mixed_documents(docs, queued=True)
    assert Counter(r.doc_id for r in ordered.collect()) == Counter(r.doc_id for r in mixed.collect())
    assert mix_sources(empty(spark)).count() == 0 and mixed_documents(empty(spark)).count() == 0


def one_by_one(sizes, loads):
    loads = list(loads)
    for size in sorted(sizes, reverse=True):
        k = loads.index(min(loads))
        loads[k] += size
    return loads


def test_longest_first_is_as_one_by_one():
    r = random.Random(3)
    for _ in range(100):
        classes = [(s, s, r.choice([1, 2, 7, 60])) for s in r.sample(range(1, 400), 8)]
        start = [r.randrange(300) for _ in range(7)]
        dealt, loads = sharding.longest_first(classes, start)
        assert loads == one_by_one([s for _, s, n in classes for _ in range(n)], start)
        assert all(sum(dealt[s]) == n for s, _, n in classes)


def test_sharding(spark, docs, rows):
    got = sharding.shard_documents(docs, 4).collect()
    assert len(got) == len(rows)
    slots, where, load = defaultdict(list), defaultdict(set), Counter()
    text, groups = dict(rows), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        where[text[r.doc_id]].add(r.shard)
        load[r.shard] += r["size"]
        groups[text[r.doc_id]] += r["size"]
        assert r["size"] == len(text[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in where.values())
    assert max(groups.values()) > sharding.FINE
    # Longest first, one by one, gives the same loads: no class of this table holds two sizes.
    assert sorted(load.values()) == sorted(one_by_one(groups.values(), [0] * 4))
    assert sharding.shard_documents(empty(spark), 4).count() == 0


def test_exact_groups(spark, docs, rows, monkeypatch):
    by = defaultdict(list)
    for i, t in rows:
        by[t].append(i)
    got = exact_groups(docs).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        g = by[text[r.doc_id]]
        assert (r.keep_id, r.group_size, r.text_sha256) == (max(g), len(g), hashlib.sha256(text[r.doc_id].encode()).hexdigest())
    assert Counter(r.doc_id for r in got if r.kept) == Counter(max(g) for g in by.values())
    assert Counter(r.doc_id for r in drop_copies(docs).select("doc_id").collect()) == Counter(max(g) for g in by.values())
    assert exact_groups(empty(spark)).count() == 0


def test_suffix_dedup(spark, docs, rows):
    raw = [(i, t.encode()) for i, t in rows]
    seen = Counter(b[s : s + 200] for _, b in raw for s in range(len(b) - 199))
    want = []
    for i, b in raw:
        mark = bytearray(len(b))
        for s in range(len(b) - 199):
            if seen[b[s : s + 200]] > 1:
                mark[s : s + 200] = b"\1" * 200
        kept = bytes(x for x, m in zip(b, mark, strict=True) if not m)
        want.append((i, len(b), sum(mark), tuple((m.start(), m.end()) for m in re.finditer(b"\1+", bytes(mark))), hashlib.sha256(kept).hexdigest()))
    clash = suffix_dedup.repeated_spans(docs, id_bits=5).collect()
    assert Counter((r.doc_id, r.n_removed, r.kept_sha256) for r in clash) == Counter((w[0], w[2], w[4]) for w in want)
    got = suffix_dedup.repeated_spans(docs).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, tuple((s.start, s.end) for s in r.spans), r.kept_sha256) for r in got) == Counter(want)
    assert suffix_dedup.repeated_spans(empty(spark)).count() == 0


def test_multikey_order_sorts():
    keys = np.random.Generator(np.random.PCG64(1)).integers(0, 3, (400, 5), dtype=np.uint64)
    got = keys[suffix_dedup.multikey_order(keys)]
    assert got.tolist() == sorted(keys.tolist())


def test_quality_is_learned(spark):
    r = random.Random(1)
    say = lambda junk: " ".join("".join(r.choice("abcdef") for _ in range(4)) + ("***" if junk and r.random() < 0.4 else "") for _ in range(40))
    data = [(i, say(i % 4 == 0), None, None, 1) for i in range(400)]
    docs = spark.createDataFrame([*data, (900, None, None, None, 1), (None, "abc", None, None, 1), (901, "", None, None, 1)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    got = score_quality(docs, labels).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 403 and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id for r in held} == {i for i in [*range(400), 900, 901] if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum((r.score >= 0.5) == (r.doc_id % 4 != 0) for r in held if r.doc_id < 400) >= 0.97 * len([r for r in held if r.doc_id < 400])
    assert score_quality(docs, labels.limit(0)).count() == 403 and score_quality(empty(spark), labels).count() == 0


def test_media(spark, docs, rows):
    text = dict(rows)
    got = document_media(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        b = text[r.doc_id].encode()
        payload = b.ljust(max(64, -(-len(b) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_sha256 == hashlib.sha256(encode_media(b)).hexdigest() and r.caption == f"{len(b)} bytes"
    assert decode_media(encode_media(b"\x00\xff 12")).tobytes() == b"\x00\xff 12".ljust(64, b"\0")
    assert document_media(empty(spark)).count() == 0


def test_parse_html_keeps_positions_and_captions():
    got = parse_html('<p>a &amp; b</p><script>x<y</script><figure><img src="sha256:1" alt="no"><figcaption>cap <b>t</b></figcaption></figure>end <img src=2 alt="two"> 1 < 2')
    assert [(s["position"], s["kind"], s["text"] or s["ref"], s["caption"]) for s in got] == [(0, "text", "a & b", None), (1, "media", "sha256:1", "cap t"), (2, "text", "end", None), (3, "media", "2", "two"), (4, "text", "1 < 2", None)]
    assert parse_html(None) == [] and parse_html("") == []
    began = time.time()
    for hostile in ("<script" * 20_000, "<script>" * 20_000, "<!--" * 20_000, '<a "' * 20_000, '<a "' * 20_000 + '">', "<figcaption>" * 20_000 + "x", "&" * 20_000, "<a =" * 20_000):
        parse_html(hostile)
    assert time.time() - began < 30
    assert [s["text"] or s["ref"] for s in parse_html("a <!-- x --> b <script>no</script>c<style>no")] == ["a b c"]
    assert [s["text"] or s["ref"] for s in parse_html("3 < 4 <img src='x>y' alt=\"it's\"> <b broken")] == ["3 < 4", "x>y", "<b broken"]


def test_sequences_of_pages(spark):
    data = [(1, '<p>one<img src="a.png" alt="A"> two</p>'), (1, '<p>one<img src="a.png" alt="A"> two</p>'), (None, "<figure><video src=v></video><figcaption>said</figcaption></figure>"), (3, None), (4, ""), (5, "<style>x</style><!-- y -->")]
    pages = spark.createDataFrame(data, "page_id long, html string").withColumn("position", F.lit("clash"))
    got = Counter((r.page_id, r.position, r.kind, r.text, r.ref, r.caption) for r in page_sequences(pages).collect())
    assert got == Counter({(1, 0, "text", "one", None, None): 2, (1, 1, "media", None, "a.png", "A"): 2, (1, 2, "text", "two", None, None): 2, (None, 0, "media", None, "v", "said"): 1})


def brute_bins(sizes, cap):
    best = len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= cap:
                bins[k] += sizes[i]
                go(i + 1, bins)
                bins[k] -= sizes[i]
        go(i + 1, [*bins, sizes[i]])

    sizes = sorted(sizes, reverse=True)
    go(0, [])
    return best


def test_dominance_keeps_the_optimum():
    r = random.Random(5)
    for k in range(300):
        sizes = [r.randint(1 if k % 2 else 4, 20 if k % 3 else 12) for _ in range(r.randint(1, 9))]
        counts = np.bincount(sizes, minlength=21).astype(np.int64)
        fixed = packing.reduce_dominated(counts, 20)
        rest = [s for s in range(1, 21) for _ in range(counts[s])]
        assert all(sum(p) <= 20 for p, _ in fixed)
        assert sum(n for _, n in fixed) + (brute_bins(rest, 20) if rest else 0) == brute_bins(sizes, 20)
        packed = packing.pack_histogram([(s, sizes.count(s)) for s in set(sizes)], 20)
        assert Counter(itertools.chain.from_iterable(p * n for p, n in packed)) == Counter(sizes) and all(sum(p) <= 20 for p, _ in packed)


def test_best_fit_as_one_by_one():
    assert sum(n for _, n in packing.pack_histogram([(600, 1000), (200, 1999)], 1024)) == 1000
    r = random.Random(9)
    for _ in range(200):
        counts, rooms = np.zeros(31, dtype=np.int64), []
        for a in r.sample(range(1, 31), r.randint(1, 6)):
            counts[a] = r.randint(1, 30)
        for a in range(30, 0, -1):
            for _ in range(counts[a]):
                fit = min((x for x in rooms if x >= a), default=None)
                if fit is not None:
                    rooms.remove(fit)
                rooms.append((30 if fit is None else fit) - a)
        packed = packing.best_fit(counts, 30)
        assert Counter({x: n for x, n in Counter(30 - sum(p) for p, n in packed for _ in range(n)).items()}) == Counter(rooms)
        assert Counter(itertools.chain.from_iterable(p * n for p, n in packed)) == Counter({a: int(n) for a, n in enumerate(counts) if n})


def test_both_tokenizer_libraries_agree_on_plain_texts():
    """Random strings of all plain characters, and of those that the splitting pattern treats apart."""
    tokens = packing.Tokens(*packing.default_files())
    r = random.Random(12)
    every = "\t\n\r" + "".join(map(chr, range(32, 127))) + "".join(map(chr, range(0xC0, 0x250)))
    odd = " \n\t\r'sStTrReEvVmMlLdD09aZ.,!×÷ÿĀɏǅªß"
    for k in range(20_000):
        text = "".join(r.choice(odd if k % 2 else every) for _ in range(r.randint(1, 60)))
        if tokens.plain.fullmatch(text):
            assert tokens.fast.encode_ordinary(text) == tokens.slow.encode(text, add_special_tokens=False).ids, repr(text)


def test_clashing_names(spark, docs):
    """Columns named like those that operators use on the way, or like nothing at all."""
    names = ["row", "group_size", "keep_id", "copies", "n_shingles", "mix_row", "mix_copies", "y", "label_id", "kept", "text_sha256", "has_letter", "lang_pred", "a.b", "c d", "text_hash", "label", "part"]
    some = docs.select("doc_id", "text", "lang", "source")
    wide = some.select("*", *(F.lit(k).alias(c) for k, c in enumerate(names)))
    labels = spark.createDataFrame([(i, i % 2, 0, 5) for i in range(100)], "doc_id long, quality int, toxic int, y int")
    for f in (drop_copies, drop_near_copies, mixed_documents, keep_identified):
        got = f(wide)
        assert got.columns == wide.columns and Counter(r.doc_id for r in got.collect()) == Counter(r.doc_id for r in f(some).collect())
        assert {tuple(r)[4:] for r in got.collect()} == {tuple(range(len(names)))}
    for f in (ngram_join, exact_groups, mix_sources, sharding.shard_documents, LS.license_scan, suffix_dedup.repeated_spans, document_media, packing.pack_documents, identify_languages, lambda d: score_quality(d, labels)):
        assert f(wide).count() == f(some).count()


def test_packing(spark, docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    special = spark.createDataFrame([(700, "a <|endoftext|> b 日本  x", None, None, 1)], SCHEMA)
    some = docs.select("doc_id", "text").unionByName(special.select("doc_id", "text"))
    got = packing.pack_documents(some).collect()
    text = dict([*rows, (700, "a <|endoftext|> b 日本  x")])
    pieces, sequences, copies = defaultdict(list), defaultdict(list), Counter(i for i, _ in rows)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, t in text.items():
        ids = np.array([*plain.encode(t, add_special_tokens=False).ids, 2], dtype="<u4")
        first = (len(ids) - 1) % 1024 + 1
        ends = list(range(first, len(ids) + 1, 1024))
        want = [(k, e - (first if k == 0 else 1024), zlib.crc32(ids[e - (first if k == 0 else 1024) : e].tobytes())) for k, e in enumerate(ends)]
        assert Counter((r.piece, r.start, r.ids_crc32) for r in pieces[i]) == Counter(want * (copies[i] or 1))
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [0, *itertools.accumulate(r.length for r in s)][:-1] and sum(r.length for r in s) <= 1024
    assert len(sequences) <= 1.1 * sum(r.length for r in got) / 1024 + 1
    assert packing.pack_documents(empty(spark)).count() == 0


def test_languages(spark):
    r = random.Random(2)
    words = {"en": ["the", "and", "with", "thing"], "de": ["der", "und", "über", "nicht"], "fr": ["le", "être", "où", "que"]}
    data = [(i, " ".join(r.choice(words[lang]) for _ in range(20)), lang, None, 1) for i, lang in enumerate(["en", "de", "fr"] * 60)]
    odd = [(900, None, "en", None, 1), (901, "", "en", None, 1), (902, "12 + 3!", "en", None, 1), (903, "der und", None, None, 1), (None, "the thing", "xx", None, 1)]
    docs = spark.createDataFrame(data + odd, SCHEMA)
    got = {r.doc_id: r for r in identify_languages(docs).collect()}
    assert all(got[i].lang_pred == lang and 0 < got[i].score <= 1 for i, _, lang, _, _ in data)
    assert [got[i].lang_pred for i in (900, 901, 902, 903, None)] == ["und", "und", "und", "de", "en"] and got[902].score == 0
    kept = keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == len(data) + 2
    assert identify_languages(empty(spark)).count() == 0 and keep_identified(empty(spark)).count() == 0


def test_ngram_join_of_nothing(spark):
    assert ngram_join(empty(spark)).count() == 0 and drop_near_copies(empty(spark)).count() == 0
    alone = spark.createDataFrame([(1, None, None, None, 1), (None, "a b c d e f", None, None, 1), (7, "A b C d e f", None, None, 1)], SCHEMA)
    assert {(r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in ngram_join(alone).collect()} == {(1, 0, 1, 0), (None, 2, 7, 1), (7, 2, 7, 1)}


def test_pipeline_runs(spark, docs, tmp_path):
    import corpus_pipeline

    docs.select(*SCHEMA.replace(",", "").split()[::2]).write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "source_mixing", "best_fit_packing"]
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() > 0 and "sequence_id" in got.columns
