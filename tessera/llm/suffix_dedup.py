"""Suffix-array dedup: removal of repeated byte strings of a given length.

The suffixes that are sorted are sparse. In every string of ``length`` bytes the leftmost least of its hashed
GRAM-byte grams is an anchor, so equal strings have anchors at equal places, and a string that repeats has an
anchor whose gram repeats. Suffixes start at anchors with repeated grams, and carry what stands before them.

Sampled splitters range-partition the suffixes by their leading bytes, so that suffixes which can be part of equal
strings meet: forward by all that strings starting near the anchor have after it, and backward by the gram and
what strings starting far before it have there. Equal leads never straddle a boundary, so nothing has to be
compared across one, and a short line that stands everywhere is told apart by what surrounds it. Each bucket is
sorted by multikey quicksort, forward from the anchors and backward from them; runs of common prefixes in the two
orders give the classes of equal strings for each place of the anchor.

Suffixes that agree in over half of ``length`` bytes meet in one task: a passage that very many different texts
have is that task's work, with under 300 bytes for each place (exact copies of a text count once).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C
from tessera.llm.common import U, materialize

GRAM = 32
KNOWN, WITNESS = 1, 2
#: Texts with one 64-bit number that are told apart, at most (at 10^10 texts about three are expected); numbers a task remembers.
CLASHES, MEMORY = 10_000, 1 << 20


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors in ``data`` and hashes of their grams. Long texts are taken in overlapping tiles."""
    wide = length - GRAM + 1  # grams in a string
    places, hashes, tile = [], [], 1 << 20
    for at in range(0, max(len(data) - length + 1, 0), tile):
        part = data[at : at + tile + length - 1]
        running = C.prefix_hash(C.BYTE_CODE[part])
        n = len(part) - GRAM + 1
        gram = C.mix((running[GRAM:] - running[:-GRAM]) * C.powers(len(running), "down")[:n])
        least = (gram & U(0xFFFFFFFFFF000000)) | np.arange(n, dtype=np.uint64)
        width = 1
        while 2 * width <= wide:
            least, width = np.minimum(least[:-width], least[width:]), 2 * width
        if width < wide:
            least = np.minimum(least[: len(least) - (wide - width)], least[wide - width :])
        starts = np.arange(len(least)) + at
        whole = np.searchsorted(offsets, starts, "right") == np.searchsorted(offsets, starts + length - 1, "right")
        mark = np.zeros(n, dtype=bool)
        mark[(least[whole] & U(0xFFFFFF)).astype(np.int64)] = True
        here = np.flatnonzero(mark)
        places.append(here + at)
        hashes.append(gram[here])
    if not places:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(hashes)[first]


def _anchored(length: int):
    """(gram, text's id, place, kind) of each distinct text that a task sees.

    A gram that the task itself has at several places is known to repeat: its places go straight on, dealt by a
    hash of their own (KNOWN), and one of them stands for it among the others' (WITNESS). So a hot gram meets
    in one task with at most one row from each.
    """

    def dealt(rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        gram, tid, place = (np.concatenate(x) for x in zip(*rows, strict=True))
        order = np.argsort(gram, kind="stable")
        gram, tid, place = gram[order], tid[order], place[order]
        same = np.concatenate([[False], gram[1:] == gram[:-1], [False]])
        many = same[1:] | same[:-1]
        witness = many & ~same[:-1]
        key = np.concatenate([np.where(many, C.mix(tid.view(np.uint64) + C.mix(place.astype(np.uint64))), gram), gram[witness]])
        kind = np.concatenate([np.where(many, KNOWN, 0), np.full(int(witness.sum()), WITNESS)]).astype(np.int32)
        return pa.record_batch({"gram": pa.array(C.signed(key)), "tid": pa.array(np.concatenate([tid, tid[witness]])), "place": pa.array(np.concatenate([place, place[witness]])), "kind": pa.array(kind)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        rows, size = [], 0
        for part, data, offsets in C.text_blocks(batches):
            tid = np.asarray(part.column("tid"))
            place, gram = anchors(data, offsets, length)
            row = np.searchsorted(offsets, place, "right") - 1
            fresh = np.zeros(len(tid), dtype=bool)
            if len(seen) > MEMORY:  # a text seen again later gives the same places again
                seen.clear()
            for i, t in enumerate(tid.tolist()):
                if t not in seen:
                    seen.add(t)
                    fresh[i] = True
            use = fresh[row]
            rows.append((gram[use], tid[row[use]], place[use] - offsets[row[use]]))
            size += int(use.sum())
            if size > 1 << 20:
                yield dealt(rows)
                rows, size = [], 0
        if size:
            yield dealt(rows)

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition by gram: places whose gram stands at another place, too."""
    got = [tuple(np.asarray(c) for c in b.columns) for b in batches if b.num_rows]
    if not got:
        return
    gram, tid, place, kind = (np.concatenate(x) for x in zip(*got, strict=True))
    del got
    known = kind == KNOWN
    yield pa.record_batch({"tid": pa.array(tid[known]), "place": pa.array(place[known])})
    gram, tid, place, kind = gram[~known], tid[~known], place[~known], kind[~known]
    order = np.lexsort((place, tid, gram))
    gram, tid, place, kind = gram[order], tid[order], place[order], kind[order]
    new = np.concatenate([[True], gram[1:] != gram[:-1]])[: len(gram)]
    apart = np.concatenate([[True], (tid[1:] != tid[:-1]) | (place[1:] != place[:-1])])[: len(gram)] | new
    group = np.cumsum(new) - 1
    n = len(gram)
    # A witness alone tells that its gram repeats; two tasks may have told of the same place.
    weight = np.bincount(group, weights=apart + 2.0 * (kind == WITNESS)) if n else np.zeros(0)
    hit = (weight[group] > 1) & (kind == 0) if n else np.zeros(0, dtype=bool)
    yield pa.record_batch({"tid": pa.array(tid[hit]), "place": pa.array(place[hit])})


def _suffixes(length: int):
    """(way, suffix, bytes before it read backward, text's id, place, none) at each place, for the two ways of sorting.

    Strings that start up to half of what can stand before an anchor are found among suffixes sorted forward
    (way 0), the others among those sorted backward (way 1); each way leads with what all its strings have.
    """
    half = (length - GRAM) // 2
    #: (way, bytes after and before the anchor that are sent, least and most bytes before it where a string starts)
    ways = ((0, length, half, 0, half), (1, length - half - 1, length - GRAM, half + 1, length - GRAM))

    def dealt(some: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
        rows: list[tuple] = []
        known: dict[int, list[tuple[int, int]]] = {}
        for way, after, before, low, high in ways:
            alike: dict[tuple[bytes, bytes], list[tuple[int, int]]] = {}
            for raw, tid, p in some:
                if len(raw) - p >= length - high and p >= low:
                    alike.setdefault((raw[p : p + after], raw[max(0, p - before) : p][::-1]), []).append((tid, p))
            for (ahead, behind), places in alike.items():
                rows.append((way, ahead, behind, *places[0], None))
                first, last = max(low, length - len(ahead)), min(high, len(behind))
                if len(places) > 1 and first <= last:  # what is alike here is known to repeat; one place stands for all
                    for tid, p in places:
                        known.setdefault(tid, []).append((p - last, p - first + length))
        for tid, spans in known.items():
            rows += [(2, (tid * 31 + s & 0xFFFFFFFF).to_bytes(4, "big"), b"", tid, s, e) for s, e in merged(spans)]
        kinds = (("way", pa.int32()), ("after", pa.binary()), ("before", pa.binary()), ("tid", pa.int64()), ("place", pa.int64()), ("end", pa.int64()))
        return pa.record_batch({c: pa.array([r[i] for r in rows], k) for i, (c, k) in enumerate(kinds)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[tuple[bytes, int, int]] = []
        for batch in batches:
            for i in range(batch.num_rows):
                raw, tid = batch.column("text")[i].as_buffer().to_pybytes(), batch.column("tid")[i].as_py()
                places = np.unique(np.asarray(batch.column("places")[i].values)).tolist()
                for k in range(0, len(places), 20_000):
                    some += [(raw, tid, p) for p in places[k : k + 20_000]]
                    if len(some) >= 20_000:
                        yield dealt(some)
                        some = []
        if some:
            yield dealt(some)

    return run


def multikey_order(keys: np.ndarray) -> np.ndarray:
    """Order of rows of big-endian 8-byte symbols: by the first symbol, then only inside ties by the next."""
    n, width = keys.shape
    order = np.argsort(keys[:, 0], kind="stable")
    tied = _ties(keys[order, 0], np.zeros(n, dtype=np.int64))
    for k in range(1, width):
        at = np.flatnonzero(tied >= 0)
        if not len(at):
            break
        group, column = tied[at], keys[order[at], k]
        inner = np.lexsort((column, group))
        order[at] = order[at[inner]]
        fresh = _ties(column[inner], group)
        tied = np.full(n, -1, dtype=np.int64)
        tied[at] = fresh
    return order


def _ties(value: np.ndarray, group: np.ndarray) -> np.ndarray:
    """A number for each run of equal (group, value), -1 where the run has one row."""
    new = np.concatenate([[True], (value[1:] != value[:-1]) | (group[1:] != group[:-1])])
    number = np.cumsum(new) - 1
    return np.where(np.bincount(number)[number] > 1, number, -1)


def _sorted_prefixes(strings: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings, and the common prefix of each with the one before it in that order."""
    size = np.asarray(pc.binary_length(strings)).astype(np.int64)
    wide = max(8, -(-width // 8) * 8)
    table = np.zeros((len(size), wide), dtype=np.uint8)
    raw = np.frombuffer(b"".join(strings.to_pylist()), dtype=np.uint8)
    table[np.arange(wide) < size[:, None]] = raw
    order = multikey_order(table.view(">u8").astype(np.uint64))
    table, size = table[order], size[order]
    common = np.zeros(len(size), dtype=np.int64)
    for i in range(1, len(size), 1 << 15):  # a zero byte may be content: prefixes end with the shorter string
        j = min(len(size), i + (1 << 15))
        apart = table[i:j] != table[i - 1 : j - 1]
        common[i:j] = np.minimum(np.where(apart.any(axis=1), apart.argmax(axis=1), wide), np.minimum(size[i:j], size[i - 1 : j - 1]))
    return order, common


def _classes(length: int):
    """Of a bucket: spans (text's id, start, end) of bytes whose ``length``-byte strings repeat."""
    half = (length - GRAM) // 2

    def spans(rows: pa.Table, low: int, high: int) -> pa.RecordBatch | None:
        """``low`` to ``high``: how many bytes before the anchor a string starts."""
        tid, place = (np.asarray(rows.column(c).combine_chunks()) for c in ("tid", "place"))
        key = np.lexsort((place, tid))
        once = np.concatenate([[True], (tid[key][1:] != tid[key][:-1]) | (place[key][1:] != place[key][:-1])])
        rows = rows.take(pa.array(np.sort(key[once])))
        n = len(rows)
        if n < 2:
            return None
        tid, place = (np.asarray(rows.column(c).combine_chunks()) for c in ("tid", "place"))
        after, before = (rows.column(c).combine_chunks() for c in ("after", "before"))
        fore, fore_common = _sorted_prefixes(after, length - low)
        back, back_common = _sorted_prefixes(before, high)
        ahead, behind = (np.asarray(pc.binary_length(x)).astype(np.int64) for x in (after, before))
        repeats = np.zeros((n, high - low + 3), dtype=np.int8)
        right, left = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
        for d in range(low, high + 1):
            right[fore] = np.cumsum(fore_common < length - d)
            left[back] = np.cumsum(back_common < d) if d else 0
            at = np.flatnonzero((behind >= d) & (ahead >= length - d))
            if len(at) < 2:
                continue
            both = right[at] * np.int64(n + 1) + left[at]
            order = np.argsort(both, kind="stable")
            same = np.concatenate([[False], both[order][1:] == both[order][:-1], [False]])
            repeats[at[order[same[1:] | same[:-1]]], d - low + 1] = 1
        edge = np.diff(repeats, axis=1)
        row, first = np.nonzero(edge == 1)
        _, last = np.nonzero(edge == -1)  # runs of d: low + first to low + last - 1
        return pa.record_batch({"tid": pa.array(tid[row]), "start": pa.array(place[row] - (low + last - 1)), "end": pa.array(place[row] - (low + first) + length)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got)
        way = np.asarray(rows.column("way").combine_chunks())
        told = rows.filter(pa.array(way == 2)).combine_chunks()
        yield pa.record_batch({"tid": told.column("tid").combine_chunks(), "start": told.column("place").combine_chunks(), "end": told.column("end").combine_chunks()})
        for w, low, high in ((0, 0, half), (1, half + 1, length - GRAM)):
            some = rows.filter(pa.array(way == w))
            if len(some) > 1 and (out := spans(some.combine_chunks(), low, high)) is not None:
                yield out

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            raw, tid = batch.column("text")[i].as_buffer().to_pybytes(), batch.column("tid")[i].as_py()
            spans = merged([(s["start"], s["end"]) for s in batch.column("spans")[i].as_py()])
            kept, at = hashlib.sha256(), 0
            for start, end in spans:
                kept.update(raw[at:start])
                at = end
            kept.update(raw[at:])
            rows.append((tid, spans, sum(e - s for s, e in spans), kept.hexdigest()))
        yield pa.record_batch({
            "tid": pa.array([r[0] for r in rows], pa.int64()), "cuts": pa.array([[{"start": s, "end": e} for s, e in r[1]] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            "removed": pa.array([r[2] for r in rows], pa.int64()), "sha": pa.array([r[3] for r in rows], pa.string()),
        })


def _short(text: Column, bits: int) -> Column:
    return F.shiftright(F.xxhash64(text), 64 - bits)


def _clashes(rows: DataFrame) -> list[str]:
    """Digests of texts whose number another text has, but for one of each number."""
    shared = rows.groupBy(F.col("tid").alias("t")).agg(F.min("sha256").alias("least"), F.max("sha256").alias("most")).where("least <> most")
    shared = materialize(shared, "clashes")
    if shared.isEmpty():
        return []
    found = rows.join(shared, F.col("tid") == F.col("t")).where("sha256 <> least").select("sha256").distinct().limit(CLASHES + 1).collect()
    if len(found) > CLASHES:
        raise ValueError(f"over {CLASHES} texts share a number: take more id_bits")
    return sorted(r["sha256"] for r in found)


def repeated_spans(docs: DataFrame, length: int = 200, id_bits: int = 64) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_bytes, n_removed, spans, kept_sha256) of every row.

    A text is its UTF-8 bytes (null: none). spans: maximal runs (start, end) of bytes that are in a string of
    ``length`` bytes which also starts elsewhere, in this text or another, as they are on input; n_removed: their
    bytes; kept_sha256: of the other bytes joined. Rows with equal texts repeat each other as a whole if they have
    ``length`` bytes. Shorter texts lose nothing. Repeated rows and null ids are rows like others. An empty
    table gives an empty table; other columns are ignored. ``length`` must be over GRAM. Texts go by ``id_bits`` bits
    of a hash; those that share them are told apart by SHA-256.
    """
    if length <= GRAM:
        raise ValueError(f"length must be over {GRAM}")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = C.text_column(docs)
    sha = F.sha2(F.col("text").cast("binary"), 256)
    docs = docs.select("doc_id", text.alias("text"), _short(text, id_bits).alias("tid"))
    rows = materialize(docs.select("doc_id", "tid", F.octet_length("text").cast("long").alias("n_bytes"), sha.alias("sha256")), "texts")
    odd = _clashes(rows)
    if odd:  # texts told apart by their digests get numbers of their own
        other = lambda tid, digest: F.when(digest.isin(odd), F.xxhash64(digest, F.lit(1))).otherwise(tid)
        docs, rows = docs.withColumn("tid", other(F.col("tid"), sha)), rows.withColumn("tid", other(F.col("tid"), F.col("sha256")))
    texts = rows.groupBy("tid").agg(F.min("doc_id").alias("some_id"), F.count(F.lit(1)).alias("copies"))
    found = docs.select("tid", "text").mapInArrow(_anchored(length), "gram long, tid long, place long, kind int")
    found = found.repartition(parts, "gram").mapInArrow(_repeated, "tid long, place long")
    places = found.groupBy("tid").agg(F.collect_list("place").alias("places")).join(texts, "tid").select(F.col("tid").alias("p_tid"), "some_id", "places")
    places = materialize(places, "places")
    wanted = C.sieve(places.select("p_tid"))
    held = docs.where(wanted(F.col("tid"))).join(places, (F.col("tid") == F.col("p_tid")) & F.col("doc_id").eqNullSafe(F.col("some_id"))).select("tid", "text", "places")
    held = materialize(held, "held")
    suffixes = held.mapInArrow(_suffixes(length), "way int, after binary, before binary, tid long, place long, end long")
    half = (length - GRAM) // 2
    fore, back = F.substring("after", 1, length - half), F.concat(F.substring("after", 1, GRAM), F.substring("before", 1, half + 1))
    spans = suffixes.repartitionByRange(2 * parts, "way", F.when(F.col("way") == 1, back).otherwise(fore)).mapInArrow(_classes(length), "tid long, start long, end long")
    spans = spans.groupBy("tid").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    cuts = held.select("tid", "text").join(spans, "tid").mapInArrow(_cut, "tid long, cuts array<struct<start:long,end:long>>, removed long, sha string")
    cuts = cuts.dropDuplicates(["tid"])
    out = rows.join(texts.select("tid", "copies"), "tid").join(cuts, "tid", "left")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return out.select(
        "doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))).otherwise(F.coalesce("cuts", none)).alias("spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("sha", "sha256")).alias("kept_sha256"),
    )
