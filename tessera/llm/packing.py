"""Best-fit packing of documents into token sequences after a dominance reduction.

Texts are tokenized where they are read. What has to be packed is then only a histogram: how many pieces there
are of each length, at most as many numbers as a sequence has tokens. The packer fixes dominating sets, packs the
remainder best-fit, and returns patterns (a list of lengths and how often it is used). Pieces find their place by
their rank among pieces of equal length, which is counted over range partitions, so no length is one task's work.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C
from tessera.llm.common import materialize

def reduce_dominated(counts: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Martello-Toth dominance on a histogram (``counts[l]`` pieces of length l, changed in place).

    Fixes sets that dominate every other set with their largest piece: a piece that nothing fits beside; a pair
    that fills a sequence; a pair with the largest partner that fits, where no two pieces fit together, or where no
    three do and no two that fit are together longer than that partner.
    """
    out = []
    for a in range(size, 0, -1):
        while counts[a]:
            room = size - a
            counts[a] -= 1  # the piece itself
            fits = np.flatnonzero(counts[1 : room + 1]) + 1
            if not len(fits):
                counts[a] += 1
                out.append(((a,), int(counts[a])))
                counts[a] = 0
                break
            b = int(fits[-1])
            small = np.repeat(fits[:3], np.minimum(counts[fits[:3]], 3))[:3]
            two = len(small) > 1 and small[0] + small[1] <= room
            three = len(small) > 2 and small.sum() <= room
            best = _best_pair(counts, fits, room) if two and not three and b != room else 0
            counts[a] += 1
            if b != room and two and (three or best > b):
                break
            n = int(counts[a]) // 2 if a == b else int(min(counts[a], counts[b]))
            out.append(((a, b), n))
            counts[a] -= n
            counts[b] -= n
    return out


def _best_pair(counts: np.ndarray, fits: np.ndarray, room: int) -> int:
    """The largest sum of two pieces that fit together."""
    best, high = 0, len(fits) - 1
    for low in range(len(fits)):
        while high >= 0 and fits[low] + fits[high] > room:
            high -= 1
        k = high if high != low or counts[fits[low]] > 1 else high - 1
        if k < low:
            break
        best = max(best, int(fits[low] + fits[k]))
    return best


def best_fit(counts: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest pieces first, each into the fullest open sequence it fits in; equal steps are taken together."""
    open_: dict[int, list[list]] = {}  # room left -> [pattern, how many]
    for a in range(size, 0, -1):
        n = int(counts[a])
        for room in sorted(r for r in open_ if r >= a):
            while n and open_[room]:  # a sequence stays the fullest that fits until no further piece does
                pattern, many = open_[room].pop()
                each = min(room // a, n)
                used = min(many, n // each)
                if used < many:
                    open_[room].append([pattern, many - used])
                open_.setdefault(room - each * a, []).append([pattern + (a,) * each, used])
                n -= used * each
            if not n:
                break
        if n:
            each = size // a
            if n >= each:
                open_.setdefault(size - each * a, []).append([(a,) * each, n // each])
            if n % each:
                open_.setdefault(size - (n % each) * a, []).append([(a,) * (n % each), 1])
    return [(p, m) for some in open_.values() for p, m in some]


def pack_histogram(counts: list[tuple[int, int]], size: int) -> list[tuple[tuple[int, ...], int]]:
    have = np.zeros(size + 1, dtype=np.int64)
    for length, n in counts:
        have[length] += n
    fixed = reduce_dominated(have, size)
    return fixed + best_fit(have, size)


#: Characters on which both tokenizer libraries agree: ASCII text and Latin letters.
_PLAIN = r"[\t\n\r -~À-ɏ]*"


class Tokens:
    """Ids of a text by the given tokenizer file; plain texts go through the same vocabulary's faster library."""

    def __init__(self, file: str, ranks: str | None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.slow, self.fast = Tokenizer.from_file(file), None
        self.plain = regex.compile(_PLAIN)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        if ranks:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast and self.plain.fullmatch(text) and not any(s in text for s in self.special):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


_loaded: dict[tuple, Tokens] = {}


def _pieces(files: tuple[str, str | None] | None, size: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.trim()
        where = files or default_files()
        tokens = _loaded.get(where) or _loaded.setdefault(where, Tokens(*where))
        C.trim()
        for batch in batches:
            text, ids_of = batch.column(batch.schema.get_field_index("text")), batch.column(0)
            source, piece, start, length, crc = [], [], [], [], []
            for i in range(batch.num_rows):
                ids = np.array([*tokens.ids(text[i].as_py() or ""), end_id], dtype="<u4")
                first = (len(ids) - 1) % size + 1
                at, k = 0, 0
                while at < len(ids):
                    n = first if k == 0 else size
                    source.append(i), piece.append(k), start.append(at), length.append(n), crc.append(zlib.crc32(ids[at : at + n].tobytes()))
                    at, k = at + n, k + 1
            yield pa.record_batch({
                "doc_id": ids_of.take(pa.array(source, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
            })
        batch = text = ids_of = None
        C.trim()

    return run


def pack_documents(docs: DataFrame, size: int = 1024, end_id: int = 2, files: tuple[str, str | None] | None = None) -> DataFrame:
    """(doc_id, text) -> (doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row.

    A row's ids are its text's (null: none) and ``end_id``; only longer ones are cut, into pieces of ``size`` ids
    of which the first holds the remainder. Sequences hold at most ``size`` ids, offsets are gapless. ``files``:
    tokenizer file and rank file of the same vocabulary (or None). A repeated row is packed as often as it stands
    there; a null doc_id is packed like any other. An empty table gives an empty table; other columns are ignored.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    pieces = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_pieces(files, size, end_id), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")
    pieces = materialize(pieces, "pieces")
    counts = [(r[0], r[1]) for r in pieces.groupBy("length").count().collect()]  # at most ``size`` rows
    many = dict(counts)
    # Each length's ranks are dealt to the patterns that use it: (first rank, pattern's first sequence, uses, offset).
    used, spans, sequence = dict.fromkeys(many, 0), [], 0
    for pattern, times in pack_histogram(counts, size):
        at = 0
        for length in pattern:
            spans.append((length, used[length], used[length] + times, sequence, at))
            used[length] += times
            at += length
        sequence += times
    if used != many:
        raise RuntimeError("the packer has not placed each piece once")
    table = spark.createDataFrame(spans or [(0, 0, 0, 0, 0)], "length long, low long, high long, first long, offset long")
    table = table.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("low", "high", "first", "offset"))).alias("spans"))
    ranked = C.running(pieces, F.lit(1), [F.xxhash64("doc_id", "piece"), "doc_id", "piece", "ids_crc32"], ["length"], "ranked").withColumnRenamed("before", "rank")
    placed = ranked.join(F.broadcast(table), "length").withColumn("place", _lookup(F.col("spans"), F.col("rank")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("place.first") + F.col("rank") - F.col("place.low")).alias("sequence_id"), F.col("place.offset").alias("offset"))


def _lookup(spans, rank):
    """The span that holds a rank: the spans of a length are few hundreds at most."""
    return F.element_at(F.filter(spans, lambda s: (s["low"] <= rank) & (rank < s["high"])), 1)
