"""N-gram Jaccard join by count vectors in R-trees.

A document is the set of its distinct word shingles. The shingles are hashed to GROUPS groups, and the counts of
the groups are the document's point. For two documents the overlap is at most the sum of the coordinate minima
of their points; a node of an R-tree is bounded in the same way by the upper corners of its boxes.

Hash-uniform points of documents of one size lie close together, so the boxes near the root of one tree over
all documents overlap and prune nothing. The upper levels are therefore replaced by an exact directory: with at
most k differing shingles and m > k blocks, a linked pair has a block of shingles in common as a whole. Each
directory entry (size band, block, sum of the hashes in it) leads to an R-tree over the points filed there (of
one leaf, where it holds at most FANOUT); entries with the same sets are one.

What the trees of the entries let through is only joined up: each entry gives a spanning forest of it. The parts
so connected are clusters, and no link leaves one. Each set is then sent once to its cluster's task, where an
R-tree over its points, of about half as many coordinates as a set has shingles, gives the pairs that are verified
on the shingle sets themselves. A task returns a spanning forest of verified links, and the number of each set's
links, so no table of pairs grows with the square of a cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common as C
from tessera.llm.common import U, discard, materialize
from tessera.llm.graph import components

#: Coordinates of a point in the directory; points in a leaf or children of a node.
GROUPS, FANOUT = 256, 16
#: Sets above which an entry is common; above which its sets are candidates of each other without a bound.
COMMON, TILE = 32, 1024
#: Shingles (and GROUPS for each set) that a side of a verification task holds; a larger cluster is dealt to several.
WEIGHT = 1 << 21
#: Sets of a component that meet the other components' when a cluster of several tasks is joined up (about).
ENVOYS = 16
#: Entries that a task looks at together for keys that many of them have; digests it remembers.
WINDOW, MEMORY = 1 << 18, 1 << 18
#: Shingles for each bucket of entries, about; a window's entries travel as one row of arrays for each bucket.
BUCKET = 1 << 20
#: Different sets with one 64-bit digest that are told apart, at most (at 10^10 sets about three are expected).
CLASHES = 10_000


class Limits:
    """Sizes are put into bands. ``blocks[b]`` is the number of blocks for pairs whose larger set is in band b."""

    def __init__(self, num: int, den: int):
        ratio = max(1.5, den / num)
        edges = [1]
        while edges[-1] < 1 << 40:
            edges.append(max(edges[-1] + 1, int(edges[-1] * ratio)))
        self.num, self.den, self.edges = num, den, np.array(edges, dtype=np.int64)
        most = 2 * (self.edges[1:] - 1) * (den - num) // (den + num)  # differing shingles of a linked pair
        self.slack = np.where(most > 0, 1 + most // 8, 0)
        self.blocks = np.where(most > 0, most + 1 + self.slack, 0)

    def bands(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The band of each size, and the band of the largest partner."""
        n = np.maximum(n, 1)
        return np.searchsorted(self.edges, n, "right") - 1, np.searchsorted(self.edges, n * self.den // self.num, "right") - 1

    def need(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The smallest overlap of linked sets: den * I >= num * (a + b - I)."""
        return -((-self.num * (a + b)) // (self.num + self.den))


def _digests(row: np.ndarray, value: np.ndarray, rows: int, bits: int, odd: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, digests of ``bits`` bits and 64 more bits of each set. ``odd``: other digests for some (digest, more bits)."""
    n = np.bincount(row, minlength=rows)
    digest = C.signed(C.mix(C.sums_by(row, C.mix(value, 1), rows) + n.astype(np.uint64), 2) >> U(64 - bits))
    check = C.signed(C.mix(C.sums_by(row, C.mix(value, 11), rows) + n.astype(np.uint64), 12))
    if odd:
        digest = np.array([odd.get(k, k[0]) for k in zip(digest.tolist(), check.tolist(), strict=True)], dtype=np.int64)
    return n, digest, check


def _points(words: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in C.text_blocks(batches):
            rows = part.num_rows
            row, value = C.shingle_sets(data, offsets, words)
            n, digest, check = _digests(row, value, rows, bits, {})
            yield pa.record_batch({
                "doc_id": part.column("doc_id"), "n": pa.array(n, pa.int64()), "digest": pa.array(digest, pa.int64(), mask=n == 0), "more": pa.array(check, pa.int64()),
                "text_hash": part.column("text_hash"), "point": _binary(count_vectors(row, value, np.full(rows, GROUPS)), np.full(rows, GROUPS)),
            })

    return run


def count_vectors(row: np.ndarray, value: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Counts of each row's hashed groups (powers of 2), one row after the other."""
    base = np.cumsum(groups) - groups
    at = base[row] + (C.mix(value, 3) & (groups[row] - 1).astype(np.uint64)).astype(np.int64)
    return _bytes(np.bincount(at, minlength=int(groups.sum())))


def fine_groups(n: int, sets: int) -> int:
    """Coordinates of the points of so many sets of up to ``n`` shingles: a power of 2, about half of that, and few for many sets."""
    return 1 << int(np.clip(np.ceil(np.log2(max(n, 1) / 2)), 8, max(8, 21 - int(sets).bit_length())))


def _bytes(counts: np.ndarray) -> np.ndarray:
    """Counts over 255 are kept as 255; what a set has beyond is its size less the sum of its coordinates."""
    return np.minimum(counts, 255).astype(np.uint8)


def _binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    at = np.concatenate([[0], np.cumsum(counts * values.itemsize)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))])


def _buckets(parts: int, shingles: int) -> int:
    """Buckets that bound what a task holds at once: as many for each partition, and no more than the shingles need.

    Rows of entries are at most windows x buckets (and entries), so buckets that held few entries would give a row to
    nearly each entry.
    """
    return parts * max(1, -(-shingles // (BUCKET * parts)))


def _entries(words: int, num: int, den: int, bits: int, odd: dict, buckets: int):
    """Directory entries of each distinct set that a task sees: arrays (key, salt, digest, spare) for each bucket.

    A linked pair has more equal blocks than the slack. So a set need not be filed under its empty or common
    blocks while they are no more than that; ``spare``: how many common ones it may leave out (times 2, plus 1 in
    the band of its larger partners; negative: none). Of a key that more than COMMON sets of a window have, those
    beyond are dealt out by a salt (over 0), so a hot key does not meet in one task.
    """

    def dealt(rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, digest, spare = (np.concatenate(x) for x in zip(*rows, strict=True))
        order = np.argsort(key, kind="stable")
        key, digest, spare = key[order], digest[order], spare[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        rank = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
        salt = np.where(rank > COMMON, 1 + digest % 64, 0).astype(np.int32)
        bucket = (C.mix(key.view(np.uint64) + salt.astype(np.uint64), 7) % U(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        many = np.bincount(bucket, minlength=buckets)
        used = np.flatnonzero(many)
        lists = ((key, pa.int64()), (salt, pa.int32()), (digest, pa.int64()), (spare, pa.int32()))
        return pa.record_batch([pa.array(used, pa.int32()), *(C.list_column(x[order], many[used], kind) for x, kind in lists)], ["bucket", "key", "salt", "digest", "spare"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits, seen = Limits(num, den), set()
        held, size = [], 0
        for part, data, offsets in C.text_blocks(batches):
            rows = part.num_rows
            row, value = C.shingle_sets(data, offsets, words)
            n, digest, _ = _digests(row, value, rows, bits, odd)
            fresh = np.zeros(rows, dtype=bool)
            if len(seen) > MEMORY:  # a set seen again later is filed again, which changes nothing
                seen.clear()
            for i, d in enumerate(digest.tolist()):
                if n[i] and d not in seen:
                    seen.add(d)
                    fresh[i] = True
            own, far = limits.bands(n)
            for more in (0, 1):
                band = own + more
                blocks = np.where(fresh & ((more == 0) | (far > own)), limits.blocks[band], 0)
                use = blocks[row] > 0
                if not use.any():
                    continue
                base = np.cumsum(blocks) - blocks
                total = int(blocks.sum())
                r, v = row[use], value[use]
                at = base[r] + (C.mix(v, 5) % blocks[r].astype(np.uint64)).astype(np.int64)
                filled = np.bincount(at, minlength=total)
                owner = np.repeat(np.arange(rows), blocks)
                key = C.mix(C.sums_by(at, C.mix(v, 6), total) + (np.arange(total) - base[owner]).astype(np.uint64) * U(0xC2B2AE3D27D4EB4F) + band[owner].astype(np.uint64) * U(0x165667B19E3779F9))
                hollow = np.bincount(owner, weights=filled == 0, minlength=rows)
                emit = (filled > 0) | (hollow > limits.slack[band])[owner]  # an empty block counts only where many are empty
                spare = np.clip(limits.slack[band] - hollow, -1, 1 << 20).astype(np.int32) * 2 + more
                held.append((C.signed(key[emit]), digest[owner[emit]], spare[owner[emit]]))
                size += int(emit.sum())
                if size >= WINDOW:
                    yield dealt(held)
                    held, size = [], 0
        if size:
            yield dealt(held)

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of entries by bucket: those that hold two sets or more.

    An entry's key then is the hash of its sets, so that entries with the same sets are one (``times``: of how many,
    ``often``: of how many sets); a common entry's, which may be in several buckets, stays its own.
    """
    for rows, _ in C.whole_groups(batches, ["bucket"]):
        key, salt, digest, spare = (np.concatenate([np.asarray(x.flatten()) for x in rows.column(c).chunks]) for c in ("key", "salt", "digest", "spare"))
        place = key + salt  # most entries hold one set, and go before the rest is put in order
        order = np.argsort(place)
        same = np.concatenate([[False], place[order][1:] == place[order][:-1], [False]])
        some = order[same[1:] | same[:-1]]
        some = some[np.lexsort((digest[some], salt[some], key[some]))]
        if not len(some):
            continue
        key, salt, digest, spare = key[some], salt[some], digest[some], spare[some]
        cut = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (salt[1:] != salt[:-1])) + 1, [len(key)]])
        once = np.concatenate([[True], digest[1:] != digest[:-1]])
        once[cut[:-1]] = True
        entry = np.repeat(np.arange(len(cut) - 1), np.diff(cut))[once]
        key, salt, digest, spare = key[once], salt[once], digest[once], spare[once]
        count = np.bincount(entry)
        common = (count > COMMON) | (salt[np.cumsum(count) - count] > 0)
        alike = C.signed(C.mix(C.sums_by(entry, C.mix(digest.view(np.uint64) * U(2) + (spare & 1).astype(np.uint64), 21), len(count)) + count.astype(np.uint64)))
        few = np.flatnonzero(~common & (count > 1))
        _, first, many = np.unique(alike[few], return_index=True, return_counts=True)
        times = common.astype(np.int32)
        times[few[first]] = many
        keep = (times > 0)[entry]
        yield pa.record_batch({
            "key": pa.array(np.where(common[entry], key, alike[entry])[keep]), "digest": pa.array(digest[keep]), "spare": pa.array(spare[keep]),
            "common": pa.array(common[entry][keep]), "times": pa.array(times[entry][keep]), "often": pa.array(count[entry][keep]),
        })


class RTree:
    """A bulk-loaded R-tree over count vectors: sort-tile order, FANOUT children a node, upper corners and least sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        n = len(points)
        order = np.argsort(sizes, kind="stable")
        spread = points.var(axis=0)
        axes = np.argsort(-spread, kind="stable")[:2]
        slab = max(FANOUT, int(np.ceil(np.sqrt(n / FANOUT))) * FANOUT)
        for depth, axis in enumerate(axes):
            step = max(FANOUT, slab // FANOUT**depth)
            order = np.concatenate([run[np.argsort(points[run, axis], kind="stable")] for run in (order[i : i + step] for i in range(0, n, step))])
        self.order = order
        self.levels = [(points[order], sizes[order], (sizes - points.sum(axis=1, dtype=np.int64))[order])]
        while len(self.levels[-1][0]) > FANOUT:
            top, low, beyond = self.levels[-1]
            cut = np.arange(0, len(top), FANOUT)
            self.levels.append((np.maximum.reduceat(top, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(beyond, cut)))

    def join(self, limits: Limits) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of pairs of points whose summed minima reach the overlap that a link needs, depth first."""
        leaf = max(64, (1 << 21) // self.levels[0][0].shape[1])
        i, j = np.divmod(np.arange(FANOUT * FANOUT), FANOUT)
        rest = [(len(self.levels) - 1, *np.triu_indices(len(self.levels[-1][0])))]
        while rest:
            depth, a, b = rest.pop()
            chunk = leaf if depth == 0 else min(leaf, 1024)  # a pair of nodes has FANOUT * FANOUT pairs of children
            if len(a) > chunk:
                rest.append((depth, a[chunk:], b[chunk:]))
                a, b = a[:chunk], b[:chunk]
            keep = reaches(limits, *self.levels[depth], a, b)
            a, b = a[keep], b[keep]
            if depth == 0:
                apart = a < b
                yield self.order[a[apart]], self.order[b[apart]]
                continue
            width = len(self.levels[depth - 1][0])
            x, y = (a[:, None] * FANOUT + i).ravel(), (b[:, None] * FANOUT + j).ravel()
            inside = (x <= y) & (x < width) & (y < width)
            rest.append((depth - 1, x[inside], y[inside]))


def reaches(limits: Limits, top: np.ndarray, low: np.ndarray, beyond: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the summed coordinate minima of pairs reach the overlap that sets of these sizes need."""
    return row_sums(np.minimum(top[x], top[y])) + np.minimum(beyond[x], beyond[y]) >= limits.need(low[x], low[y])


def row_sums(rows: np.ndarray) -> np.ndarray:
    """Sums of the rows of a table of bytes; 256 bytes are added in four lanes of 16 bits (65280 at most in all)."""
    if rows.shape[1] % GROUPS:
        return rows.sum(axis=1, dtype=np.int64)
    lanes = np.ascontiguousarray(rows).view(np.uint64)
    low = U(0x00FF00FF00FF00FF)
    lanes = ((lanes & low) + ((lanes >> U(8)) & low)).reshape(len(rows), -1, GROUPS // 8).sum(axis=2)
    return ((lanes * U(0x0001000100010001)) >> U(48)).sum(axis=1).astype(np.int64)


def leaf_pairs(cut: np.ndarray, limits: Limits, top: np.ndarray, low: np.ndarray, beyond: np.ndarray, chunk: int = 1 << 13) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As ``RTree.join``, for groups (``cut``: where they begin, and the end) of one leaf; those of one width together."""
    width = np.diff(cut)
    for g in np.unique(width[(width > 1) & (width <= FANOUT)]).tolist():
        first = cut[:-1][width == g]
        i, j = np.triu_indices(g, 1)
        x, y = (first[:, None] + i).ravel(), (first[:, None] + j).ravel()
        for k in range(0, len(x), chunk):
            p, q = x[k : k + chunk], y[k : k + chunk]
            ok = reaches(limits, top, low, beyond, p, q)
            yield p[ok], q[ok]


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Numbers of links that span what all the links connect: rounds in which each part hooks to a smaller one."""
    label, chosen = np.arange(n), []
    rest = np.arange(len(a))
    while len(rest):
        x, y = label[a[rest]], label[b[rest]]
        rest, x, y = rest[x != y], x[x != y], y[x != y]
        if not len(rest):
            break
        large, first = np.unique(np.maximum(x, y), return_index=True)
        chosen.append(rest[first])
        up = np.arange(n)
        up[large] = np.minimum(x, y)[first]
        while (up != up[up]).any():
            up = up[up]
        label = up[label]
    return np.concatenate(chosen) if chosen else np.zeros(0, dtype=np.int64)


def _candidates(num: int, den: int):
    """Of entries sorted by key: a forest of the pairs that each one's tree lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits = Limits(num, den)
        for rows, cut in C.whole_groups(batches, ["key"]):
            digest, size = (np.asarray(rows.column(c).combine_chunks()) for c in ("digest", "n"))
            raw = rows.column("point").combine_chunks()
            points = np.frombuffer(raw.buffers()[2], dtype=np.uint8)
            points = points[int(np.frombuffer(raw.buffers()[1], dtype=np.int32)[raw.offset]) :][: len(raw) * GROUPS].reshape(-1, GROUPS)
            beyond, width = size - points.sum(axis=1, dtype=np.int64), np.diff(cut)
            found = list(leaf_pairs(cut, limits, points, size, beyond))
            for start, end in zip(cut[:-1][width > FANOUT].tolist(), cut[1:][width > FANOUT].tolist(), strict=True):
                x, y = (np.concatenate(c) for c in zip(*RTree(points[start:end], size[start:end]).join(limits), strict=True))
                some = _forest(x, y, end - start)
                found.append((x[some] + start, y[some] + start))
            a, b = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
            low, high = np.minimum(digest[a], digest[b]), np.maximum(digest[a], digest[b])
            order = np.lexsort((high, low))  # by smallest digest first, so entries with much the same sets choose the same
            order = order[_forest(a[order], b[order], len(digest))] if len(a) else order
            both = np.unique(np.stack([low[order], high[order]]), axis=1)
            yield pa.record_batch({"u": pa.array(both[0]), "v": pa.array(both[1])})

    return run


def _sets(words: int, bits: int, odd: dict):
    """(digest, items): the shingle sets of the rows that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in C.text_blocks(batches):
            row, value = C.shingle_sets(data, offsets, words)
            n, digest, _ = _digests(row, value, part.num_rows, bits, odd)
            yield pa.record_batch({"digest": pa.array(digest[n > 0]), "items": C.list_column(C.signed(value), n[n > 0], pa.int64())})

    return run


class Tile:
    """Sets of some verification tasks, and which links hold among them."""

    def __init__(self, rows: pa.Table, cut: np.ndarray, limits: Limits):
        self.limits, self.cut = limits, cut
        self.digest, self.side, self.times, label = (np.asarray(rows.column(c).combine_chunks()) for c in ("digest", "side", "times", "label"))
        items = rows.column("items").combine_chunks()
        value = np.asarray(items.flatten())
        self.size = np.asarray(items.value_lengths()).astype(np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.value = value.view(np.uint64)
        terms, self.term = np.unique(value, return_inverse=True)
        self.mark = np.zeros(len(terms), dtype=bool)
        self.label = np.unique(label, return_inverse=True)[1]

    def points(self, start: int, end: int, groups: int) -> np.ndarray:
        row = np.repeat(np.arange(end - start), self.size[start:end])
        first = self.start[start]
        return count_vectors(row, self.value[first : first + len(row)], np.full(end - start, groups)).reshape(-1, groups)

    def survivors(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs that the bound lets through, inside each task."""
        width = np.diff(self.cut)
        for start, end in zip(self.cut[:-1][width > FANOUT].tolist(), self.cut[1:][width > FANOUT].tolist(), strict=True):
            for x, y in RTree(self.points(start, end, fine_groups(int(self.size[start:end].max()), end - start)), self.size[start:end]).join(self.limits):
                yield x + start, y + start
        small = np.flatnonzero(width <= FANOUT)
        for k in range(0, len(small), 1024):  # tasks of one leaf
            some = small[k : k + 1024]
            rows = np.concatenate([np.arange(self.cut[t], self.cut[t + 1]) for t in some])
            sizes = self.size[rows]
            row = np.repeat(np.arange(len(rows)), sizes)
            points = count_vectors(row, self.value[_ranges(self.start[rows], sizes)], np.full(len(rows), GROUPS)).reshape(-1, GROUPS)
            for x, y in leaf_pairs(np.concatenate([[0], np.cumsum(width[some])]), self.limits, points, sizes, sizes - points.sum(axis=1, dtype=np.int64)):
                yield rows[x], rows[y]

    def linked(self, counted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A forest of links (two arrays), and how many rows each set is linked with, if ``counted``.

        Sets of opposite sides are compared (3: both sides). Unless links are counted, sets of one label are not
        compared, and linked ones get one label at once.
        """
        many, us, vs = np.zeros(len(self.digest), dtype=np.int64), [], []
        for x, y in self.survivors():
            ok = (self.digest[x] != self.digest[y]) & ((self.side[x] | self.side[y]) == 3)
            x, y = x[ok], y[ok]
            order = np.argsort(x, kind="stable")
            x, y = x[order], y[order]
            if not len(x):
                continue
            first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
            for lo, hi in zip(first.tolist(), np.append(first[1:], len(x)).tolist(), strict=True):
                a, b = int(x[lo]), y[lo:hi]
                if not counted:
                    b = b[self.label[b] != self.label[a]]
                if not len(b):
                    continue
                own = self.term[self.start[a] : self.start[a] + self.size[a]]
                self.mark[own] = True
                sizes = self.size[b]
                both = np.add.reduceat(self.mark[self.term[_ranges(self.start[b], sizes)]], np.cumsum(sizes) - sizes, dtype=np.int64)
                self.mark[own] = False
                b = b[both >= self.limits.need(self.size[a], sizes)]
                if counted and len(b):
                    many[a] += self.times[b].sum()
                    np.add.at(many, b, self.times[a])
                for c in b.tolist():
                    if self.label[c] != self.label[a]:
                        self.label[self.label == self.label[c]] = self.label[a]
                        us.append(a)
                        vs.append(c)
        return np.array(us, dtype=np.int64), np.array(vs, dtype=np.int64), many


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... (size of them) of each, one after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _bounded(groups: Iterator[tuple[pa.Table, np.ndarray]]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The same groups in tables of about WEIGHT shingles at most, or of one group."""
    for rows, cut in groups:
        upto = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(rows.column("items")).combine_chunks()).astype(np.int64))])[cut]
        k = 0
        while k < len(cut) - 1:
            end = max(k + 1, int(np.searchsorted(upto, upto[k] + WEIGHT, "right")) - 1)
            yield rows.slice(int(cut[k]), int(cut[end] - cut[k])), cut[k : end + 1] - cut[k]
            k = end


def _verified(num: int, den: int, counted: bool):
    """Of tasks sorted by (cluster, i, j): verified links (u, v, null), and (u, null, number of links) of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits = Limits(num, den)
        for rows, cut in _bounded(C.whole_groups(batches, ["cluster", "i", "j"])):
            tile = Tile(rows, cut, limits)
            u, v, many = tile.linked(counted)
            told = np.flatnonzero(many)
            yield pa.record_batch({
                "u": pa.array(np.concatenate([tile.digest[u], tile.digest[told]])), "v": pa.array(np.concatenate([tile.digest[v], np.zeros(len(told), np.int64)]), mask=np.arange(len(u) + len(told)) >= len(u)),
                "links": pa.array(np.concatenate([np.zeros(len(u), np.int64), many[told]])),
            })

    return run


def _dealt(plan: DataFrame, num: int, den: int, counted: bool, items: DataFrame | None = None) -> DataFrame:
    """Verify tasks: rows (cluster, i, j, side, digest, label, times), with items or with those of a table (digest, items)."""
    parts = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = plan if items is None else plan.join(items.select("digest", "items"), "digest")
    rows = rows.select("cluster", "i", "j", "side", "digest", "label", "times", "items").repartition(parts, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    return materialize(rows.mapInArrow(_verified(num, den, counted), "u long, v long, links long"), "verified")


def _tile(tiles: Column, salt: int) -> Column:
    return F.pmod(F.xxhash64("digest", F.lit(salt)), tiles).cast("int")


def _tiled(rows: DataFrame, weight: int, name: str, salt: int = 0) -> DataFrame:
    """Rows (cluster, digest, n) with the number of tiles of their cluster, and their tile in ``name``."""
    tiles = rows.groupBy(F.col("cluster").alias("c")).agg(F.ceil(F.sum(F.col("n") + GROUPS) / F.lit(weight)).cast("int").alias("tiles"))
    return rows.drop("tiles").join(tiles, F.col("cluster") == F.col("c")).drop("c").withColumn(name, _tile(F.col("tiles"), salt))


def _links(sets: DataFrame, num: int, den: int, counted: bool, weight: int) -> tuple[DataFrame, DataFrame]:
    """(cluster, tiles, tile, digest, times, n, items) -> a spanning forest (u, v) of the links, and (u, links) if ``counted``.

    A cluster of at most ``weight`` is one task. Larger ones are dealt to tiles. To count links each pair of tiles
    is a task, as every pair of sets has to be compared. Else the tiles are joined up first: some sets of
    each component meet, as long as that links many; then only sets outside their cluster's largest component are
    compared with all. Rounds are planned without the sets' items, which join the plan in the end.
    """
    here = sets.withColumns({"label": F.col("digest"), "i": F.col("tile"), "j": F.col("tile"), "side": F.lit(3)})
    if counted:
        across = here.where("tiles > 1").withColumn("o", F.explode(F.filter(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: o != F.col("tile"))))
        across = across.withColumns({"i": F.least("tile", "o"), "j": F.greatest("tile", "o"), "side": F.when(F.col("tile") < F.col("o"), 1).otherwise(2)})
        found = _dealt(here.unionByName(across.drop("o")), num, den, True)
        return found.where("v is not null").select("u", "v"), found.where("v is null").groupBy("u").agg(F.sum("links").alias("links"))
    found = _dealt(here, num, den, False).select("u", "v")
    items = sets.where("tiles > 1")
    large = items.select("cluster", "tiles", "digest", "times", "n")
    if large.isEmpty():
        return found, found.limit(0)
    for salt in range(1, 100):
        labels = components(found)
        now = large.join(labels, F.col("digest") == F.col("node"), "left").withColumn("label", F.coalesce("label", "digest")).drop("node")
        sizes = materialize(now.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("many")), "sizes")
        apart = sizes.groupBy("cluster").agg(F.count(F.lit(1)).alias("labels"), F.max(F.struct("many", "label"))["label"].alias("main")).where("labels > 1")
        now = materialize(now.join(apart, "cluster").join(sizes, ["cluster", "label"]), "now")
        some = now.where(F.pmod(F.xxhash64("digest", F.lit(-salt)), F.greatest(F.lit(1), F.floor(F.col("many") / ENVOYS))) == 0)
        some = _tiled(some, weight, "i", salt).withColumns({"j": F.col("i"), "side": F.lit(3)})
        more = _dealt(some, num, den, False, items).select("u", "v")
        found = found.unionByName(more)
        if 10 * more.count() < sizes.count():  # few are left that envoys can join
            break
    minor = now.where("label <> main")
    left = _tiled(minor, weight, "i").drop("tiles")
    lefts = left.groupBy("cluster").agg((F.max("i") + 1).alias("lefts"))
    left = left.join(now.select("cluster", "tiles").distinct(), "cluster").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn("side", F.lit(1)).drop("tiles")
    right = now.join(lefts, "cluster").withColumn("j", _tile(F.col("tiles"), 0)).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1))).withColumn("side", F.lit(2)).drop("lefts", "tiles")
    return found.unionByName(_dealt(left.unionByName(right), num, den, False, items).select("u", "v")), found.limit(0)


def _apart(sets: DataFrame, num: int, den: int, weight: int) -> DataFrame:
    """Sets (cluster, tiles, tile, digest, times, n, items) with clusters of several tasks taken apart by their rarest shingles.

    A set with n shingles has num / den of them at least in common with a linked one. So, in one order of all
    shingles, by how many sets have them, the first of the shingles that two linked sets share is among the first
    n - num / den * n + 1 of either. Sets that share such a shingle stay together; those that share none with any other
    have no link and go. What entries of over TILE sets joined without a bound is not compared all with all then.
    """
    large = sets.where("tiles > 1")
    if large.isEmpty():
        return sets
    items = large.select("digest", "n", F.explode("items").alias("item"))
    often = materialize(items.groupBy("item").agg(F.count(F.lit(1)).alias("often")).where("often > 1"), "often")
    own = Window.partitionBy("digest")
    rare = items.join(often, "item").withColumn("place", F.row_number().over(own.orderBy("often", "item")) + F.col("n") - F.count(F.lit(1)).over(own))
    rare = materialize(rare.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * num / den) + 1).select("item", "digest"), "rare")
    least = materialize(rare.groupBy("item").agg(F.min("digest").alias("least"), F.count(F.lit(1)).alias("sets")).where("sets > 1").drop("sets"), "least")
    labels = components(rare.join(least, "item").select(F.col("least").alias("u"), F.col("digest").alias("v")))
    discard(often, rare, least)
    clusters = labels.select(F.col("node").alias("digest"), F.col("label").alias("cluster")).join(large.select("digest", "n"), "digest")
    clusters = _tiled(clusters, weight, "tile").select("digest", "cluster", "tiles", "tile")
    parted = large.drop("cluster", "tiles", "tile").join(clusters, "digest").select(*sets.columns)
    parted = materialize(sets.where("tiles = 1").unionByName(parted), "parted")
    discard(sets)
    return parted


def _rarest(entries: DataFrame) -> DataFrame:
    """Of entries (key, digest, band, spare, common, times, often): those that a set has to stay filed under.

    In one order of all entries, by how many sets they hold, each set leaves the last ones, as many as it may. A linked
    pair has more in common than either may leave, so the first that it has in common is left by neither. An entry
    that stands for several (``times``) is left as a whole or not.
    """
    common = entries.where("common").drop("often")
    often = common.groupBy("key").agg(F.count(F.lit(1)).alias("often"))
    placed = entries.where("not common").unionByName(common.join(often, "key"))
    later = Window.partitionBy("digest", "band").orderBy(F.desc("often"), F.desc("key")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.withColumn("later", F.sum("times").over(later)).where(F.col("later") > F.shiftright("spare", 1))


def ngram_join(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5, digest_bits: int = 64, weight: int = WEIGHT) -> DataFrame:
    """Link documents whose shingle sets have a Jaccard similarity of at least num / den.

    Returns (doc_id, n_shingles, component_id, n_links) for every row of ``docs`` (doc_id, text): the size of its set
    of distinct shingles of ``words`` words (A-Z lower-cased), the smallest doc_id that links lead to, itself
    included, and the number of other rows that it is linked with. A text with fewer words is one shingle; a null
    text or one without words has an empty set, is linked with nothing and is its own component. Repeated rows have
    equal sets and are linked; a null doc_id stays null unless links lead to one that is not. An empty table gives an
    empty table; other columns are ignored.

    Equal sets are one node. Sets go by ``digest_bits`` bits of a digest; those that share them are told apart by 64
    more. ``weight``: see WEIGHT.
    """
    return _joined(docs, words, num, den, True, digest_bits, weight).select("doc_id", "n_shingles", "component_id", "n_links")


def _joined(docs: DataFrame, words: int, num: int, den: int, counted: bool, bits: int = 64, weight: int = WEIGHT) -> DataFrame:
    """The rows of ``ngram_join`` with text_hash, and label: the component's node, null for an empty set."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    points = docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_points(words, bits), f"doc_id {kind}, n long, digest long, more long, text_hash long, point binary")
    points = materialize(points, "points")
    firsts = points.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.count(F.lit(1)).alias("times"), F.min("more").alias("more"), F.max("more").alias("most"))
    firsts = materialize(firsts, "firsts")
    shingles = firsts.agg(F.sum(F.col("n") * F.col("times"))).first()[0] or 0
    odd = _clashes(points, firsts)
    if odd:
        table = F.broadcast(spark.createDataFrame([(*k, v) for k, v in odd.items()], "c long, m long, other long"))
        points = points.join(table, (F.col("digest") == F.col("c")) & (F.col("more") == F.col("m")), "left").withColumn("digest", F.coalesce("other", "digest")).drop("c", "m", "other")
        firsts = points.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.count(F.lit(1)).alias("times"))
    entries = docs.select("text").mapInArrow(_entries(words, num, den, bits, odd, _buckets(parts, shingles)), "bucket int, key array<long>, salt array<int>, digest array<long>, spare array<int>")
    entries = entries.repartitionById(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_shared, "key long, digest long, spare int, common boolean, times int, often long")
    entries = materialize(entries.withColumn("band", F.col("spare").bitwiseAND(1)), "entries")
    # A linked pair has more equal blocks than the slack, so a set with fewer shared entries has no link in that band.
    able = entries.groupBy("digest", "band").agg(F.sum("times").alias("shared"), F.min("spare").alias("least")).where(F.col("shared") > F.shiftright("least", 1))
    every, entries = entries, materialize(entries.join(able.select("digest", "band"), ["digest", "band"], "left_semi"), "able")
    discard(every)
    stored = materialize(_rarest(entries).select("key", "digest", "common").distinct(), "filed")
    crowds = materialize(stored.where("common").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("digest").alias("least")).where(F.col("n") > TILE), "crowds")
    common, filed = stored.where("common").select("key", "digest"), stored.select("key", "digest").join(crowds, "key", "left_anti")
    known = points.where("digest is not null").groupBy("digest").agg(F.min("n").alias("n"), F.min("point").alias("point"))
    known = known.join(filed.select("digest").distinct(), "digest", "left_semi")
    rows = filed.join(known, "digest").select("key", "digest", "n", "point").repartition(parts, "key").sortWithinPartitions("key")
    pairs = rows.mapInArrow(_candidates(num, den), "u long, v long")
    pairs = materialize(pairs.unionByName(common.join(crowds, "key").select(F.col("least").alias("u"), F.col("digest").alias("v"))).distinct(), "pairs")
    clusters = components(pairs)
    discard(entries, crowds, stored, pairs)
    wanted = clusters.join(firsts.select("digest", "doc_id", "times", "n"), F.col("node") == F.col("digest")).select(F.col("label").alias("cluster"), "digest", "times", "doc_id", "n")
    wanted = materialize(_tiled(wanted, weight, "tile"), "wanted")
    near = C.sieve(wanted.select(F.xxhash64("doc_id")))
    sets = docs.where(near(F.xxhash64("doc_id"))).mapInArrow(_sets(words, bits, odd), "digest long, items array<long>")
    sets = sets.join(wanted.drop("doc_id"), "digest").dropDuplicates(["digest"])
    sets = _apart(materialize(sets, "sets"), num, den, weight)
    forest, many = _links(sets, num, den, counted, weight)
    labels = components(forest)
    nodes = firsts.select("digest", "doc_id", "times").join(labels, F.col("digest") == F.col("node"), "left").withColumn("label", F.coalesce("label", "digest"))
    least = nodes.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    nodes = nodes.join(least, "label").join(many.withColumnRenamed("u", "linked"), F.col("digest") == F.col("linked"), "left") if counted else nodes.join(least, "label").withColumn("links", F.lit(0))
    nodes = nodes.select(F.col("digest").alias("node"), "label", "component_id", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).cast("long").alias("n_links"))
    # Written, so that the join below has two exchanges and the rows of a hot set can be split.
    nodes = materialize(nodes, "nodes")
    rows = points.select("doc_id", "n", "digest", "text_hash").join(nodes, F.col("digest") == F.col("node"), "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "text_hash", "label", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _clashes(points: DataFrame, firsts: DataFrame) -> dict[tuple[int, int], int]:
    """Of digests that several sets have: (digest, more bits) of each but one -> a digest of its own."""
    shared = firsts.where("more <> most").select(F.col("digest").alias("d"), F.col("more").alias("least"))
    if shared.isEmpty():
        return {}
    rows = points.join(shared, F.col("digest") == F.col("d")).where("more <> least").select("digest", "more").distinct().limit(CLASHES + 1).collect()
    if len(rows) > CLASHES:
        raise ValueError(f"over {CLASHES} sets share a digest: take more digest_bits")
    return {(r["digest"], r["more"]): int(C.signed(C.mix(np.array([r["digest"], r["more"]], dtype=np.int64).view(np.uint64), 31).sum(keepdims=True))[0]) for r in rows}


def drop_near_copies(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One row of each component stays, the one whose doc_id names it; rows without words all stay.

    Of a component's rows with that doc_id one stays, also where another component has rows of the same doc_id. Rows
    whose doc_id is null stay where it names their component (they cannot be told apart). Texts go by a 64-bit hash.
    All columns are kept, whatever their names. Only rows that a sieve takes for doubtful cross an exchange.
    """
    found = materialize(_joined(docs, words, num, den, False), "found")
    one = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    named = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).withColumn("one", one)
    named = named.groupBy(F.col("doc_id").alias("keep_id"), "one", F.when(F.col("one"), F.col("label")).otherwise(F.col("text_hash")).alias("part"))
    keep = materialize(named.agg(F.min("text_hash").alias("keep_hash"), F.count(F.lit(1)).alias("copies"), F.min("one").alias("single")).drop("part", "one"), "keep")
    place = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_hash")
    sure = keep.where(~F.col("single") | (F.col("copies") == 1)).select("keep_id", "keep_hash")
    lost = found.join(sure, F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("text_hash") == F.col("keep_hash")), "left_anti")
    doubtful = C.sieve(lost.select(place))
    rows = docs.select(C.packed(docs).alias("row"), F.col("doc_id").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    clear = rows.where(~doubtful(place)).select(*C.unpacked("row", docs.columns))
    rest = rows.where(doubtful(place)).join(keep, F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("text_hash") == F.col("keep_hash")))
    twice = F.col("single") & (F.col("copies") > 1)
    alone = rest.where(twice).dropDuplicates(["keep_id", "keep_hash"])
    return clear.unionByName(rest.where(~twice).unionByName(alone).select(*C.unpacked("row", docs.columns)))
