"""Shared plumbing of the training-data operators: shared-storage cuts, Arrow text kernels, hashing.

Text kernels work on the UTF-8 buffer of an Arrow column as one NumPy array, so that no Python object is made
for a word. ``text_blocks`` bounds what a kernel sees at once, whatever the Arrow batch size is.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text and rows that a kernel handles at once (a longer text is handled alone).
BLOCK_BYTES, BLOCK_ROWS = 1 << 19, 2048
U = np.uint64


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    It may be unset only where driver and executors are one process (a local master); a folder is then set here.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        import tempfile

        found = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` as a table in the shared folder and read it back (survives lost executors)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once nothing reads them any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def packed(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, so that names used on the way cannot clash; ``unpacked`` gives them back."""
    return F.struct(*(df[_quoted(c)].alias(c) for c in df.columns))


def unpacked(column: str, names: list[str]) -> list[Column]:
    return [F.col(column).getField(c).alias(c) for c in names]


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


#: Bits of a sieve: its table has SIEVE / 64 numbers, half a megabyte, however many rows it is made of.
SIEVE = 1 << 22


def sieve(hashes: DataFrame) -> Callable[[Column], Column]:
    """A test for 64-bit hashes: true for all in the first column of ``hashes``, and by chance for some others.

    It keeps rows that a join would drop anyway out of the join's exchange. The more hashes, the more pass; the
    join after it decides, so results never depend on it.
    """
    spark, h = hashes.sparkSession, F.pmod(F.col(hashes.columns[0]), F.lit(SIEVE)).cast("int")
    bits = hashes.select(F.shiftright(h, 6).alias("word"), F.expr("1L").alias("one"), h.bitwiseAND(63).alias("bit"))
    found = bits.groupBy("word").agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("bits")).collect()  # SIEVE / 64 rows at most
    table = [0] * (SIEVE // 64)
    for r in found:
        table[r["word"]] = r["bits"]
    whole = spark.createDataFrame([(table,)], "bits array<long>").scalar()

    def passes(column: Column) -> Column:
        at = F.pmod(column, F.lit(SIEVE)).cast("int")
        return F.get(whole, F.shiftright(at, 6)).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63))) != 0

    return passes


def running(rows: DataFrame, value: Column, order: list, by: list[str], label: str) -> DataFrame:
    """``rows`` with ``before``: the sum of ``value`` over earlier rows by ``order`` (with the same ``by``, if any).

    Rows are range-partitioned by both; sums run inside partitions, and on from the totals of those before.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(rows.withColumn("run_value", value).repartitionByRange(parts, *by, *order).withColumn("run_part", F.spark_partition_id()), label)
    inside = F.sum("run_value").over(Window.partitionBy("run_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    totals = placed.groupBy("run_part", *by).agg(F.sum("run_value").alias("run_total"))
    earlier = Window.partitionBy(*by).orderBy("run_part") if by else Window.orderBy("run_part")  # a row for each partition
    totals = totals.select("run_part", *by, F.coalesce(F.sum("run_total").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("run_start"))
    out = placed.withColumn("run_within", F.coalesce(inside, F.lit(0))).join(totals, ["run_part", *by])
    return out.withColumn("before", F.col("run_start") + F.col("run_within")).select(*rows.columns, "before")


def text_column(df: DataFrame, column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 3, is 1; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


# --- hashing -----------------------------------------------------------------------------------------------

_P = U(0x9E3779B97F4A7C15 | 1)
_P_INV = U(pow(int(_P), -1, 1 << 64))
#: A fixed random 64-bit value for each byte.
BYTE_CODE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: dict[str, np.ndarray] = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finalizer (xor-shift, multiply)."""
    x = x + U((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int, way: str = "up") -> np.ndarray:
    have = _powers[way]
    if len(have) < n:
        step = np.full(max(n, 1 << 16), _P if way == "up" else _P_INV, dtype=np.uint64)
        step[0] = 1
        have = _powers[way] = np.multiply.accumulate(step)
    return have[:n]


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """Running sums from which ``span_hash`` takes the hash of any span in constant time."""
    out = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * powers(len(codes)), out=out[1:])
    return out


def span_hash(running: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((running[end] - running[start]) * powers(len(running), "down")[start] + (end - start).astype(np.uint64))


# --- Arrow text --------------------------------------------------------------------------------------------


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (null: empty) and its n + 1 offsets from 0."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offs, data = column.buffers()
    at = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def trim() -> None:
    """Give back what tasks of this worker have freed, before and after each: workers live on, and the allocators would keep each one's peak."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def text_blocks(batches: Iterator[pa.RecordBatch], name: str = "text", most: int = BLOCK_BYTES):
    """Yield (slice of the batch, bytes, offsets) with at most ``most`` bytes, or one longer text."""
    trim()
    for batch in batches:
        if not batch.num_rows:
            continue
        data, at = text_buffer(batch.column(batch.schema.get_field_index(name)))
        row = 0
        while row < batch.num_rows:
            end = int(np.searchsorted(at, at[row] + most, "right")) - 1
            end = min(max(end, row + 1), row + BLOCK_ROWS, batch.num_rows)
            yield batch.slice(row, end - row), data[at[row] : at[end]], at[row : end + 1] - at[row]
            row = end
    batch = data = at = None
    trim()


def whole_groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Of rows sorted by ``names``: tables of whole groups, with the places where groups begin, and the end."""
    trim()
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        keys = [np.asarray(rows.column(c).combine_chunks()) for c in names]
        cut = np.concatenate([[0], np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1])
        if len(cut) > 1:
            yield rows.slice(0, int(cut[-1])), cut
        rest = rows.slice(int(cut[-1]))
    batch = rows = keys = None
    if rest is not None:
        yield rest, np.array([0, len(rest)])
    rest = None
    trim()


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word ``[^\\x20\\x09-\\x0D]+``; words never cross texts."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    solid = ~_SPACE[data]
    fresh = np.ones(len(data) + 1, dtype=bool)
    fresh[1:-1] = ~solid[:-1]
    fresh[offsets] = True
    starts = np.flatnonzero(solid & fresh[:-1])
    gap = np.ones(len(data) + 1, dtype=bool)
    gap[:-1] = ~solid
    gap[offsets] = True
    ends = np.flatnonzero(solid & gap[1:]) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of ``words`` lower-cased words as (row, 52-bit hash), sorted by both.

    A text with fewer words gives its whole word sequence as one shingle, an empty one gives none.
    """
    starts, ends, row = word_spans(data, offsets)
    if not len(starts):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    word = span_hash(prefix_hash(BYTE_CODE[LOWER[data]]), starts, ends)
    return sequence_sets(word, row, words, len(offsets) - 1)


def sequence_sets(word: np.ndarray, row: np.ndarray, words: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    count = np.bincount(row, minlength=rows)
    odd = [U((0xD6E8FEB86659FD93 * (2 * i + 1)) & 0xFFFFFFFFFFFFFFFF | 1) for i in range(words)]
    padded = np.concatenate([word, np.zeros(words, dtype=np.uint64)])
    first = np.cumsum(count) - count
    left = (first + count)[row] - np.arange(len(word))  # words from here to the end of the text
    total = np.zeros(len(word), dtype=np.uint64)
    for i in range(words):
        total += np.where(left > i, padded[i : i + len(word)] * odd[i], U(0))
    short = count < words
    keep = (left >= words) | (short[row] & (left == count[row]))
    size = np.minimum(count, words)[row].astype(np.uint64)
    value = mix(total + size * U(0xA24BAED4963EE407))[keep] >> U(12)
    both = np.sort((row[keep].astype(np.uint64) << U(52)) | value)
    both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
    return (both >> U(52)).astype(np.int64), both & U((1 << 52) - 1)


def sums_by(index: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Sums modulo 2^64 by index."""
    low = np.bincount(index, weights=(value & U(0xFFFFFFFF)).astype(np.float64), minlength=n)
    high = np.bincount(index, weights=(value >> U(32)).astype(np.float64), minlength=n)
    return low.astype(np.uint64) + ((high % 4294967296.0).astype(np.uint64) << U(32))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def list_column(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    at = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))


def gram_sets(data: np.ndarray, offsets: np.ndarray, orders: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct byte n-grams of each text, hashed to ``bits`` bits: (row, index), sorted. None crosses texts."""
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(offsets))
    code = BYTE_CODE[data]
    odd = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0xD6E8FEB86659FD93), U(0xA24BAED4963EE407)]
    out, total = [], np.zeros(len(data), dtype=np.uint64)
    for k in range(1, max(orders) + 1):
        n = len(data) - k + 1
        if n <= 0:
            break
        total = total[:n] + code[k - 1 :] * odd[k - 1]
        if k in orders:
            inside = row[:n] == row[k - 1 :]
            index = (mix(total, k) >> U(64 - bits)).astype(np.int64)
            out.append(((row[:n] << bits) | index)[inside])
    if not out:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    both = np.sort(np.concatenate(out))
    both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
    return both >> bits, both & ((1 << bits) - 1)


#: Groups of a sample whose shares are broadcast.
FEW = 1000


def bounded_sample(rows: DataFrame, most: int, key: str = "doc_id", group: str | None = None, total: int | None = None) -> DataFrame:
    """About ``most`` rows at most (of each group, and ``total`` of all), chosen by a hash of ``key``; all rows if there are no more."""
    million = 1_000_000
    chance = F.pmod(F.xxhash64(F.lit(5), F.col(key).cast("string")), F.lit(million))
    if group is None:
        n = rows.count()
        return rows if n <= most else rows.where(chance < int(million * most / n))
    counts = rows.groupBy(F.col(group).alias("sample_group")).agg((F.lit(million * most) / F.count(F.lit(1))).alias("sample_part"))
    parts = counts.limit(FEW + 1).collect()
    groups = len(parts) if len(parts) <= FEW else counts.count()
    share = min(1.0, total / (most * groups)) if total and groups else 1.0
    if len(parts) <= FEW:  # few groups: their parts travel with the plan
        rows = rows.where(chance < share * max([r["sample_part"] for r in parts], default=0.0))
        counts = F.broadcast(rows.sparkSession.createDataFrame(parts, counts.schema))
    return rows.join(counts, rows[group] == counts["sample_group"]).where(chance < F.lit(share) * F.col("sample_part")).drop("sample_group", "sample_part")
