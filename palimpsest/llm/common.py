"""Helpers shared by the training-data operators.

Texts reach Python as Arrow batches and are worked on as flat byte arrays:
no per-row Python strings, and no temporary larger than a fixed multiple of
``CHUNK_BYTES`` unless a single text is longer than that.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.session import durable, shared_folder  # noqa: F401

CHUNK_BYTES = 1 << 20

#: [\x20\x09-\x0D], the word separators of every word-based operator.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so invertible modulo 2**64
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: A fixed random value for each byte keeps short runs of one byte apart.
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def release(spark: SparkSession) -> None:
    """Lets Spark drop shuffle files of plans that nothing refers to any more.

    They would stay until the driver happens to collect its garbage.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 1 modulo 3; null ids count as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def tidied(function):  # noqa: ANN001, ANN201
    """A mapInArrow function that gives free memory back when its task ends.

    Python workers live on from task to task; without this, each keeps the most
    that any of its tasks ever held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return run


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets (one more than rows) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(data: np.ndarray, off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole rows of about ``limit`` bytes."""
    n, i = len(off) - 1, 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def _powers(kind: str, n: int) -> np.ndarray:
    have = _POWERS.get(kind)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        base = _BASE if kind == "up" else _INV
        out = np.full(size, base, np.uint64)
        out[0] = 1
        have = _POWERS[kind] = np.cumprod(out, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (public-domain splitmix constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h with h[j] - h[i], scaled by range_hash, identifying data[i:j]."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers("up", len(data)), out=out[1:], dtype=np.uint64)
    return out


def range_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] that don't depend on the place."""
    size = (end - start).astype(np.uint64)
    return mix((h[end] - h[start]) * _powers("down", len(h))[start] + size * np.uint64(0xD6E8FEB86659FD93))


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words [^\\x20\\x09-\\x0D]+ of each text."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~SPACE[data]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    inner = off[1:-1]
    if len(inner):  # a text may begin where another ends without white space
        cut = np.unique(inner)
        cut = cut[(cut > 0) & (cut < len(data))]
        cut = cut[(inside[cut] == 1) & (inside[cut + 1] == 1)]
        if len(cut):
            starts, ends = np.sort(np.append(starts, cut)), np.sort(np.append(ends, cut))
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


def per_row(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of values[off[i]:off[i + 1]]."""
    total = np.zeros(len(values) + 1, np.int64 if values.dtype != np.float64 else np.float64)
    np.cumsum(values, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def shingles(words: np.ndarray, rows: np.ndarray, n_rows: int, width: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of runs of ``width`` word hashes within a row, their rows and first words."""
    if len(words) < width:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, empty
    n = len(words) - width + 1
    h = words[:n].copy()
    for k in range(1, width):
        h = mix(h * np.uint64(0x9FB21C651E98DF25) + words[k : k + n])
    first = np.flatnonzero(rows[:n] == rows[width - 1 :])
    return h[first], rows[first], first


#: Bits of the fixed-size filters that keep rows without a partner from being moved.
FILTER_BITS = 1 << 26


def membership_filter(df: DataFrame, column: str):  # noqa: ANN201
    """A broadcast bit set of the long ``column``, FILTER_BITS (8 MiB) whatever the input.

    A row that passes may still have no partner; the join that follows decides.
    """
    word = F.floor(F.pmod(column, F.lit(FILTER_BITS)) / 64).cast("int")
    bit = F.expr(f"shiftleft(1L, cast(pmod(`{column}`, {FILTER_BITS}) % 64 as int))")
    have = df.select(word.alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    w, b = (np.asarray(have.column(c).combine_chunks()) if have.num_rows else np.zeros(0, np.int64) for c in ("w", "b"))
    return df.sparkSession.sparkContext.broadcast((w, b))


def filter_words(value: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[value[0]] = value[1].view(np.uint64)
    return out


def in_filter(words: np.ndarray, key: int) -> bool:
    bit = key % FILTER_BITS
    return bool(int(words[bit >> 6]) >> (bit & 63) & 1)


#: Classes whose counts are broadcast; a row of them takes some ten bytes.
MAX_BROADCAST_CLASSES = 100_000


def bounded_sample(rows: DataFrame, by: str, per_class: int, text: str = "text", seed: int = 7) -> DataFrame:
    """At most ``per_class`` different rows of each value of ``by``, chosen by a hash of the text.

    ``per_class`` is the documented bound of what classifiers are fitted on.
    Rows with null ``by`` or text are left out. The classes are counted first,
    so that about twice the bound at most is ever moved.
    """
    rows = rows.where(F.col(by).isNotNull() & F.col(text).isNotNull())
    counts = durable(rows.groupBy(by).agg(F.count("*").alias("_n")))
    if counts.count() <= MAX_BROADCAST_CLASSES:  # else the join moves the texts once
        counts = F.broadcast(counts)
    u = F.pmod(F.xxhash64(F.lit(seed), text), F.lit(1 << 30))
    few = rows.withColumn("_u", u).join(counts, by).where(F.col("_u") < (2.0 * per_class + 50) / F.col("_n") * (1 << 30))
    few = few.dropDuplicates([by, "_u"])
    order = Window.partitionBy(by).orderBy("_u")
    return few.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= per_class).drop("_n", "_u", "_k")
