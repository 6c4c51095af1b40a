"""Shared helpers: tables in the shared folder and vectorised access to Arrow text columns."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import checkpoint_dir

#: ASCII white space as the word rule has it: the space and the characters 9 to 13.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Bytes of text that a worker handles at a time: its arrays have 8 bytes for each, several times over.
SLICE_BYTES = 1 << 19


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share."""
    return f"{checkpoint_dir(spark)}/terrace-{uuid.uuid4().hex}"


#: Bytes of an Arrow batch between the JVM and Python, where the session has Spark's own 64 MB.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes: rows with texts are of any size. A session's own lower bound stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == f"{64 << 20}b":
        spark.conf.set(name, f"{BATCH_BYTES}b")


def dealt(df: DataFrame, *by: str, most: int | None = None) -> DataFrame:
    """df dealt over tasks by columns. As many tasks as the session's shuffles have (or `most`, if fewer), which adaptive
    execution leaves alone: what follows takes long for its bytes."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(1, min(n, most or n)), *by)


def private(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be in no column's way (letter case aside)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def stored(df: DataFrame, path: str, codec: str = "zstd") -> DataFrame:
    """df, written as Parquet below the shared folder and read again: lineage ends here and survives lost executors."""
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a join sends to every task, where they are counted to be so few; they are narrow, some tens of bytes.
FEW_ROWS = 250_000


def few(table: DataFrame) -> DataFrame:
    """A stored table of narrow rows, with a broadcast hint where it is counted to be small; else Spark chooses the join."""
    return F.broadcast(table) if table.count() <= FEW_ROWS else table


def document_key(doc_id: Column | str = "doc_id", text: Column | str = "text") -> Column:
    """Identifies a row by its id and whole text, so ids that repeat or are null do no harm. Equal rows share a key."""
    return F.struct(F.coalesce(F.col(doc_id) if isinstance(doc_id, str) else doc_id, F.lit(-(2**63))).alias("id"), F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))).alias("h"))


def as_binary(col: Column) -> Column:
    """UTF-8 bytes of a text, null as empty."""
    return F.coalesce(col.cast("string"), F.lit("")).cast("binary")


def parts(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of slices of at most `most` bytes, or one longer value. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        end = min(end, n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_RANDOM: dict[int, np.ndarray] = {}


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    kept = _POWERS.get(base)
    if kept is None or len(kept[0]) < n:
        size = max(n, SLICE_BYTES + 1)

        def series(b: int) -> np.ndarray:
            out = np.full(size, b, np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)

        kept = series(base), series(pow(base, -1, 1 << 64))
        if size <= SLICE_BYTES + 1:  # a longer text's are made for it alone
            _POWERS[base] = kept
    return kept


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


class Rolling:
    """Hashes of any range of a byte sequence in constant time each; equal bytes have equal hashes anywhere."""

    def __init__(self, data: np.ndarray, seed: int = 1):
        """data: bytes, or 64-bit values that are hashes already."""
        if seed not in _RANDOM:
            _RANDOM[seed] = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = (_BASE + 2 * seed * 0x1F123BB5) % 2**64 | 1
        power, self.back = _powers(len(data) + 1, self.base)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.add.accumulate((_RANDOM[seed][data] if data.dtype == np.uint8 else data) * power[: len(data)], out=self.sums[1:])

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))

    def every(self, width: int) -> np.ndarray:
        """Of the range of this width that starts at each place."""
        n = max(0, len(self.sums) - width)
        return mix((self.sums[width : width + n] - self.sums[:n]) * self.back[:n])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of each text, and the first word of each text (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    black = ~WHITE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    starts = black.copy()
    starts[1:] &= ~black[:-1] | first[1:n]
    ends = black.copy()
    ends[:-1] &= ~black[1:] | first[1:n]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n consecutive values from each place on; shorter by n - 1."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out *= np.uint64(_BASE)
        out += hashes[i : i + m]
    return mix(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of the `width` values from each place on; shorter by width - 1."""
    m = len(x) - width + 1
    if m <= 0:
        return np.zeros(0, x.dtype)
    padded = -(-len(x) // width) * width
    y = np.full(padded, np.iinfo(x.dtype).max, x.dtype)
    y[: len(x)] = x
    y = y.reshape(-1, width)
    before = np.minimum.accumulate(y, axis=1).ravel()
    after = np.ascontiguousarray(np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1]).ravel()
    return np.minimum(after[:m], before[width - 1 : width - 1 + m])


def bitmap(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """One bit for each of 2**bits residues that a 64-bit column has; its size doesn't depend on the data.

    A filter that lets every row through that matters: where the data outgrow it, it lets all rows through.
    """
    n = F.pmod(F.col(column), F.lit(1 << bits)) + 1
    packed = df.groupBy(F.bitmap_bucket_number(n).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(n)).alias("b"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in packed.toLocalIterator():
        at = (r["k"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(bytes(r["b"]), np.uint8)[: len(out) - at]
    return out


def in_bitmap(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    low = x.astype(np.uint64) & np.uint64(8 * len(table) - 1)
    return (table[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 == 1
