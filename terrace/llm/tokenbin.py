"""Token-id files: a static range asymmetric numeral system over segments of documents.

A segment holds whole documents in ascending doc_id order. It has one frequency table, shared by its blocks. A block is
BLOCK ids dealt over LANES interleaved coder states; blocks know nothing of each other. The block directory holds, as
checkpoints, each block's lane states, the place of its words and a checksum of its ids, so any block can be decoded
alone, or all at once. A segment is a row of a Parquet table, which gives the files atomic commits.

Layout of a segment (little-endian): magic "TBN1", format, lanes, log2 of the table's total, documents, ids, symbols,
blocks (unsigned 32-bit each but ids, 64-bit); symbols (u4), frequencies (u4), document ids (i8), null flags (u1),
document lengths (u8); per block ids, words and crc32 of its ids (u4 each); lane states (u8); words (u4); then the crc32
of all before it.

Null texts count as empty; a null doc_id sorts first and comes back null; rows that repeat, or repeat an id, each come
back. Rows of equal id are in order of their text's hash. Other columns of the input are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_folder, small_batches, stored
from .tokens import Encoder, crc, tokenizer_path

LANES, BLOCK, SEGMENT, SCALE = 128, 1 << 16, 1 << 21, 20
#: Bytes of text in a range of ids, about, where the session's shuffles have fewer tasks than that makes.
RANGE_BYTES = 64 << 20
_HEAD = struct.Struct("<4sIIIIQII")
_LOW = np.uint64(1 << 31)


def quantised(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies of at least 1 that sum to 2**scale, in proportion to counts."""
    total, n = 1 << scale, len(counts)
    if n > total:
        raise ValueError("more symbols than the table's total")
    f = np.maximum(1, counts * (total - n) // max(1, counts.sum())).astype(np.int64)
    gap = total - int(f.sum())
    order = np.argsort(-f, kind="stable")
    if gap > 0:
        f[order[0]] += gap
    while gap < 0:
        take = min(-gap, int(f[order[0]]) - 1)
        f[order[0]] -= take
        gap += take
        order = np.argsort(-f, kind="stable")
    return f


def write_segment(ids: np.ndarray, names: list[int | None], lengths: np.ndarray, lanes: int = LANES, block: int = BLOCK, scale: int = SCALE) -> bytes:
    """One segment's bytes. ids: those of all its documents, one after another."""
    n = len(ids)
    every = np.bincount(ids, minlength=1)  # ids are below the vocabulary's size
    symbols = np.flatnonzero(every)
    counts = every[symbols]
    rank = np.zeros(len(every), np.int32)
    rank[symbols] = np.arange(len(symbols), dtype=np.int32)
    inverse = rank[ids]
    freq = quantised(counts, scale) if n else np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum(freq)[:-1]]) if n else freq
    blocks = -(-n // block)
    steps = block // lanes
    f, c = freq.astype(np.uint64), first.astype(np.uint64)
    grid = np.full(blocks * block, -1, np.int32)
    grid[:n] = inverse
    grid = np.ascontiguousarray(grid.reshape(blocks, steps, lanes).transpose(1, 0, 2)).reshape(steps, blocks * lanes)
    whole = n == blocks * block
    state = np.full(blocks * lanes, _LOW, np.uint64)
    shift, limit = np.uint64(scale), np.uint64(63 - scale)
    words, owners = [], []
    of = np.repeat(np.arange(blocks), lanes)
    for t in range(steps - 1, -1, -1):
        s = grid[t]
        on = slice(None) if whole else np.flatnonzero(s >= 0)
        if not whole and not len(on):
            continue
        k, x = s[on], state[on]
        fk = f[k]
        at = np.flatnonzero(x >= (fk << limit))
        if len(at):
            words.append((x[at] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            owners.append(of[on][at])
            x[at] >>= np.uint64(32)
        q = x // fk
        state[on] = (q << shift) + (x - q * fk) + c[k]
    words.reverse()
    owners.reverse()
    word = np.concatenate(words) if words else np.zeros(0, "<u4")
    owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    order = np.argsort(owner, kind="stable")
    plain = ids.astype("<u4")
    sizes = np.full(blocks, block, np.int64)
    if blocks:
        sizes[-1] = n - (blocks - 1) * block
    directory = np.stack([sizes, np.bincount(owner, minlength=blocks) if blocks else sizes, [crc(plain[i * block : (i + 1) * block].tobytes()) for i in range(blocks)]], 1).astype("<u4") if blocks else np.zeros((0, 3), "<u4")
    out = b"".join([
        _HEAD.pack(b"TBN1", block, lanes, scale, len(names), n, len(symbols), blocks),
        symbols.astype("<u4").tobytes(), freq.astype("<u4").tobytes(),
        np.array([x if x is not None else 0 for x in names], "<i8").tobytes(), np.array([x is None for x in names], "u1").tobytes(), np.asarray(lengths, "<u8").tobytes(),
        directory.tobytes(), state.astype("<u8").tobytes(), word[order].tobytes(),
    ])
    return out + struct.pack("<I", zlib.crc32(out))


class Segment:
    """A segment's directory; blocks are decoded on demand."""

    def __init__(self, data: bytes, verify: bool = True):
        if verify and zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("a segment's checksum doesn't hold")
        magic, self.block, self.lanes, self.scale, docs, self.n, symbols, self.blocks = _HEAD.unpack_from(data)
        if magic != b"TBN1":
            raise ValueError("not a segment")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(data, kind, n, at)
            at += x.nbytes
            return x

        self.symbols, self.freq = take("<u4", symbols), take("<u4", symbols)
        names, null = take("<i8", docs), take("u1", docs)
        self.names = [None if z else x for x, z in zip(names.tolist(), null)]
        self.lengths = take("<u8", docs).astype(np.int64)
        self.directory = take("<u4", 3 * self.blocks).reshape(-1, 3).astype(np.int64)
        self.states = take("<u8", self.blocks * self.lanes).reshape(self.blocks, self.lanes)
        self.words = take("<u4", int(self.directory[:, 1].sum()))

    def decode(self, blocks: range | None = None) -> np.ndarray:
        """Ids of consecutive blocks (all by default), checked against their checksums."""
        blocks = range(self.blocks) if blocks is None else blocks
        if not len(blocks):
            return np.zeros(0, np.uint32)
        first = np.concatenate([[0], np.cumsum(self.freq.astype(np.int64))[:-1]])
        slot = np.repeat(np.arange(len(self.freq), dtype=np.int32), self.freq)
        picked = self.directory[blocks.start : blocks.stop]
        at = (np.cumsum(self.directory[:, 1]) - self.directory[:, 1])[blocks.start : blocks.stop].copy()
        state = self.states[blocks.start : blocks.stop].astype(np.uint64)
        f, c = self.freq.astype(np.uint64), first.astype(np.uint64)
        mask, shift = np.uint64((1 << self.scale) - 1), np.uint64(self.scale)
        steps, lane = self.block // self.lanes, np.arange(self.lanes)
        out = np.empty((steps, len(picked), self.lanes), np.int32)
        words = self.words.astype(np.uint64) if len(self.words) else np.zeros(1, np.uint64)
        left = picked[:, :1] - lane[None, :]  # a lane is done once step * lanes reaches this
        full = int(left.min()) // self.lanes if len(picked) else 0
        for t in range(steps):
            low = state & mask
            k = slot[low]
            out[t] = k
            x = f[k] * (state >> shift) + low - c[k]
            need = x < _LOW
            if t >= full:
                live = left > t * self.lanes
                if not live.any():
                    break
                need &= live
                x = np.where(live, x, state)
            nth = np.cumsum(need, axis=1)
            nth += at[:, None] - 1
            rows, lanes = np.nonzero(need)
            x[rows, lanes] = (x[rows, lanes] << np.uint64(32)) | words[nth[rows, lanes]]
            at = nth[:, -1] + 1
            state = x
        out = out.transpose(1, 0, 2).reshape(len(picked), -1)
        ids = self.symbols[np.concatenate([out[i, : picked[i, 0]] for i in range(len(picked))])]
        begin = 0
        for n, _, check in picked.tolist():
            if crc(ids[begin : begin + n].astype("<u4").tobytes()) != check:
                raise ValueError("a block's checksum doesn't hold")
            begin += n
        return ids


SEGMENTS = "part int, segment int, documents long, ids long, data binary"


def write_token_files(docs: DataFrame, out: str, path: str | None = None, end_id: int = 2, segment: int = SEGMENT) -> DataFrame:
    """Writes the documents' ids in ascending doc_id order below `out` and returns the segments as read from there.

    Rows are dealt by ranges of doc_id and text hash, so part and segment number order all ids of the corpus, and rows of
    one id don't have to share a task. A document that is longer
    than a segment has one of its own.
    """
    spark = docs.sparkSession
    path = path or tokenizer_path()
    small_batches(spark)
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, encoder, end = TaskContext.get().partitionId(), 0, Encoder.kept(path), np.array([end_id], "<u4").tobytes()
        held, names, total = [], [], 0
        schema = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("documents", pa.int64()), ("ids", pa.int64()), ("data", pa.binary())])

        def flush() -> pa.RecordBatch:
            data = write_segment(np.frombuffer(b"".join(held), "<u4"), names, np.array([len(x) // 4 for x in held]))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part, number, len(names), total, data), schema.types)], schema=schema)

        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), encoder.encode(x or "" for x in batch.column(1).to_pylist())):
                ids += end
                if held and total + len(ids) // 4 > segment:
                    yield flush()
                    held, names, total, number = [], [], 0, number + 1
                held.append(ids)
                names.append(name)
                total += len(ids) // 4
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    order = F.col("doc_id").asc_nulls_first(), F.xxhash64("text")
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return stored(ordered.mapInArrow(run, SEGMENTS), out, "uncompressed")


def read_token_files(segments: DataFrame, with_ids: bool = True) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (int array), decoded from the segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("doc_id", pa.int64()), ("local", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *[("ids", pa.list_(pa.int32()))] * with_ids])
        for batch in batches:
            for part, number, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                seg = Segment(data.as_py())
                ids = seg.decode().astype("<u4")
                ends = np.cumsum(seg.lengths)
                starts = ends - seg.lengths
                for at in range(0, len(ends), 500):
                    s, e = starts[at : at + 500], ends[at : at + 500]
                    m = len(s)
                    lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([s, e[-1:]]) - s[0], pa.int32()), pa.array(ids[s[0] : e[-1]].astype(np.int32)))] if with_ids else []
                    sums = [crc(ids[a:b].tobytes()) for a, b in zip(s.tolist(), e.tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array([part] * m, pa.int32()), pa.array([number] * m, pa.int32()), pa.array(seg.names[at : at + 500], pa.int64()), pa.array(s), pa.array(e - s), pa.array(sums, pa.int64()), *lists], schema=schema)

    rows = segments.select("part", "segment", "data").mapInArrow(run, "part int, segment int, doc_id long, local long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
    sizes = segments.groupBy("part").agg(F.sum("ids").alias("n"))  # a row for each written partition
    parts = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    base = segments.select("part", "segment", F.coalesce(F.sum("ids").over(inside), F.lit(0)).alias("earlier")).join(parts.select("part", "before"), "part")
    joined = rows.join(base, ["part", "segment"])
    return joined.select("doc_id", (F.col("before") + F.col("earlier") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op4_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_folder(spark)}/ids")
    return read_token_files(segments, with_ids=False)
