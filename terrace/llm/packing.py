"""Packing of token sequences: shortest-pack-first over the length histogram.

Documents are encoded once; a document longer than a sequence is cut into full pieces and a rest. Only the histogram of
piece lengths (at most `width` entries, whatever the corpus) reaches the driver, where lengths are placed longest first,
each into the open pack that is shortest so far, updating counts of packing patterns. Pieces then find their pack by
their rank among the pieces of their length: the rank inside a task is counted while encoding, and the ranks of earlier
tasks are added by a join, so no length, however common, meets in one task.

Null texts count as empty; an empty text is its end id alone. Rows that repeat, or repeat an id, are packed each on
their own. Other columns of the input are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_folder, small_batches, stored
from .tokens import Encoder, crc, tokenizer_path

WIDTH = 2048
PIECES = "part int, piece_rank long, doc_id long, start long, length int, ids_crc32 long, doc_tokens long"


@dataclass
class Pattern:
    """`count` packs that hold pieces of these lengths, longest first."""

    lengths: list[int]
    count: int
    ranks: list[int] = field(default_factory=list)  # of the first piece in each slot


def pack_histogram(counts: dict[int, int], width: int = WIDTH) -> list[Pattern]:
    """Patterns that together hold counts[n] pieces of each length n, each pack at most `width` long.

    Longest lengths go first, into the shortest pack that is open; where all open packs together are fewer than the
    pieces, new packs begin. A pattern splits where only some of its packs get a piece.
    """
    room: dict[int, list[Pattern]] = {}
    rooms: list[int] = []  # ascending

    def put(p: Pattern, left: int) -> None:
        if left not in room:
            room[left] = []
            insort(rooms, left)
        room[left].append(p)

    for length in sorted((n for n, k in counts.items() if k > 0), reverse=True):
        if not 0 < length <= width:
            raise ValueError(f"a piece of {length} doesn't fit {width}")
        pieces, rank, opened = counts[length], 0, []
        while pieces:
            if not rooms or rooms[-1] < length:
                opened.append((Pattern([length], pieces, [rank]), width - length))
                break
            left = rooms[-1]
            p = room[left].pop()
            if not room[left]:
                del room[left]
                rooms.pop()
            n = min(p.count, pieces)
            if n < p.count:
                rest = Pattern(p.lengths, p.count - n, [r + n for r in p.ranks])
                put(rest, left)
            put(Pattern([*p.lengths, length], n, [*p.ranks, rank]), left - length)
            pieces -= n
            rank += n
        for p, left in opened:
            # Several of this length may share a pack: fold them while they fit.
            each = width // length
            if each > 1 and p.count > 1:
                full, some = divmod(p.count, each)
                base = p.ranks[0]
                if full:
                    put(Pattern([length] * each, full, [base + i * full for i in range(each)]), width - each * length)
                if some:
                    put(Pattern([length] * some, 1, [base + each * full + i for i in range(some)]), width - some * length)
            else:
                put(p, left)
    return [p for left in rooms for p in room[left]]


def slots(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """A row for each slot of each pattern, by length and first rank: packs of a pattern are numbered one after another."""
    rows, sequence = [], 0
    for p in sorted(patterns, key=lambda p: (p.lengths, p.ranks)):
        offset = 0
        for length, rank in zip(p.lengths, p.ranks):
            rows.append((length, rank, sequence, offset))
            offset += length
        sequence += p.count
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 4)
    return {"length": a[:, 0], "rank": a[:, 1], "sequence": a[:, 2], "offset": a[:, 3]}


def encoded_pieces(docs: DataFrame, path: str, end_id: int, width: int) -> DataFrame:
    """Pieces of every document with their rank among the pieces of their length in their task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, encoder, end = TaskContext.get().partitionId(), {}, Encoder.kept(path), np.array([end_id], "<u4").tobytes()
        schema = pa.schema([("part", pa.int32()), ("piece_rank", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(names), 200):
                out: list[tuple] = []
                for name, ids in zip(names[at : at + 200], encoder.encode(x or "" for x in texts[at : at + 200].to_pylist())):
                    ids += end
                    total = len(ids) // 4
                    for start in range(0, total, width):
                        n = min(width, total - start)
                        rank = seen.get(n, 0)
                        seen[n] = rank + 1
                        out.append((part, rank, name, start, n, crc(ids[4 * start : 4 * (start + n)]), total))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), schema.types)], schema=schema)

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def pack(docs: DataFrame, path: str | None = None, end_id: int = 1, width: int = WIDTH, folder: str | None = None) -> DataFrame:
    """Pieces with their sequence: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length.

    Ends each document with end_id. `folder` is where the pieces are written (by default below spark.checkpoint.dir).
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark)
    pieces = stored(encoded_pieces(docs, path or tokenizer_path(), end_id, width), f"{folder}/pieces")
    counts = stored(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), f"{folder}/counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `width` rows
    found = pack_histogram(histogram, width)
    table = spark.sparkContext.broadcast(slots(found))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        t = table.value
        top = np.int64(1) << np.int64(40)
        at = np.searchsorted(t["length"] * top + t["rank"], length.to_numpy(np.int64) * top + rank.to_numpy(np.int64), "right") - 1
        return pd.DataFrame({"sequence_id": t["sequence"][at] + rank.to_numpy(np.int64) - t["rank"][at], "offset": t["offset"][at]})

    placed = pieces.join(base, ["part", "length"]).withColumn("at", place("length", F.col("piece_rank") + F.col("before")))
    return placed.select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "at.sequence_id", "at.offset")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
