"""Benchmark decontamination by SimHash windows.

For each benchmark item, windows of the item's number of words slide over every document, one word at a time. Windows and
items have a 64-bit SimHash of their weighted 5-word shingles (A-Z in lower case). Candidates are found in two steps. By
shingles: an item that shares no shingle with a document has similarity 0 with all its windows, so a document is compared
with the items it shares one with, at windows around such a shingle. By fingerprints: these items' are cut into BLOCKS
blocks, and a window finds every item that agrees in some block within RADIUS // BLOCKS bits, which by the pigeonhole
principle are all within RADIUS, and some beyond, which are dropped. Candidates are verified by the exact weighted
similarity: shared over united weight of the shingle multisets. A shingle weighs 1 + log(items / items that have it), so
phrases that many items share count less.

Two windows of similarity 0.75 differ in 11 bits of 64 on average, with a standard deviation of 3; RADIUS is four of these
above. `recall` compares with all windows, whatever their fingerprints.

A group of items that is broadcast has at most GROUP_BYTES of text; a larger benchmark is split into several, each with its
own pass over the documents. Items of fewer than 5 words are one shingle. Null or empty items and documents match nothing.
Rows that repeat, or repeat an id, are each searched, and give equal rows once. Of windows that match an item equally well
the first counts. Other columns, whatever their names, pass through `decontaminate`. Empty tables match nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, Rolling, grams, mix, parts, private, small_batches, words

SHINGLE, LEAST = 5, 0.75
RADIUS, BLOCKS = 23, 4
#: Bytes of items' text in a group; what is made of it takes some ten times as much in a worker.
GROUP_BYTES = 8 << 20
#: Windows times items that are compared at a time.
CELLS = 1 << 20
_POP = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def _shingles(hashes: np.ndarray) -> np.ndarray:
    n = len(hashes)
    return grams(hashes, SHINGLE) if n >= SHINGLE else mix(grams(hashes, n) + np.uint64(n)) if n else np.zeros(0, np.uint64)


def _bits(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of 64 bits of each shingle."""
    return (np.unpackbits(mix(shingles ^ np.uint64(0xA0761D6478BD642F)).view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32) * 2) - 1


def _packed(sums: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.packbits(sums > 0, axis=1)).view(np.uint64).ravel()


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a ^ b
    return sum(_POP[((x >> np.uint64(16 * i)) & np.uint64(0xFFFF)).astype(np.int64)].astype(np.int64) for i in range(4))


class MultiIndex:
    """Finds every fingerprint within a radius of a query, by blocks of bits."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS, blocks: int = BLOCKS):
        self.prints, self.radius, self.width = prints, radius, 64 // blocks
        self.near = radius // blocks
        self.blocks = [self._block(prints, b) for b in range(blocks)]

    def _block(self, x: np.ndarray, b: int) -> np.ndarray:
        return ((x >> np.uint64(b * self.width)) & np.uint64((1 << self.width) - 1)).astype(np.uint16)

    def search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, fingerprint) within the radius, once each."""
        q, p = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        step = max(1, CELLS // max(1, len(self.prints)))
        for a in range(0, len(queries), step):
            some = queries[a : a + step]
            found = np.zeros((len(some), len(self.prints)), bool)
            for b, block in enumerate(self.blocks):
                found |= _POP[self._block(some, b)[:, None] ^ block[None, :]] <= self.near
            i, j = np.nonzero(found)
            ok = distance(some[i], self.prints[j]) <= self.radius
            q.append(i[ok] + a)
            p.append(j[ok])
        return np.concatenate(q), np.concatenate(p)


@dataclass(eq=False)
class Items:
    """Benchmark items of one group."""

    ids: list
    size: np.ndarray
    kinds: list[int]  # words of a shingle: SHINGLE, and the sizes of shorter items
    shingles: list[np.ndarray]  # sorted, with repeats
    known: np.ndarray  # all shingles, sorted and distinct
    weight: np.ndarray  # of known
    prints: np.ndarray
    held: tuple[np.ndarray, np.ndarray]  # for each of known, where its items start; the items that have it

    def touched(self, hashes: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(size, its items that share a shingle with a document, places of such shingles), for each size of items."""
        starts, every = self.held
        at, which = [], []
        for n in self.kinds:
            s = grams(hashes, SHINGLE) if n == SHINGLE else mix(grams(hashes, n) + np.uint64(n))
            if len(s):
                k = np.minimum(np.searchsorted(self.known, s), len(self.known) - 1)
                found = np.flatnonzero(self.known[k] == s)
                at.append(found)
                which.append(k[found])
        if not at:
            return []
        at, which = np.concatenate(at), np.concatenate(which)
        distinct = np.unique(which)
        lists = [every[starts[k] : starts[k + 1]] for k in distinct.tolist()]
        items = np.unique(np.concatenate(lists)) if lists else np.zeros(0, np.int64)
        out = []
        for size in np.unique(self.size[items]).tolist():
            own = items[self.size[items] == size]
            has = np.array([bool((self.size[x] == size).any()) for x in lists])
            out.append((size, own, at[has[np.searchsorted(distinct, which)]]))
        return out

    def weights(self, shingles: np.ndarray) -> np.ndarray:
        """Shingles in no item weigh most."""
        at = np.minimum(np.searchsorted(self.known, shingles), len(self.known) - 1)
        return np.where(self.known[at] == shingles, self.weight[at], self.top)

    @property
    def top(self) -> float:
        return 1 + math.log(max(1, len(self.ids)))


def prepared(rows: list[tuple[int, str]]) -> Items | None:
    ids, sizes, sets = [], [], []
    for name, text in rows:
        raw = (text or "").encode()
        low = LOWER[np.frombuffer(raw, np.uint8)]
        starts, ends, _ = words(low, np.array([0, len(low)]))
        if len(starts):
            ids.append(name)
            sizes.append(len(starts))
            sets.append(np.sort(_shingles(Rolling(low).between(starts, ends))))
    if not ids:
        return None
    known, count = np.unique(np.concatenate([np.unique(s) for s in sets]), return_counts=True)
    has = np.unique(np.concatenate([np.searchsorted(known, s) * np.int64(1 << 31) + i for i, s in enumerate(sets)]))
    held = np.searchsorted(has >> 31, np.arange(len(known) + 1)), has & ((1 << 31) - 1)
    kinds = [SHINGLE, *sorted({n for n in sizes if n < SHINGLE})]
    items = Items(ids, np.array(sizes), kinds, sets, known, 1 + np.log(len(ids) / count), np.zeros(0, np.uint64), held)
    items.prints = np.concatenate([_packed((_bits(s) * items.weights(s)[:, None].astype(np.float32)).sum(0, keepdims=True)) for s in sets])
    return items


def similarity(a: np.ndarray, b: np.ndarray, items: Items) -> float:
    """Weighted Jaccard of two shingle multisets."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    every = np.union1d(x, y)
    p, q = np.zeros(len(every)), np.zeros(len(every))
    p[np.searchsorted(every, x)], q[np.searchsorted(every, y)] = n, m
    w = items.weights(every)
    return float((w * np.minimum(p, q)).sum() / (w * np.maximum(p, q)).sum())


def matches(hashes: np.ndarray, items: Items, least: float = LEAST, radius: int = RADIUS) -> list[tuple[int, float, int]]:
    """(item, best similarity, first word of the first best window) for a document's word hashes."""
    best: dict[int, tuple[float, int]] = {}
    n = len(hashes)
    runs = grams(hashes, SHINGLE)
    for size, own, hit in items.touched(hashes):
        if n < size:
            continue
        index = MultiIndex(items.prints[own], radius)
        if size < SHINGLE:
            s, width = mix(grams(hashes, size) + np.uint64(size)), 1
        else:
            s, width = runs, size - SHINGLE + 1
        last = len(s) - width
        lo, hi = np.maximum(0, hit - width + 1), np.minimum(hit, last)
        lo, hi = lo[hi >= lo], hi[hi >= lo]
        cover = np.zeros(last + 2, np.int64)
        np.add.at(cover, lo, 1)
        np.add.at(cover, hi + 1, -1)
        windows = np.flatnonzero(np.cumsum(cover[: last + 1]) > 0)
        for a in range(0, len(windows), 20_000):
            some = windows[a : a + 20_000]
            base, stop = some[0], some[-1] + width
            part = s[base:stop]
            rising = np.zeros((len(part) + 1, 64))
            np.cumsum(_bits(part) * items.weights(part)[:, None], axis=0, out=rising[1:])
            q, p = index.search(_packed(rising[some - base + width] - rising[some - base]))
            for i, j in zip(q.tolist(), own[p].tolist()):
                w = int(some[i])
                x = similarity(s[w : w + width], items.shingles[j], items)
                if x >= least and (j not in best or (x, -w) > (best[j][0], -best[j][1])):
                    best[j] = x, w
    return [(j, x, w) for j, (x, w) in best.items()]


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, similarity, start_word: the best window for each document and item that match. A radius of 64 compares all."""
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-total // GROUP_BYTES))
    out = None
    for g in range(groups):
        rows = [(r["item_id"], r["text"]) for r in (items if groups == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g)).toLocalIterator()]
        held = spark.sparkContext.broadcast(prepared(rows))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            group = held.value
            if group is None:
                return
            probe = np.zeros(1 << 22, bool)
            probe[(group.known >> np.uint64(42)).astype(np.int64)] = True
            for batch in batches:
                names = batch.column(0).to_pylist()
                for a, b, data, offsets in parts(batch.column(1)):
                    low = LOWER[data]
                    starts, ends, first = words(low, offsets)
                    hashes = Rolling(low).between(starts, ends)
                    # Documents without a shingle of any item are done with: a bitmap first, then the shingles themselves.
                    seen = np.zeros(len(hashes) + 1, np.int64)
                    for n in group.kinds:
                        s = grams(hashes, SHINGLE) if n == SHINGLE else mix(grams(hashes, n) + np.uint64(n))
                        hit = np.flatnonzero(probe[(s >> np.uint64(42)).astype(np.int64)])
                        seen[hit[np.isin(s[hit], group.known)] + 1] += 1
                    np.cumsum(seen, out=seen)
                    out: list[tuple] = []
                    for i, (x, y) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                        if seen[y] > seen[x]:
                            out += [(names[a + i], group.ids[j], s, w) for j, s, w in matches(hashes[x:y], group, least, radius)]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64(), pa.int64()))], names=["doc_id", "item_id", "similarity", "start_word"])

        found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, item_id long, similarity double, start_word long")
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """docs less those that hold a benchmark item. Rows without an id can't be named and stay."""
    (name,) = private(docs.columns, "_gone")
    gone = contaminated(docs, benchmark, least).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")


def recall(docs: DataFrame, benchmark: DataFrame) -> tuple[int, int]:
    """(pairs found, pairs that are there): how many matches the fingerprints' radius lets through."""
    return contaminated(docs, benchmark).count(), contaminated(docs, benchmark, radius=64).count()


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
