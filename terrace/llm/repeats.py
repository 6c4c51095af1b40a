"""Windows that occur more than once, for sequences of bytes or of words.

A window is `length` consecutive symbols of one document. Its core is the least hash of the `core` consecutive symbols
inside it, so equal windows have equal cores. A unit is a stretch of consecutive windows with their core at the same place,
so no two of them are equal; its context is what its windows cover. Spark counts cores over all units: windows whose core
occurs once are unique. Units of equal context are the same passage, by two 64-bit hashes. Of a core with several contexts
one unit of each context (the first) brings its text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, bitmap, grams, in_bitmap, mix, parts, sliding_min, small_batches, stored, words

#: Contexts of a core that one task may hold: some 7 MB of text, and 50 MB of hashes of their windows.
MOST = 20_000
#: log2 of the most bits of a filter that is broadcast; it has sixteen for each value where that is less.
MOST_BITS = 28
#: A key of more rows than this, or than this share of all, is joined apart from the others.
HOT_ROWS, HOT_SHARE = 2_000, 100_000
NO_ID = -(2**63)


@dataclass
class Shape:
    length: int
    core: int
    words: bool

    @property
    def width(self) -> int:
        return self.length - self.core + 1

    def symbols(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes, or a hash of each word; and each text's first symbol."""
        if not self.words:
            return data, offsets
        starts, ends, first = words(data, offsets)
        return Rolling(data).between(starts, ends), first

    def cores(self, symbols: np.ndarray) -> np.ndarray:
        return grams(symbols, self.core) if self.words else Rolling(symbols).every(self.core)

    def anchors(self, cores: np.ndarray) -> np.ndarray:
        """Of the window that starts at each place: where its least core is, the first of equals (by the high bits)."""
        n = len(cores) - self.width + 1
        out = np.empty(max(0, n), np.int64)
        mask, step = np.uint64((1 << 24) - 1), 1 << 23
        for a in range(0, n, step):
            part = cores[a : a + step + self.width - 1]
            key = (part & ~mask) | np.arange(len(part), dtype=np.uint64)
            out[a : a + step] = a + (sliding_min(key, self.width) & mask).astype(np.int64)
        return out

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """row, lo, hi (first symbols of the first and last window, within the text), core, context hash of each unit."""
        symbols, first = self.symbols(data, offsets)
        sizes = np.maximum(0, np.diff(first) - self.length + 1)
        total = int(sizes.sum())
        if not total:
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
        row = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first[:-1], sizes)
        cores = self.cores(symbols)
        anchor = self.anchors(cores)[at]
        new = np.ones(total, bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
        start = np.flatnonzero(new)
        last = np.append(start[1:], total) - 1
        lo, hi, row = at[start], at[last], row[start]
        context = Rolling(symbols).between(lo, hi + self.length)
        return row, lo - first[row], hi - first[row], cores[anchor[start]], context


def keyed(docs: DataFrame) -> DataFrame:
    """id (NO_ID for null), th (hash of the text), text. Rows that are equal in both share a key."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("th"), F.col("text").cast("string"))


def _doc_hash(ids: np.ndarray, th: np.ndarray) -> np.ndarray:
    return ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + th.astype(np.uint64)


def _bits(n: int) -> int:
    return min(MOST_BITS, max(16, (16 * n).bit_length()))


def documents_in(rows: DataFrame, of: DataFrame) -> DataFrame:
    """rows (id, th, text) whose key may be in `of`: a filter by a bitmap, before the join; it grows with `of` up to MOST_BITS."""
    at = F.xxhash64("id", "th").alias("at")
    keys = of.select(at).distinct()
    table = rows.sparkSession.sparkContext.broadcast(bitmap(keys, "at", _bits(keys.count())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = in_bitmap(batch.column(3).to_numpy(zero_copy_only=False), table.value)
            yield batch.filter(pa.array(keep)).select([0, 1, 2])

    return rows.select("id", "th", "text", at).mapInArrow(run, "id long, th long, text string")


def join_apart(big: DataFrame, table: DataFrame, on: list[str], weight: str, total: int) -> DataFrame:
    """big joined with a stored table of one row for each key, `weight` being the key's rows in big.

    Keys with very many rows, at most HOT_SHARE of them, are broadcast, so none of them comes to one task.
    """
    hot = table.where(F.col(weight) > max(HOT_ROWS, total // HOT_SHARE)).drop(weight)
    cold = table.where(F.col(weight) <= max(HOT_ROWS, total // HOT_SHARE)).drop(weight)
    rest = big.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on)
    return big.join(F.broadcast(hot), on).unionByName(rest)


@dataclass
class Found:
    candidates: DataFrame  # id, th, core, context, lo, hi, lead (least of its document's cores): units whose core occurs more than once
    total: int  # how many these are
    contexts: DataFrame  # core, context, many (units), id, th, lo, hi (of the first): each context of these cores
    branching: DataFrame  # those of the contexts whose core has others too, with n, the number of its contexts


def find(rows: DataFrame, shape: Shape, folder: str) -> Found:
    """rows: as from keyed()."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in parts(batch.column(0)):
                core = shape.units(data, offsets)[3]
                yield pa.RecordBatch.from_arrays([pa.array(core.view(np.int64))], names=["core"])

    small_batches(rows.sparkSession)
    every = rows.select("text").mapInArrow(counted, "core long")
    cores = stored(every.groupBy("core").agg(F.count("*").alias("n")).where("n > 1"), f"{folder}/cores")
    many, total = cores.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # Units beyond these that the filter lets through have a core of their own and match nothing.
    table = rows.sparkSession.sparkContext.broadcast(bitmap(cores, "core", _bits(many)))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, th = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for a, _, data, offsets in parts(batch.column(2)):
                row, lo, hi, core, context = shape.units(data, offsets)
                ok = in_bitmap(core, table.value)
                row, core = row[ok], core[ok].view(np.int64)
                lead = np.full(len(offsets) - 1, np.iinfo(np.int64).max)
                np.minimum.at(lead, row, core)
                lead, row = lead[row], row + a
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[row], th[row], core, context[ok].view(np.int64), lo[ok].astype(np.int32), hi[ok].astype(np.int32), lead)], names=["id", "th", "core", "context", "lo", "hi", "lead"])

    units = rows.mapInArrow(placed, "id long, th long, core long, context long, lo int, hi int, lead long")
    candidates = stored(units, f"{folder}/candidates")
    grouped = candidates.groupBy("core", "context").agg(F.count("*").alias("many"), F.min(F.struct("id", "th", "lo", "hi")).alias("f"))
    contexts = stored(grouped.select("core", "context", "many", "f.id", "f.th", "f.lo", "f.hi"), f"{folder}/contexts")
    size = contexts.groupBy("core").agg(F.count("*").alias("n")).where("n > 1")
    return Found(candidates, total, contexts, stored(contexts.join(size, "core"), f"{folder}/branching"))


def with_texts(branching: DataFrame, rows: DataFrame) -> DataFrame:
    """id, th, text, units (core, context, many, lo, hi): each document that is the first of a context, with those."""
    by = branching.groupBy("id", "th").agg(F.collect_list(F.struct("core", "context", "many", "lo", "hi")).alias("units"))  # at most a document's units
    return documents_in(rows, branching).join(by, ["id", "th"]).select("id", "th", "text", "units")


def _blocks(texts: DataFrame, shape: Shape) -> DataFrame:
    """id, th, core, lo, hi, many, ba, bb, windows: stretches of the units' windows, cut at fixed distances from their core.

    ba, bb: a 128-bit hash of what a stretch covers. windows: such hashes of each of its windows.
    """
    step = 4 if shape.words else 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, th, raw = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), (batch.column(2)[i].as_py() or "").encode()
                data = np.frombuffer(raw, np.uint8)
                symbols, _ = shape.symbols(data, np.array([0, len(data)]))
                one, two = Rolling(symbols), Rolling(mix(symbols.astype(np.uint64) + np.uint64(1)), 2)
                anchors = shape.anchors(shape.cores(symbols))
                units = batch.column(3)[i].values
                first, last, many, core = (units.field(x).to_numpy() for x in ("lo", "hi", "many", "core"))
                # Every window of every unit; a stretch ends where the unit does or the distance to its core passes a step.
                sizes = last - first + 1
                unit = np.repeat(np.arange(len(sizes)), sizes)
                every = np.repeat(first, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                stretch = (anchors[first][unit] - every) // step
                new = np.ones(len(every), bool)
                new[1:] = (unit[1:] != unit[:-1]) | (stretch[1:] != stretch[:-1])
                begin = np.flatnonzero(new)
                a, z, unit = every[begin], every[np.append(begin[1:], len(every)) - 1], unit[begin]
                hashes = [pa.array(h.between(every, every + shape.length).view(np.int64)) for h in (one, two)]
                windows = pa.ListArray.from_arrays(pa.array(np.append(begin, len(every)), pa.int32()), pa.StructArray.from_arrays(hashes, ["wa", "wb"]))
                n = len(begin)
                arrays = [pa.array(np.full(n, name)), pa.array(np.full(n, th)), pa.array(core[unit]), pa.array(a, pa.int32()), pa.array(z, pa.int32()), pa.array(many[unit])]
                arrays += [pa.array(h.between(a, z + shape.length).view(np.int64)) for h in (one, two)]
                yield pa.RecordBatch.from_arrays([*arrays, windows], names=["id", "th", "core", "lo", "hi", "many", "ba", "bb", "windows"])

    return texts.mapInArrow(run, "id long, th long, core long, lo int, hi int, many long, ba long, bb long, windows array<struct<wa:bigint,wb:bigint>>")


def _distinct_blocks(branching: DataFrame, rows: DataFrame, shape: Shape, folder: str) -> tuple[DataFrame, DataFrame]:
    """Stretches of these contexts' windows, and the first of each content, with how many there are (n) and stand for (total)."""
    blocks = stored(_blocks(with_texts(branching, rows), shape), f"{folder}/blocks")
    each = blocks.groupBy("ba", "bb").agg(F.count("*").alias("n"), F.sum("many").alias("total"), F.min(F.struct("id", "th", "lo", "hi", "core", "windows")).alias("f"))
    return blocks, stored(each.select("ba", "bb", "n", "total", "f.*"), f"{folder}/distinct-blocks")


def _each_window(blocks: DataFrame) -> DataFrame:
    found = blocks.select("id", "th", "core", "lo", "total", F.posexplode("windows").alias("k", "w"))
    return found.select("id", "th", "core", (F.col("lo") + F.col("k")).alias("at"), "total", "w.wa", "w.wb")


def crowded_windows(crowded: DataFrame, rows: DataFrame, shape: Shape, folder: str) -> DataFrame:
    """id, th, lo, hi: repeated windows of cores with very many contexts, without bringing a core's contexts together.

    Blocks of equal content are settled by their number, as contexts are; then one block of each content brings its
    windows, which are counted in turn. Left out are those of contexts that occur again, which are settled elsewhere.
    """
    blocks, each = _distinct_blocks(crowded, rows, shape, folder)
    windows = _each_window(each)
    twice = windows.groupBy("wa", "wb").agg(F.sum("total").alias("sum")).where("sum > 1").select("wa", "wb")
    settled = blocks.where("many = 1").join(each.where("total > 1").select("ba", "bb"), ["ba", "bb"])
    found = windows.where("total = 1").join(stored(twice, f"{folder}/twice"), ["wa", "wb"])
    return settled.select("id", "th", "lo", "hi").union(found.select("id", "th", F.col("at").alias("lo"), F.col("at").alias("hi")))


def confirmed_passages(found: Found, rows: DataFrame, shape: Shape, folder: str) -> DataFrame:
    """core, context, id, th, lo, hi: first places of passages that occur at several places, by counts over all documents.

    Whole contexts that occur again; and of cores with several contexts (context null here) the stretches, and single
    windows, that several contexts have.
    """
    whole = found.contexts.where("many > 1").select("core", "context", "id", "th", "lo", "hi")
    _, each = _distinct_blocks(found.branching, rows, shape, folder)
    several = each.where("n > 1").select("core", F.lit(None).cast("long").alias("context"), "id", "th", "lo", "hi")
    place = F.struct("id", "th", "at")
    twice = _each_window(each).groupBy("wa", "wb").agg(F.min("core").alias("core"), F.min(place).alias("f"), F.max(place).alias("l")).where("f != l")
    single = twice.select("core", F.lit(None).cast("long").alias("context"), "f.id", "f.th", F.col("f.at").alias("lo"), F.col("f.at").alias("hi"))
    return stored(whole.unionByName(several).unionByName(single), f"{folder}/passages")


def spans(covered: DataFrame) -> DataFrame:
    """id, th, spans: for each document the stretches (lo, hi) of windows found. At most a document's windows."""
    return covered.groupBy("id", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def cover(n: int, stretches: list[dict], length: int) -> np.ndarray:
    """Which of n symbols lie in a window of the stretches."""
    edge = np.zeros(n + 1, np.int32)
    for x in stretches:
        edge[x["lo"]] += 1
        edge[min(n, x["hi"] + length)] -= 1
    return np.cumsum(edge[:n]) > 0


def runs_of(places: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each stretch of consecutive numbers."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) != 1)
    return list(zip(places[np.append(0, cut + 1)].tolist(), places[np.append(cut, len(places) - 1)].tolist()))


def untouched(docs_: DataFrame, finish: Callable, result: str, names: list[str]) -> DataFrame:
    """id, th and the columns `names` of each row of docs_ (keyed), made by finish(raw bytes, [])."""
    import pyspark.sql.types as T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in parts(batch.column(2)):
                raw = data.tobytes()
                made = [finish(raw[offsets[i] : offsets[i + 1]], []) for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *[pa.array(x) for x in zip(*made)]], names=["id", "th", *names])

    return docs_.mapInArrow(run, T.StructType([T.StructField("id", T.LongType()), T.StructField("th", T.LongType()), *T._parse_datatype_string(result)]))


def renewed(every: DataFrame, touched: DataFrame, names: list[str]) -> DataFrame:
    """doc_id and `names` of every document, as touched (id, th and the same names) has them where it has the document."""
    new = touched.select("id", "th", *[F.col(x).alias(f"new_{x}") for x in names]).dropDuplicates(["id", "th"])
    out = every.join(new, ["id", "th"], "left")
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), *[F.coalesce(f"new_{x}", x).alias(x) for x in names])


def removed(docs_: DataFrame, covered: DataFrame, finish: Callable, result: str, names: list[str]) -> DataFrame:
    """One row for each row of docs_ (keyed): its columns `names`, made by finish(raw bytes, stretches or [])."""
    by = spans(covered)
    every = untouched(docs_, finish, result, names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in parts(batch.column(2)):
                raw, lists = data.tobytes(), batch.column(3).slice(a, b - a).to_pylist()
                made = [finish(raw[offsets[i] : offsets[i + 1]], lists[i]) for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *[pa.array(x) for x in zip(*made)]], names=["id", "th", *names])

    touched = documents_in(docs_, by.select("id", "th")).join(by, ["id", "th"]).mapInArrow(cut, every.schema)
    return renewed(every, touched, names)
