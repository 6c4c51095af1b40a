"""Quality rules with n-gram perplexity.

An interpolated modified Kneser-Ney model of byte n-grams (orders 1 to 4), one for each language, is counted over all
documents: tasks count their own n-grams, Spark adds them up, and continuation counts, discounts and back-off weights are
aggregates and joins over the distinct n-grams. The model is stored in sorted hash arrays: a bijective 64-bit hash of
language, order and n-gram as the key, so no two n-grams share an entry, and its log probability; and the same for contexts
and the logarithm of their back-off weights. A text's n-grams are looked up by binary search, each distinct one once for a
slice of texts; one that was never counted backs off to shorter ones.

Arrays of more than SHARD_ENTRIES entries are cut into shards by language and the byte before the last of an n-gram, on
which all its lookups depend; each shard is broadcast for its own pass over the documents and scores the bytes that are
its own, and the sums are added up.

A document's perplexity is per byte. For each language, the quartiles of the log perplexity over all documents that pass
the base rules give a band, `reach` interquartile ranges beyond the quartiles (and at least MARGIN); what lies outside,
above or below, is rejected. Three ranges are Tukey's outer fences, beyond which he calls values far out.

Null texts have no words; they and empty texts have a null perplexity and fail the base rules. A null lang is a language
of its own. Rows that repeat, or repeat an id, are each scored (and counted); other columns are ignored. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few, mix, parts, shared_folder, small_batches, stored

ORDER, REACH, MARGIN = 4, 3.0, 0.1
#: Entries of the arrays that a pass broadcasts, 12 bytes each.
SHARD_ENTRIES = 4_000_000
LEAST_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = "#*$%&|<>"


def _codes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The n-gram that ends at each byte; before a text stand zeros."""
    sizes = np.diff(offsets)
    begin = np.repeat(offsets[:-1], sizes)
    place = np.arange(len(data)) - begin
    out = data.astype(np.uint32)
    for back in range(1, ORDER):
        earlier = np.zeros(len(data), np.uint32)
        earlier[back:] = data[:-back] if back < len(data) else 0
        earlier[place < back] = 0
        out |= earlier << np.uint32(8 * back)
    return out


def ngram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram (ORDER bytes as a number), n: how often each occurs in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        keys, counts, size = [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            return k, np.bincount(inverse, np.concatenate(counts)).astype(np.int64)

        def rows(k: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            by = list(names)
            for at in range(0, len(k), 100_000):
                some = k[at : at + 100_000]
                lang = pa.DictionaryArray.from_arrays(pa.array((some >> np.uint64(32)).astype(np.int32)), pa.array(by, pa.string())).cast(pa.string())
                yield pa.RecordBatch.from_arrays([lang, pa.array((some & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n[at : at + 100_000])], names=["lang", "gram", "n"])

        for batch in batches:
            lang = np.array([names.setdefault(x, len(names)) for x in batch.column(0).to_pylist()], np.uint64)
            for a, b, data, offsets in parts(batch.column(1)):
                if not len(data):
                    continue
                sizes = np.diff(offsets)
                key = _codes(data, offsets).astype(np.uint64) | (np.repeat(lang[a:b], sizes) << np.uint64(32))
                k, n = np.unique(key, return_counts=True)
                keys.append(k)
                counts.append(n)
                size += len(k)
                if size > 2_000_000:
                    k, n = merged()
                    if len(k) > 1_000_000:
                        yield from rows(k, n)
                        keys, counts, size = [], [], 0
                    else:
                        keys, counts, size = [k], [n], len(k)
        if keys:
            yield from rows(*merged())

    small_batches(docs.sparkSession)
    cut = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").cast("string"))
    return cut.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def kneser_ney(grams: DataFrame, folder: str) -> DataFrame:
    """lang, order, gram, p, spared: interpolated modified Kneser-Ney probability of each n-gram's last byte after the others,
    and the back-off weight of the n-gram as a context (null where nothing follows it, as for the highest order).

    grams: a stored table of ngram_counts. Below the highest order a count is the number of distinct bytes before the
    n-gram. Where a count of counts is zero the discount is a half. The context of order 0 is the n-gram 0 of order 0.
    """
    orders = {ORDER: grams.select("lang", "gram", F.col("n").alias("c"))}
    for k in range(ORDER - 1, 0, -1):
        made = orders[k + 1].groupBy("lang", (F.col("gram") % (1 << 8 * k)).alias("gram")).agg(F.count("*").alias("c"))
        orders[k] = stored(made, f"{folder}/order-{k}")
    tally = [F.count(F.when(F.col("c") == i, 1)).alias(f"t{i}") for i in (1, 2, 3, 4)]
    t = None
    for k, of in orders.items():
        one = of.groupBy("lang").agg(*tally).withColumn("order", F.lit(k))
        t = one if t is None else t.unionByName(one)
    y = F.try_divide("t1", F.col("t1") + 2 * F.col("t2"))
    raw = [F.lit(float(i)) - (i + 1) * y * F.try_divide(f"t{i + 1}", f"t{i}") for i in (1, 2, 3)]
    d = [F.when(x.isNotNull(), F.greatest(F.lit(0.0), x)).otherwise(0.5).alias(f"d{i + 1}") for i, x in enumerate(raw)]
    discounts = few(stored(t.select("lang", "order", *d), f"{folder}/discounts"))  # a row for each language and order
    lower, out, contexts = None, None, None
    for k in range(1, ORDER + 1):
        context = (F.col("gram") / 256).cast("long") if k > 1 else F.lit(0).cast("long")
        of = orders[k].withColumn("context", context)
        around = of.groupBy("lang", "context").agg(F.sum("c").alias("total"), *[F.count(F.when(F.col("c") == i, 1)).alias(f"m{i}") for i in (1, 2)], F.count(F.when(F.col("c") >= 3, 1)).alias("m3"))
        around = around.join(discounts.where(F.col("order") == k).drop("order"), "lang")
        around = around.withColumn("spared", (F.col("d1") * F.col("m1") + F.col("d2") * F.col("m2") + F.col("d3") * F.col("m3")) / F.col("total"))
        off = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        joined = of.join(around, ["lang", "context"]).withColumn("own", F.greatest(F.lit(0.0), F.col("c") - off) / F.col("total"))
        if lower is None:
            lower = joined.select("lang", "gram", (F.col("own") + F.col("spared") / 256).alias("p"))
        else:
            under = lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("under"))
            joined = joined.withColumn("suffix", F.col("gram") % (1 << 8 * (k - 1))).join(under, ["lang", "suffix"])
            lower = joined.select("lang", "gram", (F.col("own") + F.col("spared") * F.col("under")).alias("p"))
        lower = stored(lower, f"{folder}/model-{k}")
        each = lower.withColumn("order", F.lit(k))
        out = each if out is None else out.unionByName(each)
        weights = around.select("lang", F.col("context").alias("gram"), "spared", F.lit(k - 1).alias("order"))
        contexts = weights if contexts is None else contexts.unionByName(weights)
    return stored(out.join(contexts, ["lang", "order", "gram"], "full").select("lang", "order", "gram", "p", "spared"), f"{folder}/model")


def _keys(lang: np.ndarray, order: int | np.ndarray, gram: np.ndarray) -> np.ndarray:
    """A bijective hash of (number of a language, order, n-gram)."""
    return mix((lang.astype(np.uint64) << np.uint64(35)) | (np.asarray(order).astype(np.uint64) << np.uint64(32)) | gram.astype(np.uint64))


def _shard(lang: np.ndarray, byte: np.ndarray, shards: int) -> np.ndarray:
    return (mix((lang.astype(np.uint64) << np.uint64(8)) | byte.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)


class HashArrays:
    """One shard of a model: sorted keys with log probabilities, and sorted keys of contexts with logarithms of back-off weights."""

    def __init__(self, languages: dict[str, int], p: tuple[np.ndarray, np.ndarray], spared: tuple[np.ndarray, np.ndarray], shard: int = 0, shards: int = 1):
        self.languages, self.p, self.spared, self.shard, self.shards = languages, p, spared, shard, shards

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether a key is there, its value or 0)"""
        if not len(table[0]):
            return np.zeros(len(keys), bool), np.zeros(len(keys))
        at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
        there = table[0][at] == keys
        return there, np.where(there, table[1][at], 0.0)

    def log_p(self, lang: np.ndarray, gram: np.ndarray) -> np.ndarray:
        """Log probability of the last byte of each n-gram of the highest order, 0 for those of other shards."""
        out = np.zeros(len(gram))
        open_ = np.flatnonzero(_shard(lang, (gram >> np.uint64(8)) & np.uint64(255), self.shards) == self.shard)
        for k in range(ORDER, 0, -1):
            own = gram[open_] & np.uint64((1 << 8 * k) - 1)
            there, value = self._find(self.p, _keys(lang[open_], k, own))
            out[open_] += value
            open_, own = open_[~there], own[~there]
            if not len(open_):
                return out
            out[open_] += self._find(self.spared, _keys(lang[open_], k - 1, own >> np.uint64(8)))[1]
        out[open_] += np.log(1 / 256)
        return out


def hash_arrays(model: DataFrame, most: int | None = None) -> Iterator[HashArrays]:
    """The shards of a stored model, one after another."""
    names = sorted(r["lang"] for r in model.select("lang").distinct().collect())  # the languages
    languages = {x: i for i, x in enumerate(names)}
    shards = max(1, -(-model.count() // (most or SHARD_ENTRIES)))

    @F.arrow_udf("struct<p:int,spared:int,lang:int>")
    def placed(lang: pa.Array, order: pa.Array, gram: pa.Array) -> pa.Array:
        """The shards that need an entry's probability (-1: all) and its back-off weight, and its language's number."""
        code = np.array([languages[x] for x in lang.to_pylist()], np.int64)
        g, k = gram.to_numpy(zero_copy_only=False).astype(np.uint64), order.to_numpy(zero_copy_only=False)
        p = np.where(k > 1, _shard(code, (g >> np.uint64(8)) & np.uint64(255), shards), -1)
        spared = np.where(k > 0, _shard(code, g & np.uint64(255), shards), -1)
        return pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (p, spared, code)], ["p", "spared", "lang"])

    rows = model.withColumn("shard", placed("lang", "order", "gram"))
    for shard in range(shards):
        tables = []
        for value in ("p", "spared"):
            t = rows.where(F.col(value).isNotNull() & F.col(f"shard.{value}").isin(shard, -1)).select("shard.lang", "order", "gram", F.log(value).cast("float").alias("v")).toArrow()
            key = _keys(t.column("lang").to_numpy(), t.column("order").to_numpy(), t.column("gram").to_numpy())
            by = np.argsort(key)
            tables.append((key[by], t.column("v").to_numpy()[by]))
        yield HashArrays(languages, tables[0], tables[1], shard, shards)


def text_counts(raw: bytes, text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    found = raw.split()  # bytes.split() parts at exactly the space and the characters 9 to 13
    n = len(found)
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(text.count, SYMBOLS))
    lines, dup = set(), 0
    for x in raw.split(b"\n"):
        if x in lines:
            dup += bool(x.split())
        else:
            lines.add(x)
    repeated = 0
    if n >= 4:
        ids: dict[bytes, int] = {}
        code = np.array([ids.setdefault(x, len(ids)) for x in found], np.int64)
        k = len(ids)
        if k < 2_000_000:
            window = (code[:-2] * k + code[1:-1]) * k + code[2:]
        else:
            _, window = np.unique(code[:-2] * k + code[1:-1], return_inverse=True)
            window = window * k + code[2:]
        if k < n:  # else no word comes twice
            order = np.argsort(window, kind="stable")
            same = np.diff(window[order]) == 0
            often = np.zeros(len(window), bool)
            often[order[1:][same]] = True
            often[order[:-1][same]] = True
            cover = np.zeros(n, bool)
            for i in range(3):
                cover[i : n - 2 + i] |= often
            repeated = int(cover.sum())
    return n, chars, symbols, dup, repeated


SCORED = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, log_perplexity double"


def scored(docs: DataFrame, arrays: HashArrays) -> DataFrame:
    """Base counts, and the log perplexity as far as this shard of the model has it."""
    held = docs.sparkSession.sparkContext.broadcast(arrays)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = held.value
        schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), *[(x, pa.int64()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], ("base_failed", pa.bool_()), ("log_perplexity", pa.float64())])
        for batch in batches:
            lang = np.array([arrays.languages.get(x, len(arrays.languages)) for x in batch.column(1).to_pylist()], np.uint64)
            for a, b, data, offsets in parts(batch.column(2)):
                sizes = np.diff(offsets)
                key = _codes(data, offsets).astype(np.uint64) | (np.repeat(lang[a:b], sizes) << np.uint64(32))
                code, distinct = pd.factorize(key)
                value = arrays.log_p(distinct >> np.uint64(32), distinct & np.uint64(0xFFFFFFFF))
                sums = np.zeros(len(data) + 1)
                np.cumsum(value[code], out=sums[1:])
                loss = -(sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(sizes, 1)
                texts = batch.column(2).slice(a, b - a).to_pylist()
                raw = data.tobytes()
                counts = [text_counts(raw[offsets[i] : offsets[i + 1]], texts[i] or "") if arrays.shard == 0 else (0,) * 5 for i in range(b - a)]
                failed = [c[0] < LEAST_WORDS or 100 * c[4] > MOST_REPEATED * c[0] for c in counts]
                out = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *[pa.array(x, pa.int64()) for x in zip(*counts)], pa.array(failed), pa.array([x if n else None for x, n in zip(loss.tolist(), sizes.tolist())], pa.float64())]
                yield pa.RecordBatch.from_arrays(out, schema=schema)

    cut = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").cast("string"))
    return cut.mapInArrow(run, SCORED)


def _scored_by_all(docs: DataFrame, shards: Iterator[HashArrays], folder: str) -> DataFrame:
    """Scores of every document: each shard's pass gives a part of the sum. Rows are told apart by a number of their own."""
    first = next(shards)
    if first.shards == 1:
        return stored(scored(docs, first), f"{folder}/scored")
    cut = stored(docs.select(F.monotonically_increasing_id().alias("doc_id"), F.col("doc_id").cast("long").alias("own"), "lang", "text"), f"{folder}/numbered")
    out = stored(scored(cut, first), f"{folder}/scored-0")
    for arrays in shards:
        more = scored(cut, arrays).select("doc_id", F.col("log_perplexity").alias("more"))
        out = stored(out.join(more, "doc_id").withColumn("log_perplexity", F.col("log_perplexity") + F.col("more")).drop("more"), f"{folder}/scored-{arrays.shard}")
    return out.join(cut.select("doc_id", "own"), "doc_id").withColumn("doc_id", F.col("own")).drop("own")


def quality(docs: DataFrame, reach: float = REACH, folder: str | None = None) -> DataFrame:
    """Per document the base counts, base_failed, its log perplexity, its language's band and kept."""
    folder = folder or shared_folder(docs.sparkSession)
    grams = stored(ngram_counts(docs), f"{folder}/grams")
    rows = _scored_by_all(docs, hash_arrays(kneser_ney(grams, folder)), folder)
    q = F.percentile_approx("log_perplexity", F.array(F.lit(0.25), F.lit(0.75)), 10000)
    bands = rows.where(~F.col("base_failed")).groupBy("lang").agg(q.alias("q"))
    width = F.greatest(F.lit(MARGIN), reach * (F.col("q")[1] - F.col("q")[0]))
    bands = stored(bands.select("lang", (F.col("q")[0] - width).alias("lower"), (F.col("q")[1] + width).alias("upper")), f"{folder}/bands")
    inside = F.coalesce(F.col("log_perplexity").between(F.col("lower"), F.col("upper")), F.lit(False))
    return rows.join(few(bands), "lang", "left").withColumn("kept", ~F.col("base_failed") & inside)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.exp("log_perplexity").alias("perplexity"), F.exp("lower").alias("lower"), F.exp("upper").alias("upper"))
