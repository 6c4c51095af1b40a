"""Near-duplicates by one-permutation MinHash.

A document's set is its distinct 5-word shingles (A-Z in lower case). One hash of each shingle gives its bin and its
rank; empty bins borrow by optimal densification (a fixed random order of donor bins for each bin). Bands of bins name
buckets. Documents of equal sets are one node, so copies cost nothing more. In a bucket, candidate links form a star
around its least document: as many links as members, however large the bucket. Where a bucket still holds several
components after that, its members of different components are paired, if they are few, or linked to another centre.
Members of crowded buckets that hold several components even then meet by a prefix filter: of each set, in one order of
all shingles, the first quarter and one more; sets with a similarity of 0.75 share one of these. The order begins with
rare shingles, so a passage that very many documents hold brings those together that hold little else. Every candidate is
confirmed on the full sets, and components are joined in Spark.

With 32 bands of 4 bins a pair of similarity 0.75 shares no bucket with a chance of about 5 in a million.

Null or empty texts have an empty set and are linked with nothing. A row with a null doc_id is linked with nothing, its
component is null and it is kept. Rows that share a doc_id are one node. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, Rolling, dealt, grams, mix, parts, private, shared_folder, small_batches, stored, words
from .graph import components

SHINGLE, PERCENT, BANDS, ROWS = 5, 75, 32, 4
BINS = BANDS * ROWS
#: Buckets of at most so many members are paired in full where stars leave several components.
FEW = 32
#: Members of a centre that are compared in one run.
HUB = 2_000
#: log2 of the slots that count shingles of crowded documents; their order, not what is found, depends on it.
SLOT_BITS = 22
#: Bytes of text, at least, whose shingles a task counts.
TALLY_BYTES = 16 << 20
_EMPTY = np.iinfo(np.uint64).max


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; with fewer than n words, one hash of all of them."""
    low = LOWER[data]
    starts, ends, first = words(low, offsets)
    hashes = Rolling(low).between(starts, ends)
    runs = grams(hashes, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(runs[a : b - n + 1]))
        elif b > a:
            out.append(mix(grams(hashes[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _donors(tries: int = 4096) -> np.ndarray:
    return np.random.default_rng(7).integers(0, BINS, (tries, BINS))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Densified one-permutation signatures: a row of BINS values for each set that isn't empty (else all _EMPTY)."""
    shift = np.uint64(64 - (BINS - 1).bit_length())
    out = np.full((len(sets), BINS), _EMPTY, np.uint64)
    for row, s in zip(out, sets):
        if len(s):
            bins = (s >> shift).astype(np.int64)
            new = np.ones(len(s), bool)
            new[1:] = bins[1:] != bins[:-1]
            row[bins[new]] = s[new]
    base, filled = out != _EMPTY, out.copy()
    rows, bins = np.nonzero(~base & base.any(1, keepdims=True))
    for donor in _donors():
        if not len(rows):
            break
        source = donor[bins]
        hit = base[rows, source]
        filled[rows[hit], bins[hit]] = out[rows[hit], source[hit]]
        rows, bins = rows[~hit], bins[~hit]
    for r, b in zip(rows.tolist(), bins.tolist()):
        filled[r, b] = out[r][base[r]][0]
    return filled


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit bucket name for each band; bands never share names but by chance."""
    cut = signature.reshape(len(signature), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), cut.shape[:2]).copy()
    for i in range(ROWS):
        out = mix(out * np.uint64(0xD1B54A32D192ED03) + cut[:, :, i])
    return out


def described(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, set_a and set_b (a 128-bit name of the set), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in parts(batch.column(2)):
                sets = shingle_sets(data, offsets)
                keys = band_keys(signatures(sets)).astype(np.int64)
                name = np.array([(int(s.sum(dtype=np.uint64)), int(mix(s).sum(dtype=np.uint64))) for s in sets], np.uint64).reshape(-1, 2).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(name[:, 0]), pa.array(name[:, 1]), lists],
                    names=["doc_id", "th", "n_shingles", "set_a", "set_b", "bands"],
                )

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, th long, n_shingles long, set_a long, set_b long, bands array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b of the pairs (a, ath, b, bth) whose full sets have a similarity of PERCENT or more. texts: id, th, text.

    A centre b and its members come to a task as one sorted run, the centre first, so a row has one text and a task holds
    the centre's set and a member's. A centre of many members has several such runs, of about HUB members each.
    """
    near = ["b", "bth", "run"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, held = None, np.zeros(0, np.uint64)
        for batch in batches:
            keys = list(zip(*(c.to_pylist() for c in batch.columns[:3])))
            own = batch.column(3).is_null().to_pylist()
            ok = np.zeros(batch.num_rows, bool)
            for first, _, data, offsets in parts(batch.column(4)):
                for i, s in enumerate(shingle_sets(data, offsets), first):
                    if own[i]:
                        centre, held = keys[i], s
                    elif keys[i] == centre:
                        both = len(np.intersect1d(s, held, assume_unique=True))
                        ok[i] = 100 * both >= PERCENT * (len(s) + len(held) - both) and both > 0
            yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(0)], names=["a", "b"]).filter(pa.array(ok))

    runs = pairs.groupBy("b", "bth").agg(F.ceil(F.count("*") / HUB).cast("int").alias("runs"))
    hubs = runs.where("runs > 1")  # at most one in HUB of the pairs
    which = F.coalesce(F.pmod(F.xxhash64("a", "ath"), F.col("runs")).cast("int"), F.lit(0))
    members = pairs.join(hubs, ["b", "bth"], "left").select("a", "ath", "b", "bth", which.alias("run"))
    members = members.join(texts.select(F.col("id").alias("a"), F.col("th").alias("ath"), "text"), ["a", "ath"])
    centres = runs.join(texts.select(F.col("id").alias("b"), F.col("th").alias("bth"), "text"), ["b", "bth"])
    centres = centres.select("b", "bth", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run"), F.lit(None).cast("long").alias("a"), "text")
    rows = members.select(*near, "a", "text").unionByName(centres)
    rows = dealt(rows, *near).sortWithinPartitions(*near, F.col("a").asc_nulls_first())
    return rows.mapInArrow(run, "a long, b long")


def shingle_tally(texts: DataFrame) -> np.ndarray:
    """How many of the texts hold the shingles of each slot: never less than hold one of its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            for _, _, data, offsets in parts(batch.column(0)):
                for s in shingle_sets(data, offsets):
                    np.add.at(tally, _slots(s), 1)
        slots = np.flatnonzero(tally)
        for at in range(0, len(slots), 100_000):
            some = slots[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(tally[some])], names=["slot", "n"])

    # Tasks of some size count a shingle that many texts have once each.
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = texts.select("text").coalesce(max(1, -(-size // TALLY_BYTES))).mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << SLOT_BITS, np.int64)
    out[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return out


def _slots(s: np.ndarray) -> np.ndarray:
    return (mix(s) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def prefixes(texts: DataFrame) -> DataFrame:
    """shingle, id, th, component, n (shingles of the set), at (place in the order) of each set's prefix. texts: id, th, component, text.

    Shingles that no other set holds are left out.
    """
    held = texts.sparkSession.sparkContext.broadcast(shingle_tally(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = held.value
        for batch in batches:
            for a, b, data, offsets in parts(batch.column(3)):
                found, places, rows, sizes = [], [], [], []
                for i, s in enumerate(shingle_sets(data, offsets)):
                    often = tally[_slots(s)]
                    first = np.lexsort((s, often))[: len(s) * (100 - PERCENT) // 100 + 1]
                    at = np.flatnonzero(often[first] > 1)
                    found.append(s[first[at]])
                    places.append(at)
                    rows.append(np.full(len(at), a + i))
                    sizes.append(np.full(len(at), len(s)))
                rows = pa.array(np.concatenate(rows))
                columns = [pa.array(np.concatenate(found).astype(np.int64)), *[c.take(rows) for c in batch.columns[:3]], pa.array(np.concatenate(sizes)), pa.array(np.concatenate(places))]
                yield pa.RecordBatch.from_arrays(columns, names=["shingle", "id", "th", "component", "n", "at"])

    return texts.select("id", "th", "component", "text").mapInArrow(run, "shingle long, id long, th long, component long, n long, at long")


def prefix_pairs(texts: DataFrame, folder: str) -> DataFrame:
    """Pairs (a, ath, b, bth) of different components: all that can have a similarity of PERCENT or more, and some others."""
    rows = stored(prefixes(texts), f"{folder}/prefixes")
    # Where one component has most of a shingle's sets, these are never paired with each other.
    each = rows.groupBy("shingle", "component").agg(F.count("*").alias("n"))
    main = each.groupBy("shingle").agg(F.count("*").alias("k"), F.max(F.struct("n", "component"))["component"].alias("main")).where("k > 1")
    mixed = stored(rows.join(main.select("shingle", "main"), "shingle"), f"{folder}/mixed")
    left = mixed.where("component != main").select("shingle", F.col("id").alias("a"), F.col("th").alias("ath"), F.col("component").alias("ca"), F.col("n").alias("na"), F.col("at").alias("pa"))
    right = mixed.select("shingle", F.col("id").alias("b"), F.col("th").alias("bth"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("at").alias("pb"), (F.col("component") == F.col("main")).alias("lead"))
    # At their first common shingle two sets can't share more than what is left of either.
    shared = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    enough = (100 + PERCENT) * shared >= PERCENT * (F.col("na") + F.col("nb"))
    pairs = left.join(right, "shingle").where((F.col("ca") != F.col("cb")) & (F.col("lead") | (F.col("a") > F.col("b"))) & enough)
    return pairs.select("a", "ath", "b", "bth").distinct()


def near_duplicates(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    folder = folder or shared_folder(docs.sparkSession)
    rows = stored(described(docs), f"{folder}/described")
    real = rows.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    name = ["set_a", "set_b", "n_shingles"]
    nodes = stored(real.groupBy(*name).agg(F.min(F.struct("doc_id", "th", "bands")).alias("n")).select(*name, F.col("n.doc_id").alias("id"), F.col("n.th").alias("th"), F.col("n.bands").alias("bands")), f"{folder}/nodes")

    cut = nodes.select("id", "th", F.explode("bands").alias("bucket"))
    centres = cut.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.struct("id", "th")).alias("c")).where("n > 1")
    centres = stored(centres.select("bucket", "n", F.col("c.id").alias("b"), F.col("c.th").alias("bth")), f"{folder}/centres")
    members = stored(cut.join(centres, "bucket"), f"{folder}/members")
    pairs = stored(members.select(F.col("id").alias("a"), F.col("th").alias("ath"), "b", "bth").where("a != b").distinct(), f"{folder}/pairs0")
    sought = members.select("id", "th").distinct()
    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("th"), F.col("text").cast("string"))
    texts = stored(texts.join(sought, ["id", "th"], "left_semi").dropDuplicates(["id", "th"]), f"{folder}/texts")

    # Documents of equal sets are links too, known already.
    copies = rows.select("doc_id", *name).join(nodes.select(*name, "id"), name).select(F.col("doc_id").alias("a"), F.col("id").alias("b")).where("a != b").distinct()
    links = stored(confirmed(pairs, texts), f"{folder}/links0")
    found = stored(components(links, f"{folder}/components0"), f"{folder}/labels0")
    own = members.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    own = stored(own.select("bucket", "n", "id", "th", "component"), f"{folder}/own1")
    split = own.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min(F.struct(F.xxhash64("id", F.lit(1)), "id", "th", "component")).alias("c")).where("low != high")
    split = stored(split.select("bucket", F.col("c.id").alias("b"), F.col("c.th").alias("bth"), F.col("c.component").alias("of")), f"{folder}/split1")
    open_ = own.join(split, "bucket")
    star = open_.where((F.col("n") > FEW) & (F.col("component") != F.col("of"))).select(F.col("id").alias("a"), F.col("th").alias("ath"), "b", "bth")
    few = stored(open_.where(F.col("n") <= FEW).select("bucket", "id", "th", "component"), f"{folder}/few1")
    left, right = few.select("bucket", F.col("id").alias("a"), F.col("th").alias("ath"), F.col("component").alias("ca")), few.select("bucket", F.col("id").alias("b"), F.col("th").alias("bth"), F.col("component").alias("cb"))
    mixed = left.join(right, "bucket").where((F.col("a") > F.col("b")) & (F.col("ca") != F.col("cb"))).drop("bucket", "ca", "cb")

    def untested(some: DataFrame, tested: DataFrame) -> DataFrame:
        # A star around another centre may name a pair the other way round.
        return some.join(tested.union(tested.select("b", "bth", "a", "ath")), ["a", "ath", "b", "bth"], "left_anti")

    def joined(more: DataFrame, i: int) -> DataFrame:
        known = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
        return stored(components(known.union(more), f"{folder}/components{i}"), f"{folder}/labels{i}")

    fresh = stored(untested(star.union(mixed.select("a", "ath", "b", "bth")).distinct(), pairs), f"{folder}/pairs1")
    more = stored(confirmed(fresh, texts), f"{folder}/links1")
    if not more.isEmpty():
        links, found = links.union(more), joined(more, 1)
    # Few members are paired in full by now; crowded buckets that still hold several components are searched exactly.
    crowded = own.where(F.col("n") > FEW).drop("component").join(split.select("bucket"), "bucket", "left_semi").join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    crowded = stored(crowded.select("bucket", "id", "th", "component"), f"{folder}/crowded")
    several = crowded.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("bucket")
    sought = stored(crowded.join(several, "bucket", "left_semi").select("id", "th", "component").distinct(), f"{folder}/sought")
    if not sought.isEmpty():
        wanted = stored(texts.join(sought, ["id", "th"]), f"{folder}/wanted")
        last = stored(untested(prefix_pairs(wanted, folder), pairs.union(fresh)), f"{folder}/pairs2")
        more = stored(confirmed(last, texts), f"{folder}/links2")
        if not more.isEmpty():
            links, found = links.union(more), joined(more, 2)
    # Of each node's component; a copy has that of its node. An id whose rows have different texts ties their components.
    doubled = real.groupBy("doc_id").agg(F.min("set_a").alias("x"), F.max("set_a").alias("y")).where("x != y").limit(1)
    if not doubled.isEmpty():
        found = stored(components(links.union(copies), f"{folder}/tied"), f"{folder}/labels-tied")
        out = rows.join(found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("id", F.col("doc_id"))
    else:
        labels = nodes.select(*name, "id").join(found.select(F.col("node").alias("id"), "component"), "id", "left")
        labels = stored(labels, f"{folder}/named")
        out = rows.join(labels, name, "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "id"))
    return out.select("doc_id", "th", "n_shingles", component.cast("long").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))).drop("th")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs less the rows that near_duplicates doesn't keep. Rows without an id stay."""
    (name,) = private(docs.columns, "_gone")
    gone = near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = {
    "op8_minhash": r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents WHERE text IS NOT NULL),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM cut),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
items AS (SELECT doc_id, unnest(s) AS item FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM items a JOIN items b ON a.item = b.item AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(l.b, d.doc_id)) AS component_id, least(d.doc_id, coalesce(l.b, d.doc_id)) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.a = d.doc_id
"""
}
