"""Substring dedup of words by repeated-phrase automata.

A window is 20 consecutive words of one document; each word goes that lies in a window which also starts earlier (in a
document of smaller id, or earlier in its own). Spark confirms recurring passages by counts over all documents (see
repeats): whole contexts of a core that occur again, and stretches and single windows that several contexts share. Of each
the first place is known. Of documents with the same whole text (by 128 bits) the first takes part for all of them.

Documents are dealt over blocks by the least hash of what they may share with others, so that copies tend to meet, and
groups of more than COPIES documents are parted. A passage goes to the blocks that hold a unit with its core, in a task with
their documents; there an Aho-Corasick automaton over word numbers is compiled from the block's passages (several, one
after another, where they are very many), and the whole text of every document with such a unit streams through it. Each
occurrence that comes after the passage's first place is removed. A passage that all documents hold is in every block's
automaton, once; the work grows with the text, not with its square.

Words are [^\\x20\\x09-\\x0D]+, unchanged; null texts have none. Rows of one doc_id with different texts are in order of
their text's hash; equal rows are one document, so neither removes words of the other. A null doc_id comes before all
others. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dealt, few, shared_folder, stored
from .repeats import Found, Shape, confirmed_passages, documents_in, find, keyed, renewed, untouched

LENGTH, CORE = 20, 8
#: Units with a repeated core that a block has, about; and words of the passages in one automaton.
BLOCK, AUTOMATON_WORDS = 40_000, 1_000_000
#: Documents of one least hash that share a block.
COPIES = 500


def passage_texts(places: DataFrame, rows: DataFrame, shape: Shape) -> DataFrame:
    """core, context, id, th, lo, passage: the words of each passage, parted by spaces, from the document of its first place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, th = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                found = (batch.column(2)[i].as_py() or "").encode().split()
                units = batch.column(3)[i].as_py()
                cut = [b" ".join(found[u["lo"] : u["hi"] + shape.length]) for u in units]
                arrays = [pa.array([u["core"] for u in units], pa.int64()), pa.array([u["context"] for u in units], pa.int64()), pa.array([name] * len(units), pa.int64()), pa.array([th] * len(units), pa.int64()), pa.array([u["lo"] for u in units], pa.int32()), pa.array(cut, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["core", "context", "id", "th", "lo", "passage"])

    by = places.groupBy("id", "th").agg(F.collect_list(F.struct("core", "context", "lo", "hi")).alias("units"))  # of one document
    texts = documents_in(rows, places).dropDuplicates(["id", "th"]).join(by, ["id", "th"]).select("id", "th", "text", "units")
    return texts.mapInArrow(run, "core long, context long, id long, th long, lo int, passage binary")


def compiled(passages: dict[bytes, tuple[int, int, int]], most: int) -> Iterator[tuple[dict[bytes, int], object]]:
    """Word numbers and automaton of the passages, each with its first place; several where they have very many words."""
    import ahocorasick

    numbers: dict[bytes, int] = {}
    automaton, size = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE), 0
    for passage, place in passages.items():
        key = tuple(numbers.setdefault(w, len(numbers) + 1) for w in passage.split())
        automaton.add_word(key, (len(key), place))
        size += len(key)
        if size > most:
            automaton.make_automaton()
            yield numbers, automaton
            numbers, automaton, size = {}, ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE), 0
    if size:
        automaton.make_automaton()
        yield numbers, automaton


def later(words: list[bytes], place: tuple[int, int], machines: list, length: int) -> list[tuple[int, int]]:
    """First and last windows of the passages in a document's words that also start earlier."""
    out = []
    for numbers, automaton in machines:
        number = numbers.get
        for end, (n, first) in automaton.iter(tuple([number(w, 0) for w in words])):  # 0 is in no passage
            at = end - n + 1
            if place > first[:2] or place == first[:2] and at > first[2]:
                out.append((at, at + n - length))
    return out


def streamed(docs: DataFrame, passages: DataFrame, finish, result: str, names: list[str], length: int, most: int) -> DataFrame:
    """id, th and `names` of the documents (block, id, th, text), with what the passages (block, id, th, lo, passage) remove.

    A block's passages come first, then its documents, a row at a time.
    """
    import pyspark.sql.types as T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, known, machines = None, {}, None
        for batch in batches:
            out: list[tuple] = []
            blocks, ids, ths, los, texts = (batch.column(i).to_pylist() for i in range(5))
            for i in range(batch.num_rows):
                if blocks[i] != block:
                    block, known, machines = blocks[i], {}, None
                if los[i] is not None:
                    passage, place = texts[i], (ids[i], ths[i], los[i])
                    if place < known.get(passage, (np.inf,)):
                        known[passage] = place
                    continue
                if machines is None:
                    machines, known = list(compiled(known, most)), {}
                found = texts[i].split()
                out.append((ids[i], ths[i], *finish(found, later(found, (ids[i], ths[i]), machines, length))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["id", "th", *names])

    kinds = T.StructType([T.StructField("id", T.LongType()), T.StructField("th", T.LongType()), *T._parse_datatype_string(result)])
    texts = docs.select("block", "id", "th", F.lit(None).cast("int").alias("lo"), F.coalesce("text", F.lit("")).cast("binary").alias("passage"))
    both = passages.select("block", "id", "th", "lo", "passage").unionByName(texts)
    return dealt(both, "block").sortWithinPartitions("block", F.col("lo").asc_nulls_last()).mapInArrow(run, kinds)


RESULT = "n_words long, n_removed long, kept_sha256 string"


def dedup_phrases(docs: DataFrame, length: int = LENGTH, core: int = CORE, folder: str | None = None, block: int = BLOCK, automaton_words: int = AUTOMATON_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256."""
    folder = folder or shared_folder(docs.sparkSession)
    rows, shape, names = keyed(docs), Shape(length, core, words=True), [x.split()[0] for x in RESULT.split(", ")]

    def kept(found: list[bytes], stretches: list[tuple[int, int]]) -> tuple:
        n = len(found)
        if stretches:
            edge = np.zeros(n + 1, np.int32)
            lo, hi = np.array(stretches).T
            np.add.at(edge, lo, 1)
            np.add.at(edge, hi + length, -1)
            found = [w for w, deep in zip(found, np.cumsum(edge[:n]).tolist()) if not deep]
        return n, n - len(found), hashlib.sha256(b" ".join(found)).hexdigest()

    every = untouched(rows, lambda raw, _: kept(raw.split(), []), RESULT, names)
    # Of documents with one text the first is searched for all: every word of the others starts earlier, if there is a window.
    texts = rows.select("id", "th", F.xxhash64(F.lit(1), "text").alias("too"))
    firsts = texts.groupBy("th", "too").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first != last")
    copies = few(stored(texts.join(firsts, ["th", "too"]).where("id != first").select("id", "th").distinct(), f"{folder}/copies"))
    whole = F.col("copy") & (F.col("n_words") >= length)
    every = every.join(copies.withColumn("copy", F.lit(True)), ["id", "th"], "left")
    every = every.withColumns({"n_removed": F.when(whole, F.col("n_words")).otherwise(F.col("n_removed")), "kept_sha256": F.when(whole, F.lit(hashlib.sha256().hexdigest())).otherwise(F.col("kept_sha256"))}).drop("copy")
    rows = rows.join(copies, ["id", "th"], "left_anti")
    found: Found = find(rows, shape, folder)
    places = confirmed_passages(found, rows, shape, folder)
    passages = stored(passage_texts(places, rows, shape), f"{folder}/passage-texts")
    blocks = max(1, -(-found.total // block))
    leads = found.candidates.where("core = lead").groupBy("lead").agg(F.count("*").alias("n")).where(F.col("n") > COPIES)
    leads = few(stored(leads, f"{folder}/leads"))  # at most one in COPIES of the documents
    parted = F.coalesce(F.pmod(F.xxhash64("id", "th"), F.ceil(F.col("n") / COPIES)), F.lit(0))
    placed = found.candidates.join(leads, "lead", "left").withColumn("block", F.pmod(F.xxhash64("lead", parted), F.lit(blocks)))
    # Which blocks have a unit of a passage's core, or of its context where the passage is a whole one.
    seats = placed.select("core", "context", "block").distinct()
    whole = passages.where("context IS NOT NULL").join(seats, ["core", "context"])
    part = passages.where("context IS NULL").drop("context").join(seats.select("core", "block").distinct(), "core")
    routed = whole.select("block", "id", "th", "lo", "passage").unionByName(part.select("block", "id", "th", "lo", "passage"))
    # Documents with a unit whose core has a passage; the others hold none.
    holders = stored(placed.join(places.select("core").distinct(), "core", "left_semi").select("id", "th", "block").distinct(), f"{folder}/holders")
    texts = documents_in(rows, holders).join(holders, ["id", "th"]).select("block", "id", "th", "text")
    return renewed(every, streamed(texts, routed, kept, RESULT, names, length, automaton_words), names)


def op10_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_phrases(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = {
    "op10_phrase_dedup": r"""
WITH cut AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS at0, unnest(list_transform(range(1, len(w) - 18), lambda i: array_to_string(list_slice(w, i, i + 19), ' '))) AS x FROM cut WHERE len(w) >= 20),
ranked AS (SELECT doc_id, at0, row_number() OVER (PARTITION BY x ORDER BY doc_id, at0) AS k FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(range(at0, at0 + 20)) AS place FROM ranked WHERE k > 1),
items AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM cut),
kept AS (
  SELECT i.doc_id, count(*) AS n_words, count(g.place) AS n_removed, string_agg(i.word, ' ' ORDER BY i.place) FILTER (WHERE g.place IS NULL) AS rest
  FROM items i LEFT JOIN gone g ON g.doc_id = i.doc_id AND g.place = i.place GROUP BY i.doc_id)
SELECT c.doc_id, coalesce(k.n_words, 0)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.rest, '')) AS kept_sha256
FROM cut c LEFT JOIN kept k ON k.doc_id = c.doc_id
"""
}
