"""Line dedup by distinct-site spread: lines that many sites carry are boilerplate and leave the documents.

DataFrame functions only. A site is a value of `source`; null is a site of its own. Each task sketches the sites and the
whole texts of its lines by HyperLogLog, a row for each line hash, and the sketches merge by aggregation; so a line that a
third of all rows hold comes to the shuffle once a task. A line is boilerplate if at least MIN_SITES sites carry it, in at
least as many different texts (one page that many sites copy isn't boilerplate by that alone). Lines with an estimate near
the threshold get exact distinct counts.

Lines without a word ([^\\x20\\x09-\\x0D]+) are never removed. Null text stays null; a document that loses all its lines
has an empty text. Rows that repeat, or repeat an id, are kept each; other columns pass through, whatever their names. An
empty table gives no rows. Lines count as equal if their 64-bit hashes are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few, private, shared_folder, stored

MIN_SITES = 8
#: log2 of the sketch's registers; its standard error is 1.04 / 2 ** (LOG_K / 2), 1.6 %, and near means within six of them.
LOG_K, NEAR = 12, 0.1
_WORD = r"[^\x20\x09-\x0D]"


def _lines(docs: DataFrame, *kept: Column) -> DataFrame:
    """A row for each line that has a word: its hash `line` and place `at`, and the columns given."""
    cut = docs.where(F.col("text").isNotNull()).select(*kept, F.posexplode(F.split("text", "\n", -1)).alias("at", "content"))
    return cut.where(F.col("content").rlike(_WORD)).withColumn("line", F.xxhash64("content")).drop("content")


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, folder: str | None = None) -> DataFrame:
    """Hashes `line` of lines that at least min_sites sites carry, in as many different texts."""
    folder = folder or shared_folder(docs.sparkSession)
    site = F.coalesce(F.col("source").cast("string"), F.lit("\0"))
    lines = _lines(docs, site.alias("site"), F.xxhash64("text").alias("whole"))
    sketches = lines.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(LOG_K)).alias("sites"), F.hll_sketch_agg("whole", F.lit(LOG_K)).alias("texts"))
    low, high = min_sites * (1 - NEAR) - 1, min_sites * (1 + NEAR) + 1
    spread = sketches.select("line", F.hll_sketch_estimate("sites").alias("sites"), F.hll_sketch_estimate("texts").alias("texts")).where((F.col("sites") >= low) & (F.col("texts") >= low))
    spread = stored(spread, f"{folder}/spread")
    held = spread.select("line")
    for count, of in (("sites", "site"), ("texts", "whole")):
        near = few(stored(spread.where(F.col(count) <= high).select("line"), f"{folder}/near-{count}"))
        exact = lines.join(near, "line", "left_semi").select("line", of).distinct().groupBy("line").agg(F.count("*").alias("n"))
        sure = spread.where(F.col(count) > high).select("line").unionByName(exact.where(F.col("n") >= min_sites).select("line"))
        held = held.join(sure, "line", "left_semi")
    return stored(held, f"{folder}/boilerplate")


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, copies: int | None = None, report: tuple[str, str] = ("n_lines", "n_removed"), folder: str | None = None) -> DataFrame:
    """docs with boilerplate lines cut from `text`, and columns with the number of lines (with a word) and of those removed.

    copies: if given, a document stays whole where all its lines, or more than half of them and more than `copies`, are
    boilerplate. That is no page with a header and a footer but a near copy of others; cut, only what tells it from these
    would be left, and near-duplicate removal couldn't see it any more. report: names of the two columns; columns of docs
    that have these names are replaced.
    """
    names = [c for c in docs.columns if c.lower() not in {x.lower() for x in report}]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    doc, whole, gone = private([*names, *report], "_doc", "_whole", "_gone")
    key, text_hash = F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("text")
    found = _lines(docs, key.alias(doc), text_hash.alias(whole)).join(few(boilerplate(docs, min_sites, folder)), "line", "left_semi")
    places = found.groupBy(doc, whole).agg(F.collect_set("at").alias(gone))  # at most a document's lines
    rows = docs.withColumns({doc: key, whole: text_hash}).join(places, [doc, whole], "left")
    parts = F.split("text", "\n", -1)
    n = F.coalesce(F.size(F.filter(parts, lambda x: x.rlike(_WORD))), F.lit(0)).cast("long")
    lost = F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long")
    if copies is not None:
        lost = F.when((lost == n) | (lost > copies) & (2 * lost > n), F.lit(0).cast("long")).otherwise(lost)
    rows = rows.withColumns({report[0]: n, report[1]: lost})
    left = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(gone, i)), "\n")
    text = F.when(F.col(report[1]) > 0, left).otherwise(F.col("text")).alias("text")
    return rows.select(*[text if c == "text" else F.col(f"`{c}`") for c in names], *report)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE_SQL = {
    "op7_line_dedup": rf"""
WITH rows AS (SELECT doc_id, text, coalesce(source, chr(0)) AS site, string_split(text, chr(10)) AS parts FROM documents),
cut AS (SELECT doc_id, text, site, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM rows WHERE text IS NOT NULL),
lines AS (SELECT * FROM cut WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
bad AS (SELECT line FROM lines GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES} AND count(DISTINCT text) >= {MIN_SITES}),
marked AS (SELECT c.doc_id, c.text, c.line, c.pos, regexp_matches(c.line, '[^\x20\x09-\x0D]') AS word, b.line IS NOT NULL AS gone FROM cut c LEFT JOIN bad b ON c.line = b.line),
kept AS (
  SELECT doc_id, text, count(*) FILTER (WHERE word) AS n_lines, count(*) FILTER (WHERE gone) AS n, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS rest
  FROM marked GROUP BY doc_id, text)
SELECT d.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n, 0)::BIGINT AS n_removed,
  sha256(CASE WHEN k.n > 0 THEN coalesce(k.rest, '') ELSE coalesce(d.text, '') END) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id AND d.text = k.text
"""
}
