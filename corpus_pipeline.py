"""The corpus pipeline: language identification, line dedup, near-dedup, decontamination and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's documents. All but the last return the columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm import decontaminate, langid, linededup, minhash, packing
from terrace.llm.common import private, shared_folder, stored

#: Rows that score less are rejected with those of unknown language. Clean short texts score 0.35 and more.
LEAST_SCORE = 0.25
#: A page's header and footer have at most so many lines; a document of more cross-site lines than others is a near copy.
BLOCK_LINES = 4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; null texts and texts without a letter go. Rows that repeat stay or go together."""
    return langid.keep_identified(docs, least=LEAST_SCORE)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site boilerplate lines; a document that loses a line has n_chars anew.

    Near copies stay whole for the next stage, which could no longer tell what they have in common. Null texts stay null.
    """
    n, removed = private(docs.columns, "_n_lines", "_n_removed")
    out = linededup.dedup_lines(docs, copies=BLOCK_LINES, report=(n, removed))
    size = F.when(F.col(removed) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return out.select(*[size.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group of near-duplicates. Of rows that repeat an id all stay or go;
    rows without an id or without a word stay."""
    return minhash.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Rows without an id, which can't be named, stay; null items match nothing."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens; null texts are empty, and rows that repeat are packed each."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", dedup_near),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

#: SQL can't express the string kernels or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    folder = shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"{folder}/{i}-{name}")
    return docs
