"""Token counts of sections by offset-mapped attribution.

Each document is encoded once and whole, so counts of its sections add up to its own. Token character spans are then
interval-joined with the document's sections (both sorted; a binary search per token). A token that crosses a boundary is
allocated by a rule: "start" gives it to the section of its first character, "majority" to the one with most of its
characters (the earlier of equals), "fraction" to each in proportion to its characters.

Sections are given as array<struct<name string, start int, end int>> over the text's code points; they are taken in order
of their starts, those without a start or an end are left out, and sections that overlap, or end before they start, are an
error. Characters outside all sections form the section null. By default each line, with its line feed, is a section
named by its number. Null and empty texts give no rows. Rows that repeat, or repeat an id, give their rows each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches
from .tokens import Encoder, tokenizer_path

RULES = ("start", "majority", "fraction")
RESULT = "doc_id long, section int, name string, n_chars long, n_tokens double, n_crossing long, doc_tokens long"


def line_sections(text: str) -> np.ndarray:
    """Starts of the lines; a line ends before the next one starts."""
    at, out = 0, [0]
    while (at := text.find("\n", at) + 1) and at < len(text):
        out.append(at)
    return np.array(out, np.int64)


def attribute(spans: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section (one more at the end: of none), and how many tokens of each cross its boundary.

    spans: starts and ends of the tokens, ascending. A token's first and last characters are looked up in the sections.
    """
    n = len(starts)
    counts, crossing = np.zeros(n + 1), np.zeros(n + 1, np.int64)
    if not len(spans):
        return counts, crossing
    begin, end = spans[:, 0], np.maximum(spans[:, 1], spans[:, 0] + 1)

    def of(x: np.ndarray) -> np.ndarray:
        k = np.searchsorted(starts, x, "right") - 1
        return np.where((k >= 0) & (x < ends[np.maximum(k, 0)]), k, n) if n else np.full(len(x), n)

    a, b = of(begin), of(end - 1)
    one = (a == b) & ((a < n) | (np.searchsorted(starts, begin, "right") == np.searchsorted(starts, end - 1, "right")))
    counts += np.bincount(a[one], minlength=n + 1)
    for i in np.flatnonzero(~one).tolist():
        chars = of(np.arange(begin[i], end[i]))
        here, first, share = np.unique(chars, return_index=True, return_counts=True)
        crossing[here] += 1
        if rule == "start":
            counts[a[i]] += 1
        elif rule == "majority":
            best = share == share.max()
            counts[here[best][np.argmin(first[best])]] += 1
        else:
            counts[here] += share / share.sum()
    return counts, crossing


def count_tokens(docs: DataFrame, sections: str | None = None, rule: str = "start", path: str | None = None) -> DataFrame:
    """Per document and section: its place, name, characters, tokens, tokens that cross its boundary, and the document's tokens."""
    if rule not in RULES:
        raise ValueError(f"rule: one of {', '.join(RULES)}")
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = Encoder.kept(path).library
        schema = pa.schema([("doc_id", pa.int64()), ("section", pa.int32()), ("name", pa.string()), ("n_chars", pa.int64()), ("n_tokens", pa.float64()), ("n_crossing", pa.int64()), ("doc_tokens", pa.int64())])
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                some = batch.slice(at, 100)
                ids, texts = some.column(0).to_pylist(), [x or "" for x in some.column(1).to_pylist()]
                given = some.column(2).to_pylist() if sections else [None] * len(texts)
                out: list[list] = [[] for _ in schema]
                for doc, text, parts, code in zip(ids, texts, given, library.encode_batch(texts, add_special_tokens=False)):
                    if not text:
                        continue
                    spans = np.array(code.offsets, np.int64).reshape(-1, 2)
                    if sections is None:
                        starts = line_sections(text)
                        ends = np.append(starts[1:], len(text))
                        names = None
                    else:
                        rows = [(x["start"], x["end"], x["name"]) for x in parts or [] if x and x["start"] is not None and x["end"] is not None]
                        rows.sort(key=lambda x: x[:2])
                        if any(a > b for a, b, _ in rows) or any(x[1] > y[0] for x, y in zip(rows, rows[1:])):
                            raise ValueError(f"sections of document {doc} overlap or end before they start")
                        starts, ends, names = np.array([x[0] for x in rows], np.int64), np.array([x[1] for x in rows], np.int64), [x[2] for x in rows]
                    counts, crossing = attribute(spans, starts, ends, rule)
                    k = len(starts)
                    outside = len(text) - int(np.maximum(0, np.minimum(ends, len(text)) - starts).sum()) if k else len(text)
                    last = k + (sections is not None and (outside > 0 or counts[k] > 0))
                    out[0] += [doc] * last
                    out[1] += [*range(k), None][:last] if last <= k else [*range(k), None]
                    out[2] += ([str(i) for i in range(k)] if names is None else names) + [None] * (last - k)
                    out[3] += (ends - starts).tolist() + [outside] * (last - k)
                    out[4] += counts[:last].tolist()
                    out[5] += crossing[:last].tolist()
                    out[6] += [len(spans)] * last
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, schema.types)], schema=schema)

    small_batches(docs.sparkSession)
    picked = [F.col("doc_id").cast("long"), F.col("text").cast("string")] + ([F.col(sections)] if sections else [])
    return docs.select(*picked).mapInArrow(run, RESULT)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
