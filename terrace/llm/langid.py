"""Language identification by string kernels.

The kernel of two texts is a blended spectrum of byte n-grams of 1 to 4 bytes (A-Z in lower case), by presence: the number
of n-grams that both hold over the geometric mean of the numbers that each holds. Nyström landmarks, texts of every
language, span the feature space: a text is described by its kernels with the landmarks. One ridge regression for each
language against the rest is solved over these features; a batch of texts is scored by matrix products.

The model is fitted on the driver on a bounded sample of labelled rows, whole texts each: about SAMPLE rows of every
language and SAMPLE_BYTES in all (LEAST_ROWS of a language where that would leave fewer). Landmarks are LANDMARKS for each
language, and about ALL_LANDMARKS together where there are many languages. Prediction reads whole texts, and nothing else.

Null texts and texts without a letter are `und` with score 0, as is every text if no row is labelled. Rows that repeat, or
repeat an id, are each predicted; other columns are ignored, and pass through `keep_identified` whatever their names. A
null doc_id is never held out and never learned from. Of languages that score the same the first by name is predicted. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, parts, private, small_batches

SAMPLE, SAMPLE_BYTES, LEAST_ROWS = 400, 64 << 20, 20
LANDMARKS, ALL_LANDMARKS, ORDER, RIDGE = 40, 640, 4, 0.05
#: Texts, and columns of the presence matrix, that are multiplied at a time.
ROWS, BLOCK = 256, 4096
UNKNOWN = "und"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_GRAM_BITS = 8 * ORDER + 3


def spectrum(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and n-gram of each n-gram that a text holds, once for each text. An n-gram is a number of its length and bytes."""
    low = LOWER[data].astype(np.uint64)
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes), dtype=np.uint64) << np.uint64(_GRAM_BITS), sizes)
    left = np.repeat(offsets[1:], sizes) - np.arange(len(low))  # bytes from here to the text's end
    code, keys = np.zeros(len(low), np.uint64), []
    for n in range(1, ORDER + 1):
        m = len(low) - n + 1
        if m <= 0:
            break
        code = (code[:m] << np.uint64(8)) | low[n - 1 :]
        keys.append(pd.unique((row[:m] | np.uint64(n << 8 * ORDER) | code)[left[:m] >= n]))
    every = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    return (every >> np.uint64(_GRAM_BITS)).astype(np.int64), every & np.uint64((1 << _GRAM_BITS) - 1)


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray  # all n-grams of the landmarks, sorted: the columns
    landmarks: np.ndarray  # columns x landmarks, whether it holds the n-gram
    sizes: np.ndarray  # square roots of the landmarks' numbers of n-grams
    weights: np.ndarray  # landmarks x languages

    def kernel(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Kernels of each text with each landmark."""
        n = len(offsets) - 1
        row, gram = spectrum(data, offsets)
        own = np.sqrt(np.maximum(np.bincount(row, minlength=n), 1))
        at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        held = self.grams[at] == gram
        row, at = row[held], at[held]
        order = np.argsort(at // BLOCK, kind="stable")
        row, at = row[order], at[order]
        cuts = np.searchsorted(at // BLOCK, np.arange(-(-len(self.grams) // BLOCK) + 1))
        shared = np.zeros((n, self.landmarks.shape[1]), np.float32)
        for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])):
            block = self.landmarks[b * BLOCK : (b + 1) * BLOCK]
            presence = np.zeros((n, len(block)), np.float32)
            presence[row[x:y], at[x:y] - b * BLOCK] = 1
            shared += presence @ block.astype(np.float32)
        return shared / (own[:, None] * self.sizes)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self.kernel(data, offsets) @ self.weights


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [x.encode() for x in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(x) for x in raw])


def fit(texts: list[str], labels: list[str], landmarks: int | None = None) -> Model | None:
    """Model of labelled texts; landmarks: the number for each language, the first of its texts."""
    languages = sorted(set(labels))
    if not languages:
        return None
    per = landmarks or max(2, min(LANDMARKS, ALL_LANDMARKS // len(languages)))
    seen, chosen = dict.fromkeys(languages, 0), []
    for i, k in enumerate(labels):
        if seen[k] < per and texts[i]:
            chosen.append(i)
            seen[k] += 1
    if not chosen:
        return None
    row, gram = spectrum(*_joined([texts[i] for i in chosen]))
    grams, at = np.unique(gram, return_inverse=True)
    held = np.zeros((len(grams), len(chosen)), np.uint8)
    held[at, row] = 1
    model = Model(languages, grams, held, np.sqrt(np.bincount(row, minlength=len(chosen))).astype(np.float32), np.zeros((len(chosen), len(languages)), np.float32))

    def kernels(some: list[str]) -> np.ndarray:
        return np.concatenate([model.kernel(data, offsets) for i in range(0, len(some), ROWS) for _, _, data, offsets in parts(pa.array(some[i : i + ROWS], pa.string()))]).astype(np.float64)

    value, vector = np.linalg.eigh(kernels([texts[i] for i in chosen]) + 1e-6 * np.eye(len(chosen)))
    root = vector / np.sqrt(np.maximum(value, 1e-6)) @ vector.T
    features = kernels(texts) @ root
    target = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    # Each language weighs the same, however many of its texts are in the sample.
    count = {k: labels.count(k) for k in languages}
    weight = np.array([len(labels) / len(languages) / count[x] for x in labels])
    solved = np.linalg.solve((features * weight[:, None]).T @ features + RIDGE * np.eye(features.shape[1]), (features * weight[:, None]).T @ target)
    model.weights = (root @ solved).astype(np.float32)
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fitted(docs: DataFrame, sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Model | None:
    """Model of a sample of the labelled rows that aren't held out: of every language about `sample`, by a hash of the row."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    rows = rows.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()  # a row for each language
    if not counts:
        return None
    rates = {}
    for r in counts:
        by_bytes = most_bytes / len(counts) / max(1, r["bytes"])
        rates[r["lang"]] = max(min(sample / r["n"], by_bytes), LEAST_ROWS / r["n"])
    rate = F.create_map(*[F.lit(x) for lang, share in rates.items() for x in (lang, min(1.0, share))])
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    found = rows.where(draw < F.try_element_at(rate, F.col("lang"))).select("lang", "text", F.xxhash64("text").alias("h")).orderBy("h", "lang").collect()
    return fit([r["text"] for r in found], [r["lang"] for r in found])


def prediction(spark: SparkSession, model: Model | None, text: Column) -> Column:
    """struct<lang_pred string, score double> (0 to 1) of a text. Only the text goes to Python."""
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def predicted(text: pa.Array) -> pa.Array:
        model, n = held.value, len(text)
        names, scores = [UNKNOWN] * n, np.zeros(n)
        for at in range(0, n if model else 0, ROWS):
            some = text.slice(at, ROWS)
            for a, b, data, offsets in parts(some):
                f = model.scores(data, offsets)
                best = f.argmax(1)
                has = np.zeros(len(data) + 1, np.int64)
                np.cumsum(_LETTER[data], out=has[1:])
                letters = has[offsets[1:]] > has[offsets[:-1]]
                for i in range(b - a):
                    if letters[i] or any(x.isalpha() for x in some[a + i].as_py() or ""):
                        names[at + a + i] = model.languages[best[i]]
                        scores[at + a + i] = min(1.0, max(0.0, (1 + float(f[i, best[i]])) / 2))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores)], ["lang_pred", "score"])

    return predicted(text.cast("string"))


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    found = docs.select("doc_id", held_out().alias("held_out"), prediction(docs.sparkSession, fitted(docs, sample), F.col("text")).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, languages: list[str] | None = None, least: float = 0.5) -> DataFrame:
    """The rows of docs whose language is known with a score of at least `least` (and among `languages`, if given)."""
    (name,) = private(docs.columns, "_predicted")
    p = F.col(name)
    ok = (p["lang_pred"] != UNKNOWN) & (p["score"] >= least)
    if languages is not None:
        ok &= p["lang_pred"].isin(languages)
    return docs.withColumn(name, prediction(docs.sparkSession, fitted(docs), F.col("text"))).where(ok).drop(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
