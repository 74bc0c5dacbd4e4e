"""Quality classifier: logistic regression over hashed word n-grams, fitted with FTRL-proximal.

Words are runs without white space.  A text's features are the hashed unigrams
and bigrams of its lower-case words and the unigrams, bigrams and trigrams of
their shapes (letters as a/A, digits as 0, other characters as they are, runs
collapsed), and how often a word follows itself.  A feature's value is its
share of the text's n-grams, so the score is one sparse dot product: a gather
of weights and a mean.

The model is fitted on a bounded sample of labelled rows (``rows``), in SHARDS
groups whose weights are averaged.  Null and empty texts get the score of the
bias alone.  Rows are independent: repeated rows and ties get equal scores,
extra columns pass through, an empty table gives an empty result, and without
labels every score is one half.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chalkline.llm.common import batches, held_out, read
from chalkline.llm.samples import labelled_sample

#: Groups in which the sample is fitted.
SHARDS = 4
#: Words a worker remembers before it starts afresh.
REMEMBERED = 400_000


@dataclass(frozen=True)
class Settings:
    rows: int = 8_192
    bits: int = 18
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.05
    epochs: int = 6
    scale: float = 8.0


class Words(dict):
    """Word -> hash of the word and hash of its shape in one integer."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        shape = re.sub(r"(.)\1+", r"\1", re.sub(r"[^\W\d_]", lambda m: "A" if m[0].isupper() else "a", re.sub(r"\d", "0", word)))
        out = self[word] = zlib.crc32(word.lower().encode()) << 31 ^ zlib.crc32(shape[:24].encode()) >> 1
        return out


WORDS = Words()


def features(text: str | None, bits: int) -> np.ndarray:
    """Hashed n-grams of a text, one entry an occurrence."""
    packed = np.fromiter(map(WORDS.__getitem__, (text or "").split()), np.int64).astype(np.uint64)
    if not len(packed):
        return np.empty(0, np.int64)
    word, shape = packed >> np.uint64(31), packed & np.uint64(0x7FFFFFFF)
    a, b = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    shape2 = shape[:-1] * a + shape[1:] * b
    grams = [word * a, (word[:-1] * a + word[1:]) * b, shape * b + np.uint64(1), shape2 * a + np.uint64(2), (shape2[:-1] * a + shape[2:]) * b + np.uint64(3)]
    again = np.full(int((word[1:] == word[:-1]).sum()), 5, np.uint64)
    mixed = np.concatenate([*grams, again * a])
    return ((mixed ^ mixed >> np.uint64(29)) * b >> np.uint64(64 - bits)).astype(np.int64)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], s: Settings) -> tuple[np.ndarray, float]:
    """Weights and bias from (features, values, label) rows."""
    z, n = np.zeros((1 << s.bits) + 1), np.zeros((1 << s.bits) + 1)
    bias = 1 << s.bits

    def weights(i):
        return np.where(np.abs(z[i]) <= s.l1, 0.0, -(z[i] - np.sign(z[i]) * s.l1) / ((s.beta + np.sqrt(n[i])) / s.alpha + s.l2))

    for epoch in range(s.epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            i, x, y = rows[k]
            i, x = np.append(i, bias), np.append(x, 1.0)
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / s.alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(np.arange(bias + 1))
    return w[:-1], float(w[-1])


def fit(sample: DataFrame, target: str, s: Settings = Settings()) -> np.ndarray:
    """Weights, the bias last.  ``sample`` is bounded; its features are grouped, not its texts."""

    def featurised(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, "text"):
            pairs = [np.unique(features(x.as_py(), s.bits), return_counts=True) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("shard"), batch.column("doc_id"), batch.column("y"), pa.array([p[0] for p in pairs], pa.list_(pa.int64())), pa.array([s.scale * p[1] / max(1, p[1].sum()) for p in pairs], pa.list_(pa.float64()))],
                ["shard", "doc_id", "y", "i", "x"],
            )

    def shard_weights(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc_id", kind="stable")  # the order of rows after a shuffle is not fixed
        w, b = fit_ftrl([(np.asarray(i), np.asarray(x), int(y)) for i, x, y in zip(group.i, group.x, group.y, strict=True)], s)
        used = np.flatnonzero(w)
        return pd.DataFrame({"shard": int(group["shard"].iloc[0]), "i": np.append(used, 1 << s.bits), "w": np.append(w[used], b)})

    shards = sample.select(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SHARDS)).cast("int").alias("shard"), "doc_id", F.col(target).cast("int").alias("y"), "text")
    fitted = shards.mapInArrow(featurised, "shard int, doc_id long, y int, i array<long>, x array<double>").groupBy("shard").applyInPandas(shard_weights, "shard int, i long, w double")
    rows = fitted.groupBy("i").agg(F.sum("w").alias("w")).collect()  # at most 2 ** bits + 1 rows
    weights = np.zeros((1 << s.bits) + 1)
    for r in rows:
        weights[r.i] = r.w / SHARDS
    return weights


def score(df: DataFrame, weights: np.ndarray, s: Settings = Settings(), text: str = "text") -> DataFrame:
    """``df`` and score double: the probability of label 1.  A column named score is replaced."""
    df = df.drop("score")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, text):
            found = [features(x, s.bits) for x in batch.column(text).to_pylist()]
            sums = np.array([weights[x].sum() / max(1, len(x)) for x in found])
            scores = 1 / (1 + np.exp(-np.clip(s.scale * sums + weights[-1], -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, "score"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``docs`` with held_out, score and predicted, by a model fitted outside the held-out fifth."""
    weights = fit(labelled_sample(docs, labels, "quality", s.rows, held_out("doc_id", 5, 0)), "quality", s)
    return score(docs, weights, s).withColumns({"held_out": F.coalesce(held_out("doc_id", 5, 0), F.lit(False)), "predicted": (F.col("score") >= 0.3).cast("int")})


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_scores(docs, read(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
