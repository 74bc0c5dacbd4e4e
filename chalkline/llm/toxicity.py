"""Toxicity: cumulative-link ordinal regression over sparse text features.

Grades.  Labels say toxic or not, nothing of how much, so severity is by count:
the grades of toxic documents come from how many marked words they hold, 1 for
at most one, 2 for two or three, 3 for more.  The model's features are counts of
the same words, so grades above 1 repeat that rule; only the first threshold
(toxic or not) is learned from labels and can be tested on held-out ones.
Marked features are words and word beginnings (4 to 6 characters) that are far
more common in toxic documents of the sample than in others.

The model has one weight for each marked feature, shared by all grades, and one
threshold for each grade: P(grade >= k) = logistic(w.x - t_k), t_1 <= t_2 <= t_3.
A text's features are log(1 + count) of the marked features in the whole text;
the expected severity is the sum of P(grade >= k).

Null and empty texts have no features: their severity is that of the thresholds
alone.  Rows are independent: repeated rows and ties get equal results, extra
columns pass through, an empty table gives an empty result, and without labels
nothing is marked and nothing is called toxic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chalkline.llm.common import batches, held_out, lists, read
from chalkline.llm.samples import labelled_sample

GRADES = 3
EDGES = "'\"«»“”„‘’()[]{}<>.,;:!?…*_#|-–—"
REMEMBERED = 400_000


@dataclass(frozen=True)
class Settings:
    rows: int = 16_384
    min_docs: int = 3
    min_log_odds: float = 3.0
    max_features: int = 8_192
    shards: int = 4
    steps: int = 400
    rate: float = 0.5
    l2: float = 1e-4


def marks(word: str) -> list[str]:
    """The features of a word: itself and, marked by a star, its beginnings."""
    word = word.strip(EDGES).lower()
    return [word, *(f"{word[:n]}*" for n in (4, 5, 6) if len(word) >= n)] if word else []


def marked_features(sample: DataFrame, s: Settings) -> dict[str, int]:
    """Feature -> number: at most ``max_features`` of the bounded sample."""

    def present(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, "text"):
            found = [sorted({m for w in set((x or "").split()) for m in marks(w)}) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.list_(pa.string()))], ["toxic", "marks"])

    n = {int(r.toxic): r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return {}
    counts = sample.select(F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(present, "toxic int, marks array<string>")
    bad, good = F.sum("toxic"), F.sum(1 - F.col("toxic"))
    odds = F.log((bad + 0.5) / float(n[1])) - F.log((good + 0.5) / float(n[0]))
    found = counts.select("toxic", F.explode("marks").alias("mark")).groupBy("mark").agg(bad.alias("bad"), odds.alias("odds"))
    best = found.where((F.col("bad") >= s.min_docs) & (F.col("odds") >= s.min_log_odds)).orderBy(F.desc("bad"), "mark").limit(s.max_features)
    return {r.mark: i for i, r in enumerate(best.collect())}


class Marker(dict):
    """Word -> numbers of its marked features."""

    def __init__(self, marked: dict[str, int]):
        self.marked = marked

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        out = self[word] = tuple(self.marked[m] for m in marks(word) if m in self.marked)
        return out

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
        """Feature numbers, their counts, and how many words are marked."""
        hits = [x for x in map(self.__getitem__, (text or "").split()) if x]
        i, n = np.unique(np.array([j for x in hits for j in x], np.int64), return_counts=True)
        return i, n, len(hits)


def fit_ordinal(row: np.ndarray, i: np.ndarray, x: np.ndarray, size: int, grade: np.ndarray, s: Settings) -> np.ndarray:
    """Weights and thresholds by gradient steps with momentum on the binary losses of all thresholds.

    Feature i of document ``row`` is x: three arrays with one entry a feature that
    occurs; ``size`` is the number of features.
    """
    w, first, gaps = np.zeros(size), 2.0, np.zeros(GRADES - 1)
    speed = [np.zeros_like(w), 0.0, np.zeros_like(gaps)]
    above = grade[:, None] >= np.arange(1, GRADES + 1)
    weight = np.where(grade == 0, 0.5 / max(1, (grade == 0).sum()), 0.5 / max(1, (grade > 0).sum()))[:, None]
    for _ in range(s.steps):
        t = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])  # ordered by construction
        sums = np.bincount(row, w[i] * x, len(grade))[:, None]
        off = (1 / (1 + np.exp(-np.clip(sums - t, -35, 35))) - above) * weight
        slope = [np.bincount(i, off.sum(1)[row] * x, size) + s.l2 * w, -off.sum(), -np.array([off[:, k + 1 :].sum() for k in range(GRADES - 1)]) * np.exp(gaps)]
        speed = [0.9 * v - s.rate * g for v, g in zip(speed, slope, strict=True)]
        w, first, gaps = w + speed[0], first + speed[1], np.clip(gaps + speed[2], -5, 5)
    return np.concatenate([w, first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])])


def fit(sample: DataFrame, s: Settings = Settings()) -> tuple[dict[str, int], np.ndarray]:
    """Marked features, and weights followed by thresholds; shards of the sample are averaged."""
    marked = marked_features(sample, s)
    size = len(marked)
    if not size:
        return {}, np.full(GRADES, 35.0)

    def featurised(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marker = Marker(marked)
        for batch in batches(source, "text"):
            found = [marker.counts(x) for x in batch.column("text").to_pylist()]
            n = [len(i) for i, _, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("shard"), batch.column("toxic"), pa.array([k for _, _, k in found], pa.int32()), lists(np.concatenate([i for i, _, _ in found]), n, pa.int64()), lists(np.concatenate([c for _, c, _ in found]), n, pa.int64())],
                ["shard", "toxic", "hits", "i", "n"],
            )

    def shard_weights(group: pd.DataFrame) -> pd.DataFrame:
        row = np.repeat(np.arange(len(group)), group.i.map(len).to_numpy())
        i, n = (np.concatenate([np.empty(0, np.int64), *group[c]]).astype(np.int64) for c in ("i", "n"))
        hits = group.hits.to_numpy()
        grade = np.where(group.toxic.to_numpy() == 0, 0, 1 + (hits >= 2) + (hits >= 4))
        w = fit_ordinal(row, i, np.log1p(n), size, grade, s)
        return pd.DataFrame({"shard": int(group["shard"].iloc[0]), "i": np.arange(len(w)), "w": w})

    shards = sample.select(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(s.shards)).cast("int").alias("shard"), F.col("toxic").cast("int").alias("toxic"), "text")
    fitted = shards.mapInArrow(featurised, "shard int, toxic int, hits int, i array<long>, n array<long>").groupBy("shard").applyInPandas(shard_weights, "shard int, i long, w double")
    rows = fitted.groupBy("i").agg(F.avg("w").alias("w")).collect()  # at most max_features + GRADES rows
    weights = np.zeros(size + GRADES)
    for r in rows:
        weights[r.i] = r.w
    return marked, weights


def score(df: DataFrame, marked: dict[str, int], weights: np.ndarray, text: str = "text") -> DataFrame:
    """``df`` and severity double (0 to GRADES), grade int (most likely not exceeded by half), toxic boolean."""
    new = [T.StructField("severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("toxic", T.BooleanType())]
    df = df.drop(*(f.name for f in new))
    w, t = weights[:-GRADES], weights[-GRADES:]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marker = Marker(marked)
        for batch in batches(source, text):
            found = (marker.counts(x) for x in batch.column(text).to_pylist())
            sums = np.array([w[i] @ np.log1p(n) for i, n, _ in found])
            p = 1 / (1 + np.exp(-np.clip(sums[:, None] - t, -35, 35)))
            out = [pa.array(p.sum(1)), pa.array((p >= 0.5).sum(1).astype(np.int32)), pa.array(p[:, 0] >= 0.5)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], [*batch.schema.names, *(f.name for f in new)])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *new]))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Settings()
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    marked, weights = fit(labelled_sample(docs, read(spark, sf_dir, "labels"), "toxic", s.rows, held_out("doc_id", 5, 0)), s)
    return score(docs, marked, weights).select("doc_id", F.coalesce(held_out("doc_id", 5, 0), F.lit(False)).alias("held_out"), "severity", "grade", "toxic", F.col("toxic").cast("int").alias("predicted"))
