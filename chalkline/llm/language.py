"""Language identification by a string kernel, Nystroem landmarks and kernel ridge regression.

A text's blended spectrum is the set of its character n-grams of length 1 to 3,
lower case, over the whole text, hashed into DIMS cells.  The kernel of two texts
is the number of cells they share over the geometric mean of their sizes.  With
landmark texts M, a text's coordinates are K(x, M) K(M, M)^-1/2; one ridge
regression for each language (one against the rest) is solved on those of a
bounded training sample (``per_language`` documents of each language, whose
normal equations are summed in tasks).  Texts are scored in batches as matrix
products.  Every language of the training rows is learned, however rare; an id
that is repeated in a language counts once there, with its smallest text.

Null texts and texts without a letter are ``und`` with score 0, as is every text
when there is nothing to learn from.  Equal texts get equal results; ties go to
the first language in alphabetical order.  Extra columns pass through and an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chalkline.llm.common import batches, held_out, lists, read, scratch_folder, write_table
from chalkline.llm.samples import one_text, spread

DIMS = 1 << 13
#: Parts in which the sample is summed up.
SHARDS = 8
#: Texts scored at once.
BATCH = 128


@dataclass(frozen=True)
class Settings:
    per_language: int = 512
    landmarks: int = 192
    ridge: float = 0.05


def spectrum(text: str) -> np.ndarray:
    """Cells of the text's n-grams, ascending."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    bits = np.uint32(32 - (DIMS.bit_length() - 1))
    one = c * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ one[:-1] >> np.uint32(15)) + c[1:] * np.uint32(0x85EBCA77)
    three = (two[:-1] ^ two[:-1] >> np.uint32(13)) * np.uint32(0xC2B2AE3D) + c[2:] * np.uint32(0x27D4EB2F)
    cells = np.zeros(DIMS, bool)
    for salt, h in enumerate((one, two, three)):
        cells[((h ^ h >> np.uint32(16)) * np.uint32(0x846CA68B + 2 * salt)) >> bits] = True
    return np.flatnonzero(cells)


def rows_of(spectra: list[np.ndarray]) -> np.ndarray:
    """Presence rows of unit length."""
    x = np.zeros((len(spectra), DIMS), np.float32)
    for row, cells in enumerate(spectra):
        x[row, cells] = 1 / np.sqrt(max(1, len(cells)))
    return x


@dataclass(frozen=True)
class Model:
    languages: list[str]
    landmarks: np.ndarray  # presence rows, DIMS columns
    weights: np.ndarray  # K(M, M)^-1/2 times the ridge solutions


def root_of(m: np.ndarray) -> np.ndarray:
    """K(M, M)^-1/2, without the directions in which landmarks don't differ."""
    values, vectors = np.linalg.eigh((m @ m.T).astype(np.float64))
    keep = values > 1e-6 * max(values.max(), 1e-12)
    return vectors[:, keep] / np.sqrt(values[keep])


def spectra(df: DataFrame) -> DataFrame:
    """key, lang and cells of rows key, lang, text."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, "text"):
            found = [spectrum(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("lang"), lists(np.concatenate(found).astype(np.int16), [len(x) for x in found], pa.int16())], ["key", "lang", "cells"])

    return df.select("key", "lang", "text").mapInArrow(run, T.StructType([*df.select("key", "lang").schema.fields, T.StructField("cells", T.ArrayType(T.ShortType()))]))


def solve(sample: DataFrame, names: list[str], sizes: dict[str, int], m: np.ndarray, s: Settings) -> np.ndarray:
    """Weights over the landmarks m: tasks sum the normal equations of their rows, the driver solves them once."""
    root = root_of(m)
    number = {name: i for i, name in enumerate(names)}

    def sums(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["key", "lang"], kind="stable")  # the order of rows after a shuffle is not fixed
        a, b = np.zeros((root.shape[1], root.shape[1])), np.zeros((root.shape[1], len(names)))
        for at in range(0, len(group), BATCH):
            part = group.iloc[at : at + BATCH]
            z = (rows_of([np.asarray(c, np.int64) for c in part.cells]) @ m.T).astype(np.float64) @ root
            w = np.array([1 / sizes[x] for x in part.lang])[:, None]  # each language counts as much as any other
            y = np.zeros((len(part), len(names)))
            y[np.arange(len(part)), [number[x] for x in part.lang]] = 1
            a += z.T @ (z * w)
            b += z.T @ (y * w)
        return pd.DataFrame({"shard": [int(group["shard"].iloc[0])], "a": [a.tobytes()], "b": [b.tobytes()]})

    sharded = sample.withColumn("shard", F.pmod(F.xxhash64("key", "lang"), F.lit(SHARDS)).cast("int"))
    parts = sorted(sharded.groupBy("shard").applyInPandas(sums, "shard int, a binary, b binary").collect(), key=lambda r: r["shard"])  # SHARDS rows
    a = sum(np.frombuffer(r.a).reshape(root.shape[1], -1) for r in parts)
    b = sum(np.frombuffer(r.b).reshape(root.shape[1], -1) for r in parts)
    return (root @ np.linalg.solve(a + s.ridge * np.eye(len(a)) / len(names), b)).astype(np.float32)


def train(df: DataFrame, s: Settings = Settings(), text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """Model of every language, from at most ``per_language`` documents of each.

    Landmarks come from all languages alike, one of each at least.  The model,
    and what the driver holds, grows with the number of languages only.
    """
    known = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    chosen, counts = spread(known.select("key", "lang").distinct(), "lang", "key", s.per_language)
    names = sorted(counts)
    if not names:
        return Model([], np.zeros((0, DIMS), np.float32), np.zeros((0, 0), np.float32))
    with scratch_folder(df.sparkSession, "languages") as folder:
        chosen = F.broadcast(chosen.select(F.col("key").alias("__key"), F.col("lang").alias("__lang")))  # per_language ids a language
        rows = known.join(chosen, F.col("key").eqNullSafe(F.col("__key")) & (F.col("lang") == F.col("__lang")), "left_semi")
        sample = write_table(spectra(one_text(rows, "key", "text", "lang")), "spectra", folder=folder)
        sizes = {r.lang: r["count"] for r in sample.groupBy("lang").count().collect()}
        order = Window.partitionBy("lang").orderBy(F.xxhash64("key"), "key")  # per_language rows a language
        first = sample.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= max(1, s.landmarks // len(names)))
        m = rows_of([np.array(r.cells, np.int64) for r in first.orderBy("lang", "nth").collect()])
        names = sorted(sizes)
        return Model(names, m, solve(sample, names, sizes, m, s))


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` and lang_pred string, score double; columns of these names are replaced."""
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    df = df.drop(*(f.name for f in new))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, text):
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                texts = [x or "" for x in part.column(text).to_pylist()]
                lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
                real = [k for k, x in enumerate(texts) if model.languages and any(map(str.isalpha, x))]
                if real:
                    out = rows_of([spectrum(texts[k]) for k in real]) @ model.landmarks.T @ model.weights
                    lang[real] = np.array(model.languages, object)[out.argmax(1)]
                    score[real] = np.clip(out.max(1), 0, 1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score)], [*part.schema.names, "lang_pred", "score"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *new]))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out("doc_id", 3, 1)))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(held_out("doc_id", 3, 1), F.lit(False)).alias("held_out"), "lang_pred", "score")
