"""Bounded samples of labelled documents for fitting models."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spread(rows: DataFrame, value: str, key: str, limit: int) -> tuple[DataFrame, dict]:
    """(rows, counts): about ``limit`` rows of each ``value``, all where there are no more, and how many there were.

    ``rows`` has each pair of a key and a value once.  A row stays if the hash of
    its key, as a share, is small enough for its value's count, so no task orders
    the rows of a common value; that of the smallest hash stays in any case.  The
    share is set five standard deviations low.  ``rows`` has no null values; the
    driver holds one count a value, as a model does.
    """
    share = F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(1 << 40)) / float(1 << 40)
    found = rows.groupBy(value).agg(F.count("*").alias("n"), F.min(share).alias("least")).collect()
    low = max(1.0, limit - 5 * sqrt(limit))
    shares = [(r[value], 1.0 if r.n <= limit else low / r.n, r.least) for r in found]
    shares = rows.sparkSession.createDataFrame(shares, f"__value {rows.schema[value].dataType.simpleString()}, __share double, __least double")
    chosen = rows.join(F.broadcast(shares), F.col(value) == F.col("__value")).where((share < F.col("__share")) | (share == F.col("__least")))
    return chosen.drop("__value", "__share", "__least"), {r[value]: r.n for r in found}


def one_text(rows: DataFrame, key: str, text: str, *others: str) -> DataFrame:
    """One row a key, that of the smallest text: an id that is repeated counts once."""
    return rows.groupBy(key, *others).agg(F.min(text).alias(text))


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, rows: int, held_out: Column) -> DataFrame:
    """doc_id, text and ``target`` of at most ``rows`` labelled documents outside ``held_out``.

    The documents are those whose ids have the smallest hashes, as many of each
    value of ``target`` as there are or as its share of ``rows`` allows.  Labels
    of null or of unknown documents are left out; of several labels of one
    document the largest counts, of several texts the smallest.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & ~held_out).groupBy("doc_id").agg(F.max(target).alias(target))
    values = known.select(target).distinct().count()
    chosen, _ = spread(known, target, "doc_id", max(1, rows // max(1, values)))
    return one_text(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "doc_id", "text", target)  # at most ``rows`` pairs of an id and a label
