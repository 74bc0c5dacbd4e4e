"""Joins of spans and points of one lecture by buckets of time instead of by all its pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def meet(left: DataFrame, right: DataFrame, left_span: tuple[Column, Column], right_span: tuple[Column, Column], width: float) -> DataFrame:
    """Pairs of rows of one ``video_id`` whose closed spans (low, high) share a point.

    Each row is dealt to the buckets of ``width`` that its span touches, and a pair
    is made in the first bucket that both touch, so the work grows with the rows
    and the pairs that meet.  But for video_id the two sides have no column in
    common.  Rows with a null end, or that end before they begin, meet nothing.  A
    span must be finite: it is dealt to each bucket that it touches, so ``width``
    should be of the order of the longer spans.
    """
    number = lambda x: F.floor(x / width)

    def dealt(df: DataFrame, side: str, span: tuple[Column, Column]) -> DataFrame:
        low, high = f"__low_{side}", f"__high_{side}"
        rows = df.withColumns({low: span[0].cast("double"), high: span[1].cast("double")}).where(F.col(low) <= F.col(high))
        return rows.withColumn(f"__bucket_{side}", F.explode(F.sequence(number(F.col(low)), number(F.col(high)))))

    a, b = dealt(left, "a", left_span), dealt(right, "b", right_span).withColumnRenamed("video_id", "__video")
    same = (F.col("video_id") == F.col("__video")) & (F.col("__bucket_a") == F.col("__bucket_b"))
    first = F.col("__bucket_a") == number(F.greatest("__low_a", "__low_b"))
    pairs = a.join(b, same & first & (F.col("__low_a") <= F.col("__high_b")) & (F.col("__low_b") <= F.col("__high_a")))
    return pairs.drop("__video", *(f"__{x}_{s}" for x in ("low", "high", "bucket") for s in "ab"))
