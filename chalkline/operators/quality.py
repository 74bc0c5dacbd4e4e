"""Checks of tables: indexes, counts, order, domains, assignment, assets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


KINDS = ("NONE", "LOCAL", "STRUCTURAL", "SCENE")


def _report(rows: DataFrame, bad, index: str) -> DataFrame:
    return rows.where(bad).groupBy("video_id").agg(F.min(index).alias("first_bad"), F.count("*").alias("violations"))


def check_contiguous(df: DataFrame, index: str, order: str) -> DataFrame:
    """Lectures whose index is not 0, 1, 2, ... in row order."""
    rows = df.withColumn("expected", F.row_number().over(Window.partitionBy("video_id").orderBy(order)) - 1)
    return _report(rows, F.col("expected") != F.col(index), "expected")


def check_expected_count(df: DataFrame, summary: DataFrame, column: str) -> DataFrame:
    n = df.groupBy("video_id").agg(F.count("*").alias("n"))
    rows = n.join(summary.select("video_id", F.col(column).alias("expected")), "video_id", "full_outer")
    return rows.where(~F.coalesce("n", F.lit(0)).eqNullSafe(F.coalesce("expected", F.lit(0)))).select("video_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("expected", F.lit(0)).alias("expected"))


def check_monotone(changes: DataFrame) -> DataFrame:
    at = Window.partitionBy("video_id").orderBy("row_index")
    rows = changes.withColumns({"last_frame": F.lag("frame_index").over(at), "last_t": F.lag("timestamp_seconds").over(at)})
    bad = (F.col("frame_index") <= F.col("previous_frame_index")) | (F.col("frame_index") <= F.col("last_frame")) | (F.col("previous_timestamp_seconds") < F.col("last_t")) | (F.col("timestamp_seconds") < F.col("previous_timestamp_seconds"))
    return _report(rows, F.coalesce(bad, F.lit(False)), "row_index")


def check_domain(changes: DataFrame) -> DataFrame:
    return _report(changes, ~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "frame_index")


def check_exactly_once(trusted: DataFrame, assigned: DataFrame) -> DataFrame:
    """Lectures with screenshots in no topic or in several, and whether the bare sum would have shown it."""
    n = assigned.groupBy("video_id", "trusted_index").agg(F.count("*").alias("n"))
    rows = trusted.select("video_id", "trusted_index").join(n, ["video_id", "trusted_index"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out = rows.groupBy("video_id").agg(F.min(F.when(F.col("n") != 1, F.col("trusted_index"))).alias("first_bad"), F.count_if(F.col("n") != 1).alias("violations"), (F.sum("n") != F.count("*")).alias("sum_differs"))
    return out.where("violations > 0")


def check_assets_present(manifest: DataFrame, assets: DataFrame) -> DataFrame:
    return manifest.join(assets, "image_filename", "left_anti").select("video_id", "trusted_index", "image_filename")


