"""Page order and page plan of the resulting notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def default_page_order(assigned: DataFrame) -> DataFrame:
    order = Window.partitionBy("video_id").orderBy("topic_index", "trusted_index")
    return assigned.select("video_id", (F.row_number().over(order) - 1).cast("int").alias("position"), "trusted_index")


def order_is_permutation(orders: DataFrame, trusted: DataFrame) -> DataFrame:
    """Whether a requested order (position, trusted_index) holds every trusted index exactly once."""
    asked = orders.groupBy("video_id").agg(F.sort_array(F.collect_list("trusted_index")).alias("asked"))
    have = trusted.groupBy("video_id").agg(F.sort_array(F.collect_list("trusted_index")).alias("have"))
    none = F.array().cast("array<int>")
    return have.join(asked, "video_id", "full_outer").select("video_id", (F.coalesce("asked", none) == F.coalesce("have", none)).alias("valid"))


def page_items(orders: DataFrame, trusted: DataFrame, assigned: DataFrame, titles: DataFrame) -> DataFrame:
    topic = assigned.groupBy("video_id", "trusted_index").agg(F.min("topic_index").alias("topic_index")).join(titles, ["video_id", "topic_index"], "left")
    shots = trusted.select("video_id", "trusted_index", "candidate_index", "timestamp_seconds", "image_filename")
    return orders.join(shots, ["video_id", "trusted_index"]).join(topic, ["video_id", "trusted_index"], "left").withColumnRenamed("title", "topic_title")


def page_plan(items: DataFrame, cover: bool = True, dividers: bool = True) -> DataFrame:
    """A cover, a divider wherever the topic changes, and a page for each screenshot."""
    order = Window.partitionBy("video_id").orderBy("position")
    items = items.withColumns({"first": F.lag("position").over(order).isNull(), "before": F.lag("topic_index").over(order)})
    first, before = F.col("first"), F.col("before")
    kinds = F.array_compact(F.array(
        F.when(first & F.lit(cover), F.struct(F.lit(0).alias("k"), F.lit("COVER").alias("page_kind"))),
        F.when((first | ~before.eqNullSafe(F.col("topic_index"))) & F.lit(dividers), F.struct(F.lit(1).alias("k"), F.lit("DIVIDER").alias("page_kind"))),
        F.struct(F.lit(2).alias("k"), F.lit("SCREENSHOT").alias("page_kind")),
    ))
    pages = items.withColumn("p", F.explode(kinds)).select("video_id", "position", "trusted_index", "topic_index", "p.k", "p.page_kind")
    number = F.row_number().over(Window.partitionBy("video_id").orderBy("position", "k"))
    shown = F.col("page_kind") == "SCREENSHOT"
    return pages.select("video_id", number.alias("page_no"), "page_kind", F.when(shown, F.col("trusted_index")).alias("trusted_index"), F.when(F.col("page_kind") != "COVER", F.col("topic_index")).alias("topic_index"))


def apply_page_order(current: DataFrame, requested: DataFrame, trusted: DataFrame) -> DataFrame:
    """What happens to each requested order: REJECTED, UNCHANGED or APPLIED (which makes pages stale)."""
    as_list = lambda df, name: df.groupBy("video_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "trusted_index"))), lambda x: x["trusted_index"]).alias(name))
    rows = as_list(requested, "asked").join(order_is_permutation(requested, trusted), "video_id").join(as_list(current, "now"), "video_id", "left")
    outcome = F.when(~F.col("valid"), "REJECTED").when(F.col("asked").eqNullSafe(F.col("now")), "UNCHANGED").otherwise("APPLIED")
    return rows.select("video_id", outcome.alias("outcome"), (outcome == "APPLIED").cast("int").alias("version_bump"))
