"""Connected components of a graph given as edges, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.llm.common import scratch_folder, write_table


def components(edges: DataFrame, folder: str | None = None) -> DataFrame:
    """(node, component): the smallest node that each node of an edge (a, b) reaches.

    Alternating large-star and small-star steps: every step hangs neighbours
    under the smallest node around, until all edges point to the smallest node of
    their component.  Null ends are left out; repeated edges and loops do no harm.
    The result is a table in ``folder`` (the shared one, if none is given).
    """
    with scratch_folder(edges.sparkSession, "stars") as scratch:
        return write_table(stars(edges, scratch), "components", folder=folder)


def stars(edges: DataFrame, folder: str) -> DataFrame:
    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, before = write_table(e, "edges", folder=folder), None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
        before = state
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")).select("e.u", F.col("e.m").alias("v"))
        e = write_table(small.where("u > v").distinct(), "edges", folder=folder)
