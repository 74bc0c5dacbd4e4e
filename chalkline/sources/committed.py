"""Stage tables that are replaced lecture by lecture, whole or not at all.

A table is a folder with ``data/ID``, what one write brought, and ``manifest/v=N``:
for each lecture the write that holds its rows and the number of that write.  A
write puts its data beside the others, then a new manifest, which counts from the
moment its folder gets its name.  Readers go through the latest manifest, so a
write that is killed on the way changes nothing, and a lecture that was written
with no rows reads as empty.  One writer a table at a time: a second one that
began with the same manifest fails when it gives its own the name.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chalkline.sources.scratch import children, exists, remove, rename

MANIFEST = "video_id string, files string, version long"


def last_version(spark: SparkSession, path: str) -> int:
    """Number of the latest manifest; 0 where there is none."""
    numbers = [int(name[2:]) for name in children(spark, f"{path}/manifest") if name.startswith("v=") and exists(spark, f"{path}/manifest/{name}/_SUCCESS")]
    return max(numbers, default=0)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """video_id, files, version: the write that each lecture's rows come from."""
    version = last_version(spark, path)
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest/v={version}") if version else spark.createDataFrame([], MANIFEST)


def commit(df: DataFrame, path: str, lectures: DataFrame | None = None, fmt: str = "parquet") -> int:
    """Replace the rows of ``lectures`` (those in ``df`` if not given) by ``df``; the number of the write.

    Rows of other lectures must not be in ``df``.  Lectures without rows become empty.
    """
    spark, name = df.sparkSession, uuid.uuid4().hex
    base, version = manifest(spark, path), last_version(spark, path) + 1
    df.write.format(fmt).save(f"{path}/data/{name}")
    lectures = spark.read.schema(df.schema).format(fmt).load(f"{path}/data/{name}") if lectures is None else lectures
    new = lectures.select("video_id").where(F.col("video_id").isNotNull()).distinct().select("video_id", F.lit(name).alias("files"), F.lit(version).cast("long").alias("version"))
    beside = f"{path}/manifest/writing-{name}"
    base.join(new, "video_id", "left_anti").unionByName(new).write.parquet(beside)
    if not rename(spark, beside, f"{path}/manifest/v={version}"):
        raise RuntimeError(f"{path}: another write took place meanwhile")
    return version


def read_committed(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """The rows of the latest manifest."""
    live = manifest(spark, path)
    names = [r.files for r in live.select("files").distinct().collect()]  # the writes that are still read: compact() makes them one
    if not names:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).format(fmt).load([f"{path}/data/{n}" for n in names])
    if len(names) == 1:
        return rows
    files = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    found = rows.withColumn("__files", files).join(live.select("video_id", F.col("files").alias("__files")), ["video_id", "__files"], "left_semi")
    return found.select(*schema.fieldNames())


def compact(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> None:
    """Put all rows into one write and remove what no longer counts; nobody may be reading."""
    commit(read_committed(spark, path, schema, fmt), path, manifest(spark, path), fmt)
    live, last = {r.files for r in manifest(spark, path).select("files").distinct().collect()}, f"v={last_version(spark, path)}"
    for name in children(spark, f"{path}/data"):
        if name not in live:
            remove(spark, f"{path}/data/{name}")
    for name in children(spark, f"{path}/manifest"):
        if name != last:
            remove(spark, f"{path}/manifest/{name}")
