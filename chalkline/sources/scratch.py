"""Scratch tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; a folder of our own only in local mode, where none may be named."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not known.isDefined():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="chalkline-"))
            known = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = known.get()
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def bucketed(df: DataFrame, name: str, key: str = "video_id") -> DataFrame:
    """``df`` written in buckets of ``key``, as many as shuffles have parts: joins, groups and windows on it need no exchange."""
    spark = df.sparkSession
    path, parts = scratch_path(spark, name), int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"chalkline_{path.rsplit('/', 1)[1].replace('-', '_')}"
    df.repartition(parts, key).write.bucketBy(parts, key).sortBy(key).option("path", path).saveAsTable(table)
    return spark.table(table)


def _file(spark: SparkSession, path: str):
    """(file system, path) of a path in any of Hadoop's file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    system, at = _file(spark, path)
    return system.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder of scratch data."""
    system, at = _file(spark, path)
    system.delete(at, True)


def rename(spark: SparkSession, path: str, new: str) -> bool:
    """Give a folder a name that no other has; false where it is taken."""
    system, at = _file(spark, path)
    return not exists(spark, new) and bool(system.rename(at, spark._jvm.org.apache.hadoop.fs.Path(new)))


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where there is no such folder."""
    system, at = _file(spark, path)
    return [s.getPath().getName() for s in system.listStatus(at)] if system.exists(at) else []
