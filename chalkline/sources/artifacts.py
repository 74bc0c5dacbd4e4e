"""Reading and writing of stage tables: JSON lines, summaries, word boxes, images."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chalkline.sources import committed

WORD_FIELDS = ("level", "page_num", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height", "conf", "text")


def write_artifact(df: DataFrame, path: str, fmt: str = "parquet", lectures: DataFrame | None = None) -> None:
    """Replace the data of ``lectures``, or of those in ``df``, whole or not at all; other lectures stay."""
    committed.commit(df, path, lectures, fmt)


def read_artifact(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json") -> DataFrame:
    """A table of write_artifact(), or a folder of JSON lines, under a fixed schema.

    A malformed line of the latter fails the read, blank lines are skipped.
    """
    if committed.last_version(spark, path):
        return committed.read_committed(spark, path, schema, fmt)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_summary(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON object a file; missing or malformed ones are absent."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.schema(wide).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return rows.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def read_ocr_words(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated word boxes with a header; rows with blank text or a box that is no number are skipped, no conf is -1.

    Quotes are ordinary characters.
    """
    raw = spark.read.option("sep", "\t").option("header", True).option("quote", "").option("ignoreLeadingWhiteSpace", False).csv(path)
    number = {c: F.expr(f"try_cast(`{c}` AS INT)") for c in WORD_FIELDS[:-2]}
    conf = F.when(F.coalesce(F.btrim("conf"), F.lit("")) == "", F.lit(-1.0)).otherwise(F.expr("try_cast(conf AS DOUBLE)"))
    rows = raw.withColumns(number | {"conf": conf})
    good = F.btrim(F.coalesce("text", F.lit(""))) != ""
    for c in WORD_FIELDS[:-1]:
        good = good & F.col(c).isNotNull()
    return rows.where(good)


@contextmanager
def _listing(spark: SparkSession):
    """Folders are listed by a few tasks a core: Spark's own choice is a task for each folder, up to 10,000."""
    name, few = "spark.sql.sources.parallelPartitionDiscovery.parallelism", 4 * spark.sparkContext.defaultParallelism
    before = spark.conf.get(name)
    spark.conf.set(name, min(int(before), few))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def read_image_assets(spark: SparkSession, glob: str, manifest: DataFrame | None = None) -> DataFrame:
    """Image files by name and size; contents are not read.

    The name is that of the file, or of its folder where that is image_filename=NAME.
    With a ``manifest`` (image_filename and more): its rows, the size of each
    one's file (the largest of several of one name) and whether there is one.
    """
    with _listing(spark):
        rows = spark.read.format("binaryFile").load(glob)
    name = F.col("image_filename") if "image_filename" in rows.columns else F.element_at(F.split("path", "/"), -1)
    files = rows.select(name.alias("image_filename"), "length")
    if manifest is None:
        return files
    sizes = files.groupBy("image_filename").agg(F.max("length").alias("length"))
    return manifest.drop("length", "present").join(sizes, "image_filename", "left").withColumn("present", F.col("length").isNotNull())
