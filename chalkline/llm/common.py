"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words in every contract of this subpackage.
WORD_SPACE = " \t\n\x0b\x0c\r"


#: Rows that Spark hands to Python at once: long texts must fit in a worker's memory.
ARROW_ROWS = 1_024


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A given table.  The session hands rows to Python in small batches from here on, as every operator here expects."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder; in local mode, where none may be named, one is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            return jvm_dir.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="chalkline-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def write_table(df: DataFrame, name: str, codec: str = "zstd", folder: str | None = None) -> DataFrame:
    """Cut the lineage: write Parquet in the shared folder and read it back.

    Tables survive the loss of any executor.  They are scratch data: what lies in
    a ``folder`` of scratch_folder() goes with it, the rest with the shared folder.
    """
    spark = df.sparkSession
    path = f"{(folder or shared_dir(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_folder(spark: SparkSession, name: str) -> Iterator[str]:
    """A new folder under the shared one, removed with its tables when they have served."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def batches(source: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches with about ``limit`` bytes of ``column`` (one row at least)."""
    for batch in source:
        if batch.num_rows == 0:
            continue
        sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0))
        ends, start, total = [], 0, 0
        for i, size in enumerate(sizes.tolist()):
            if total and total + size > limit:
                ends.append((start, i))
                start, total = i, 0
            total += size
        ends.append((start, batch.num_rows))
        for a, b in ends:
            yield batch.slice(a, b - a)


def lists(values: np.ndarray, counts: np.ndarray | list[int], kind: pa.DataType) -> pa.Array:
    """A list array from flat values and the length of each row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def held_out(doc_id, modulus: int, remainder: int):
    """crc32 of the id as text, modulo ``modulus``, equals ``remainder``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder
