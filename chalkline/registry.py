"""Queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chalkline.plans import queries
from chalkline.plans.library import Library


def _over(build: Callable[[Library], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(Library(spark, sf_dir))


QUERIES = {name: _over(build) for name, build in queries.SPARK.items()}
ORACLE_SQL = dict(queries.SQL)
