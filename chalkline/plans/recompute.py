"""Recompute what is stale: each stage over the lectures alone whose recorded inputs are no longer the current ones."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chalkline.operators.folds import write
from chalkline.operators.lineage import artifact_freshness
from chalkline.sources.committed import commit, manifest, read_committed

RECORDS = "video_id string, stage string, input string, recorded_version long"


def schema_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


@dataclass(frozen=True)
class Stage:
    """A stage table: the tables it reads (stages before it, or sources) and what makes it from them."""

    name: str
    inputs: tuple[str, ...]
    make: Callable[[dict[str, DataFrame]], DataFrame]
    schema: str


def refresh(spark: SparkSession, path: str, stages: list[Stage], sources: dict[str, DataFrame], versions: DataFrame) -> dict[str, dict[str, int]]:
    """Bring the stage tables under ``path`` up to date; for each stage that was run, how many lectures it took and rows it read of each input.

    stages: in an order in which each comes after those it reads.  sources: the
    other tables, keyed by video_id; versions: video_id, input, version of each
    lecture in each of them.  A stage's version for a lecture is the number of the
    write that its rows come from, so a stage that was run makes those behind it
    stale, for its lectures only.  Tables and records are replaced whole or not at
    all, the record last: a run that is killed is taken up by the next one.
    """
    counts: dict[str, dict[str, int]] = {}
    schemas = {s.name: schema_of(s.schema) for s in stages}
    for stage in stages:
        table, log = f"{path}/{stage.name}", f"{path}/{stage.name}-inputs"
        current = versions.where(F.col("input").isin(*stage.inputs)).select("video_id", "input", F.col("version").cast("long"))
        for name in stage.inputs:
            if name in schemas:
                current = current.unionByName(manifest(spark, f"{path}/{name}").select("video_id", F.lit(name).alias("input"), "version"))
        known = read_committed(spark, log, schema_of(RECORDS))
        recorded = current.join(known.drop("stage"), ["video_id", "input"], "left").select("video_id", F.lit(stage.name).alias("stage"), "input", "recorded_version")
        todo = artifact_freshness(recorded, current).where("status <> 'FRESH'").select("video_id")
        run = write(todo, f"{stage.name}-run")  # as it is now: what makes lectures stale changes below
        lectures = run.count()
        if not lectures:
            continue
        read, seen = {}, {}
        for name in stage.inputs:
            rows = read_committed(spark, f"{path}/{name}", schemas[name]) if name in schemas else sources[name]
            seen[name] = Observation(f"{stage.name}-{name}")
            read[name] = rows.join(run, "video_id", "left_semi").observe(seen[name], F.count("*").alias("n"))
        made = stage.make(read)
        commit(made.select(*schemas[stage.name].fieldNames()), table, run)
        commit(current.join(run, "video_id", "left_semi").select("video_id", F.lit(stage.name).alias("stage"), "input", F.col("version").alias("recorded_version")), log, run)
        plan = made._jdf.queryExecution().analyzed().toString()
        counts[stage.name] = {"lectures": lectures} | {name: _seen(o, read[name]) if f"{stage.name}-{name}" in plan else 0 for name, o in seen.items()}
    return counts



def _seen(observation: Observation, rows: DataFrame) -> int:
    """Rows that were observed; counted where Spark found the result empty on the way and dropped the observation."""
    row = observation._jo.getRow()
    return row.getLong(0) if row.size() else rows.count()
