"""Which stage results are stale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stage -> the stages whose results it reads.
DAG = {
    "source": (), "timeline": ("source",), "changes": ("timeline",), "states": ("changes",), "candidates": ("states",), "trusted": ("candidates",),
    "transcript": ("source",), "topics": ("transcript", "trusted"), "ocr": ("trusted", "topics"), "coverage": ("changes", "states", "candidates", "trusted", "transcript", "topics", "ocr"),
    "order": ("trusted",), "pages": ("trusted", "topics", "order"),
}


def artifact_freshness(stage_inputs: DataFrame, current: DataFrame) -> DataFrame:
    """stage_inputs video_id, stage, input, recorded_version (null: never recorded) against current video_id, input, version.

    MISSING without any recorded version, FRESH when all equal the current ones, else STALE.  A recorded 0 that is
    still 0 is fresh.
    """
    rows = stage_inputs.join(current.withColumnRenamed("version", "now"), ["video_id", "input"], "left")
    same = F.bool_and(F.col("recorded_version").eqNullSafe(F.col("now")))
    status = F.when(F.count("recorded_version") == 0, "MISSING").when(same, "FRESH").otherwise("STALE")
    return rows.groupBy("video_id", "stage").agg(status.alias("status"))


def stale_cascade(freshness: DataFrame, dag: dict[str, tuple[str, ...]] = DAG) -> DataFrame:
    """A stage is stale when it or any stage it reads, directly or not, is: the fixed graph is a fixed set of ancestors."""

    def ancestors(stage: str) -> set[str]:
        return {stage}.union(*map(ancestors, dag[stage]))

    reach = freshness.sparkSession.createDataFrame([(s, a) for s in dag for a in sorted(ancestors(s))], "target string, stage string")
    rows = freshness.join(F.broadcast(reach), "stage")
    own = F.max(F.when(F.col("stage") == F.col("target"), F.col("status")))
    upstream = F.bool_or(F.col("status") != "FRESH")
    return rows.groupBy("video_id", F.col("target").alias("stage")).agg(F.when(own == "MISSING", "MISSING").when(upstream, "STALE").otherwise("FRESH").alias("status"))
