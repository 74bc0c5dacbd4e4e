"""Structured Streaming: stable states and their late rows, activity sessions.

A lecture's stream ends with a row of kind END or after a time without rows; its
last state is emitted then and what was held for it is freed.  That it has ended
is remembered for a while, so that rows which come after the end are rejected
instead of beginning the lecture anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from time import time

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from chalkline.config import StateConfig
from chalkline.operators.changes import CHANGE_COLUMNS, STATES, StateMachine
from chalkline.sources.scratch import exists, scratch_path

COLUMNS = list(CHANGE_COLUMNS)
STATE = "pending boolean, had_change boolean, quiet_start double, last_ts double, last_frame int, max_score double, n_changes int, last_kind string, emitted int, seen_frame int, seen_ts double"
OUT = STATES + ", status string"
OUT_NAMES = [x.split()[0] for x in OUT.split(", ")]
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep their state in RocksDB, which stable_states_stream needs; the setting is put back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


class StableStates(StatefulProcessor):
    """The state machine of one lecture while it goes on; afterwards, for ``keep_ms``, that it has ended.

    The latter is dropped by its time to live or, in event time, by a timer.
    """

    def __init__(self, c: StateConfig, idle_ms: int | None, keep_ms: int | None, event_time: str | None):
        self.c, self.idle_ms, self.keep_ms, self.event_time = c, idle_ms, keep_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.machine = handle.getValueState("machine", STATE)
        self.ended = handle.getValueState("ended", "frame int", None if self.event_time else self.keep_ms)

    def at_timer(self, ms: int | None) -> None:
        """The one timer of the lecture."""
        for other in list(self.handle.listTimers()):
            self.handle.deleteTimer(other)
        if ms is not None:
            self.handle.registerTimer(int(ms))

    def end(self, machine: StateMachine, now: int) -> list[tuple]:
        made = machine.end()
        self.machine.clear()
        self.ended.update((machine.state_[9],))
        if self.event_time or self.idle_ms is not None:
            self.at_timer(now + self.keep_ms if self.event_time and self.keep_ms is not None else None)
        return [(*made, "EMITTED")] if made is not None else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows)).sort_values(["timestamp_seconds", "frame_index"], kind="stable")
        over, machine = self.ended.exists(), StateMachine(self.c, self.machine.get() if self.machine.exists() else None)
        out, now = [], int(rows[self.event_time].max().timestamp() * 1000) if self.event_time else int(time() * 1000)
        for r in rows[COLUMNS].itertuples(index=False):
            if r.kind == "END":
                out += [] if over else self.end(machine, now)
                over = True
            elif over or machine.state_[9] is not None and r.frame_index <= machine.state_[9]:
                out.append((-1, int(r.frame_index), float(r.timestamp_seconds), "LATE", 0.0, r.kind, 0.0, 0, False, "REJECTED"))
            elif (made := machine.add(*r)) is not None:
                out.append((*made, "EMITTED"))
        if not over:
            self.machine.update(tuple(machine.state_))
            if self.idle_ms is not None:
                self.at_timer(now + self.idle_ms)
        yield pd.DataFrame([(key[0], *o) for o in out], columns=OUT_NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.machine.exists():  # no rows for so long: the lecture is over
            out = self.end(StateMachine(self.c, self.machine.get()), expiredTimerInfo.getExpiryTimeInMs())
        else:
            self.ended.clear()
        yield pd.DataFrame([(key[0], *o) for o in out], columns=OUT_NAMES)


def stable_states_stream(changes: DataFrame, c: StateConfig = StateConfig(), idle_ms: int | None = None, keep_ms: int | None = None, event_time: str | None = None) -> DataFrame:
    """States of a stream of change rows; rows behind the last one seen, or behind the lecture's end, come out with status REJECTED.

    With ``idle_ms`` a lecture without rows for that long is over.  That a lecture
    has ended (one number) is remembered for ``keep_ms``, or for good.  Times are
    the clock's or, with ``event_time`` (a column with a watermark), the rows' own;
    rows behind the watermark are dropped by Spark then (split_late() puts them
    aside).  A query with times by the clock goes on until it is stopped: under
    availableNow it would never end.  Start the query within rocksdb().
    """
    mode = "EventTime" if event_time else "None" if idle_ms is None and keep_ms is None else "ProcessingTime"
    used = changes.select("video_id", *COLUMNS, *([event_time] if event_time else []))
    return used.groupBy("video_id").transformWithStateInPandas(StableStates(c, idle_ms, keep_ms, event_time), OUT, "append", mode)


def busy_rows(changes: DataFrame) -> DataFrame:
    return changes.where("kind <> 'NONE'")


def activity_sessions_stream(changes: DataFrame, gap: str = "1 second") -> DataFrame:
    """Sessions of changes with event time ``at``: closed by ``gap`` without activity once the watermark has passed."""
    busy = busy_rows(changes).withWatermark("at", "0 seconds")
    return busy.groupBy("video_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n")).select("video_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def split_late(rows: DataFrame, on_time: str, late: str, gap: str = "1 second"):
    """A writer that parts the rows of a stream: those that activity_sessions_stream would take, and those behind its watermark.

    A row is late when its session would have ended by the largest ``at`` of the
    micro-batches before.  That time is written with each micro-batch, so one that
    is run again after a failure is parted as before, and what it had written as a
    whole is left as it is.  Both folders are Parquet, a part for each micro-batch (``epoch``); a stream
    that reads ``on_time`` drops nothing, and the two folders together hold all rows.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        marks = f"{on_time}-marks"

        def put(df: DataFrame, path: str) -> None:
            if not exists(spark, f"{path}/epoch={epoch}/_SUCCESS"):
                df.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

        # One row for each micro-batch; those of later ones are what a run that failed left behind.
        known = spark.read.schema("mark timestamp, epoch long").parquet(marks) if epoch else None
        mark = known.where(F.col("epoch") < epoch).agg(F.max("mark")).first()[0] if epoch else None
        batch = batch.withColumn("__late", F.lit(False) if mark is None else F.col("at") + F.expr(f"INTERVAL {gap}") <= F.lit(mark))
        batch.persist()
        try:
            put(batch.where("NOT __late").drop("__late"), on_time)
            put(batch.where("__late").drop("__late"), late)
            put(batch.agg(F.max("at").alias("mark")), marks)
        finally:
            batch.unpersist()

    return busy_rows(rows).writeStream.foreachBatch(step)


def in_thirds(order: str) -> Column:
    """The part of each row when a lecture is handed out in three by ascending ``order``."""
    return F.ntile(3).over(Window.partitionBy("video_id").orderBy(order))


def handed_out(df: DataFrame, part: Column, parts: int) -> Iterator[str]:
    """The folder to read as a stream, after each of the parts 1 to ``parts`` was added to it."""
    source, numbered = scratch_path(df.sparkSession, "stream-in"), df.withColumn("part", part)
    for number in range(1, parts + 1):
        numbered.where(F.col("part") == number).drop("part").write.mode("append").parquet(source)
        yield source


def replay(df: DataFrame, part: Column, parts: int, transform) -> DataFrame:
    """Run a streaming ``transform`` over ``df``, handed out in micro-batches 1 to ``parts``; the rows of its sink."""
    spark: SparkSession = df.sparkSession
    sink = scratch_path(spark, "stream-out")
    with rocksdb(spark):
        for source in handed_out(df, part, parts):  # each run takes up what the last one left: its state and its place in the files
            out = transform(spark.readStream.schema(df.schema).parquet(source))
            query = out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", f"{sink}-state").trigger(availableNow=True).start()
            query.awaitTermination()
    return spark.read.schema(out.schema).parquet(sink)


def replay_split(df: DataFrame, part: Column, parts: int, gap: str = "1 second") -> tuple[DataFrame, DataFrame]:
    """(on time, late) rows of ``df``, handed out in micro-batches 1 to ``parts``."""
    spark: SparkSession = df.sparkSession
    on_time, late = scratch_path(spark, "on-time"), scratch_path(spark, "late")
    for source in handed_out(df, part, parts):
        stream = spark.readStream.schema(df.schema).parquet(source)
        split_late(stream, on_time, late, gap).option("checkpointLocation", f"{on_time}-place").trigger(availableNow=True).start().awaitTermination()
    return tuple(spark.read.schema(df.schema).parquet(path) for path in (on_time, late))
