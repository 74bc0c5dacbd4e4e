"""Streams: what is held and freed, late rows, timers."""

import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from chalkline.operators import changes as chg
from chalkline.sources.scratch import scratch_path
from chalkline.streaming import states as stream

CHANGES = "video_id string, previous_frame_index int, frame_index int, previous_timestamp_seconds double, timestamp_seconds double, kind string, change_score double, changed_pixel_ratio double"


def change_rows(kinds, video, first=0):
    return [(video, first + i, first + i + 1, (first + i) / 10, (first + i + 1) / 10, k, 3.0, 0.01) for i, k in enumerate(kinds)]


class Runs:
    """A stream that is run over files as they are added; each run takes up where the last one stopped."""

    def __init__(self, spark, schema, transform):
        self.spark, self.transform, self.schema = spark, transform, schema
        self.source, self.sink = scratch_path(spark, "in"), scratch_path(spark, "out")

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.source)

    def run(self):
        """The last progress that has figures of the state."""
        out = self.transform(self.spark.readStream.schema(self.spark.createDataFrame([], self.schema).schema).parquet(self.source))
        query = out.writeStream.format("parquet").option("path", self.sink).option("checkpointLocation", f"{self.sink}-state").trigger(availableNow=True).start()
        query.awaitTermination()
        self.schema_out = out.schema
        return [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]

    def rows(self):
        return self.spark.read.schema(self.schema_out).parquet(self.sink).collect()


def test_state_is_freed_after_the_end_and_late_rows_are_rejected(spark):
    kinds = ["LOCAL", "SCENE", "NONE"] * 4
    with stream.rocksdb(spark):
        runs = Runs(spark, CHANGES, lambda df: stream.stable_states_stream(df))
        runs.add(change_rows(kinds, "a") + change_rows(kinds, "b"))
        held = runs.run()[-1]["numRowsTotal"]
        runs.add(change_rows(["END"], "a", 12) + change_rows(["END"], "b", 12))
        after = runs.run()[-1]["numRowsTotal"]
        runs.add(change_rows(["SCENE", "LOCAL", "END"], "a", 3))  # after the end
        runs.run()
    got = runs.rows()
    assert held == after == 2  # a machine each, then one number each
    assert sorted((r.video_id, r.frame_index) for r in got if r.status == "REJECTED") == [("a", 4), ("a", 5)]
    batch = chg.stable_states(spark.createDataFrame(change_rows(kinds, "a") + change_rows(kinds, "b"), CHANGES))
    assert sorted(tuple(r)[:-1] for r in got if r.status == "EMITTED") == sorted(tuple(r) for r in batch.collect())


def test_nothing_is_held_when_all_lectures_have_ended(spark):
    """What is kept of a lecture that has ended goes by its time to live; by the clock, so the query is stopped."""
    source, sink = scratch_path(spark, "ended-in"), scratch_path(spark, "ended-out")
    rows = spark.createDataFrame(change_rows(["LOCAL", "SCENE", "END"], "a") + change_rows(["LOCAL", "END"], "b"), CHANGES)
    rows.write.parquet(source)
    with stream.rocksdb(spark):
        out = stream.stable_states_stream(spark.readStream.schema(rows.schema).parquet(source), keep_ms=500)
        query = out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", f"{sink}-state").trigger(processingTime="1 second").start()
        held, until = [], time.monotonic() + 60
        while (not held or held[-1] > 0) and time.monotonic() < until and query.isActive:
            time.sleep(1)
            held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        query.stop()
    assert held[-1] == 0
    assert sorted((r.video_id, r.frame_index) for r in spark.read.schema(out.schema).parquet(sink).collect()) == [("a", 2), ("b", 1)]


def test_an_idle_stream_ends_by_its_timer(spark):
    source, sink = scratch_path(spark, "idle-in"), scratch_path(spark, "idle-out")
    rows = spark.createDataFrame(change_rows(["LOCAL"] * 3, "a") + change_rows(["NONE"] * 3, "b"), CHANGES)
    rows.write.parquet(source)
    with stream.rocksdb(spark):
        out = stream.stable_states_stream(spark.readStream.schema(rows.schema).parquet(source), idle_ms=1)
        query = out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", f"{sink}-state").trigger(processingTime="1 second").start()
        got, until = [], time.monotonic() + 60
        while not got and time.monotonic() < until and query.isActive:
            time.sleep(2)
            if query.lastProgress:
                got = [(r.video_id, r.frame_index, r.reason) for r in spark.read.schema(out.schema).parquet(sink).where("video_id = 'a'").collect()]
        query.stop()
    assert got == [("a", 3, "END_OF_VIDEO_FALLBACK")]


def test_lectures_end_in_event_time(spark):
    """An idle time of ten seconds by the rows' own clock: the rows of another lecture pass it."""
    schema = CHANGES + ", at timestamp"
    stamped = lambda rows, base: [(*r, datetime.fromtimestamp(base + r[4])) for r in rows]
    transform = lambda df: stream.stable_states_stream(df.withWatermark("at", "0 seconds"), idle_ms=10_000, keep_ms=20_000, event_time="at")
    with stream.rocksdb(spark):
        runs = Runs(spark, schema, transform)
        runs.add(stamped(change_rows(["LOCAL"] * 3, "a"), 1_000))
        runs.run()
        runs.add(stamped(change_rows(["LOCAL"] * 2, "b"), 1_050))
        runs.run()
        runs.add(stamped(change_rows(["END"], "b", 2), 1_060))
        runs.run()
        runs.add(stamped(change_rows(["END"], "z"), 2_000))
        runs.run()
        runs.add(stamped(change_rows(["END"], "z"), 2_001))
        last = runs.run()
    got = [(r.video_id, r.frame_index, r.status) for r in runs.rows()]
    assert sorted(got) == [("a", 3, "EMITTED"), ("b", 2, "EMITTED")]
    assert last[-1]["numRowsTotal"] <= 2  # z, with its timer; nothing of a and b


@pytest.fixture
def clicks(spark):
    """Rows of two lectures in three parts; some of the later parts lie behind the largest time of the parts before."""
    rows, part = [], {}
    for number, times in enumerate(([1.0, 1.5, 9.0], [2.0, 2.6, 8.4, 9.5, 20.0], [9.9, 19.5, 30.0]), 1):
        for video in "ab":
            for t in times:
                rows.append((video, t, "LOCAL", number))
    rows.append(("a", 100.0, "NONE", 1))
    df = spark.createDataFrame(rows, "video_id string, t double, kind string, nth int")
    return df.withColumn("at", F.timestamp_micros((F.col("t") * 1e6).cast("long")))


def test_late_rows_of_sessions(spark, clicks):
    on_time, late = stream.replay_split(clicks, F.col("nth"), 3)
    times = lambda df: sorted((r.video_id, r.t) for r in df.collect())
    assert times(late) == [(v, t) for v in "ab" for t in (2.0, 2.6, 9.9)]
    assert sorted(times(late) + times(on_time)) == times(clicks.where("kind <> 'NONE'"))
    # The sessions are those of the plain stream, which drops as many rows without a word.
    runs = Runs(spark, "video_id string, t double, kind string, at timestamp", stream.activity_sessions_stream)
    dropped = 0
    for n in (1, 2, 3):
        clicks.where(F.col("nth") == n).drop("nth").coalesce(1).write.mode("append").parquet(runs.source)
        dropped += sum(p["numRowsDroppedByWatermark"] for p in runs.run())
    session = lambda rows: sorted((r.video_id, r.start, r.end, r.n) for r in rows)
    again = stream.replay(on_time.drop("nth"), F.lit(1), 1, stream.activity_sessions_stream)
    assert dropped == late.count()
    assert session(again.collect()) == session(runs.rows())
