"""Sequential rules over the rows of a lecture, in slices so that a long lecture is many tasks.

A lecture of no more than ``slice_rows`` rows is one group.  A longer one is cut
into slices, in order, and every slice is run from a guessed state.  What a slice
ends with is then what the next one has to start with: those whose guess was
another are run again from it, all at once, until all agree.  As each slice but
the first then starts where the one before it ended, the result is that of one
run over the whole lecture.  Rules forget: after some rows their state is the same
whatever they started with, so slices longer than that agree in the second round.
Lectures that still disagree after ``rounds`` are finished by one task each, which
reads their rows as a stream and holds the state alone.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chalkline.sources.scratch import scratch_path

#: Rows of a lecture that one task folds at once.
SLICE_ROWS = 1 << 16
KEY = ["video_id", "slice"]


@dataclass(frozen=True)
class Fold:
    """A rule: ``machine(state)`` has add(*row) and end(), which give rows of ``out``, and state(), which JSON can hold.

    ``state`` is null at a lecture's start, and is the guess for any other slice.
    A machine with ahead(rows) is shown the rows of its slice before they come.
    add() gets ``columns`` in ``order``; cut() gives the rows that end a slice
    which isn't the last, and end() those of the last.  What rows of ``out``
    accumulate begins anew with each slice: the caller puts the parts together.
    """

    machine: Callable
    columns: tuple[str, ...]
    order: tuple[str, ...]
    out: str

    @property
    def names(self) -> list[str]:
        return [x.split()[0] for x in self.out.split(", ")]


def write(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sliced(rows: DataFrame, fold: Fold, slice_rows: int = SLICE_ROWS, rounds: int = 4) -> DataFrame:
    """video_id, slice and nth (which order the rows), and the rows of ``fold.out``."""
    schema = f"video_id string, slice long, nth int, entry string, exit string, {fold.out}"
    names = ["video_id", "slice", "nth", "entry", "exit", *fold.names]
    used = list(dict.fromkeys(("video_id", *fold.order, *fold.columns)))
    rows = rows.select(*used)

    def frame(made: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(made, columns=names, dtype=object)

    def run(video: str, number: int, part: pd.DataFrame, entry: str | None, last: bool) -> pd.DataFrame:
        machine = fold.machine(json.loads(entry) if entry else None)
        rows = list(part.sort_values(list(fold.order), kind="stable")[list(fold.columns)].itertuples(index=False, name=None))
        if hasattr(machine, "ahead"):
            machine.ahead(rows)
        out = [o for r in rows for o in machine.add(*r)]
        out += machine.end() if last else machine.cut()
        none = (None,) * len(fold.names)
        return frame([(video, number, i, None, None, *o) for i, o in enumerate(out)] + [(video, number, -1, entry, json.dumps(machine.state()), *none)])

    short = rows.groupBy("video_id").count().where(F.col("count") > slice_rows).limit(1).count() == 0
    if short:
        whole = rows.groupBy("video_id").applyInPandas(lambda key, part: run(key[0], 0, part, None, True), schema)
        return whole.where("nth >= 0").drop("entry", "exit")

    placed = rows.repartitionByRange("video_id", *fold.order).withColumn("part", F.spark_partition_id().cast("long"))
    nth = F.row_number().over(Window.partitionBy("video_id", "part").orderBy(*fold.order)) - 1
    placed = write(placed.withColumn("slice", F.shiftleft("part", 32) + F.floor(nth / slice_rows)).drop("part"), "slices")
    along = Window.partitionBy("video_id").orderBy("slice")  # slices, not rows
    slices = write(placed.select(*KEY).distinct().withColumn("last", F.lead("slice").over(along).isNull()), "slice-ends")

    def again(key: tuple, part: pd.DataFrame, todo: pd.DataFrame) -> pd.DataFrame:
        if todo.empty:
            return frame([])
        return run(key[0], int(key[1]), part, todo.entry.iloc[0], bool(todo["last"].iloc[0]))

    def folded(todo: DataFrame) -> DataFrame:
        wanted = placed.join(todo.select(*KEY), KEY, "left_semi")
        return write(wanted.groupBy(*KEY).cogroup(todo.groupBy(*KEY)).applyInPandas(again, schema), "folded")

    now = folded(slices.withColumn("entry", F.lit(None).cast("string")))
    for _ in range(rounds):
        todo = write(disagreeing(now, slices), "disagreeing")
        if todo.isEmpty():
            return now.where("nth >= 0").drop("entry", "exit")
        now = now.join(todo.select(*KEY), KEY, "left_anti").unionByName(folded(todo))
    todo = disagreeing(now, slices)
    first = write(todo.groupBy("video_id").agg(F.min("slice").alias("since"), F.min_by("entry", "slice").alias("entry")), "unsettled")
    rest = placed.join(first, "video_id").where("slice >= since").join(slices, KEY).withColumn("entry", F.when(F.col("slice") == F.col("since"), F.col("entry"))).drop("since")

    def stream(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = machine = last = None
        n = 0

        def finish() -> list[tuple]:
            return [(*at, n + i, None, None, *o) for i, o in enumerate(machine.end() if last else machine.cut())]

        for batch in source:
            made = []
            for video, number, ends, entry, *r in batch[["video_id", "slice", "last", "entry", *fold.columns]].itertuples(index=False, name=None):
                if (video, number) != at:
                    if at:
                        made += finish()
                    carried = machine.state() if at and at[0] == video else json.loads(entry)
                    at, machine, last, n = (video, number), fold.machine(carried), ends, 0
                for o in machine.add(*r):
                    made.append((*at, n, None, None, *o))
                    n += 1
            yield frame(made)
        if at:
            yield frame(finish())

    done = rest.repartition("video_id").sortWithinPartitions("video_id", "slice", *fold.order).mapInPandas(stream, schema)
    kept = now.join(first.drop("entry"), "video_id", "left").where("since IS NULL OR slice < since").select(*now.columns)
    return kept.where("nth >= 0").unionByName(done).drop("entry", "exit")


def disagreeing(now: DataFrame, slices: DataFrame) -> DataFrame:
    """Slices that did not start with what the slice before them ended with, and what that is."""
    states = now.where("nth = -1").select(*KEY, F.col("entry").alias("guess"), "exit")
    entry = F.lag("exit").over(Window.partitionBy("video_id").orderBy("slice"))
    return states.withColumn("entry", entry).where(F.col("entry").isNotNull() & ~F.col("entry").eqNullSafe(F.col("guess"))).select(*KEY, "entry").join(slices, KEY)
