"""Visual changes: classes, scores, activity windows, stable states and their span metrics."""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.config import ChangeConfig, CoverageConfig, StateConfig
from chalkline.functions.bands import meet
from chalkline.functions.frames import VALUES, classify, measure
from chalkline.operators.folds import SLICE_ROWS, Fold, sliced


def in_order():
    """Rows of a lecture in order."""
    return Window.partitionBy("video_id").orderBy("timestamp_seconds", "frame_index")


STATES = (
    "video_id string, checkpoint_index int, frame_index int, timestamp_seconds double, reason string, stability_seconds double, source_change_kind string, "
    "max_change_score_since_previous double, activity_pair_count_since_previous int, protected_before_transition boolean"
)


def change_kind(mean: Column, ratio: Column, edge: Column, bbox: Column, c: ChangeConfig = ChangeConfig()) -> Column:
    """The first class that fits: NONE, SCENE, LOCAL, else STRUCTURAL."""
    quiet = (mean <= c.quiet_mean) & (ratio <= c.quiet_ratio) & (edge <= c.quiet_edge)
    local = (ratio <= c.local_ratio) & (bbox <= c.local_bbox) & (mean <= c.local_mean)
    return F.when(quiet, "NONE").when((ratio >= c.scene_ratio) | (mean >= c.scene_mean), "SCENE").when(local, "LOCAL").otherwise("STRUCTURAL")


def change_score(mean: Column, ratio: Column, edge: Column) -> Column:
    part = lambda x, full: F.least(F.lit(1.0), x / full)
    score = 100.0 * (0.35 * part(mean, 40.0) + 0.45 * part(ratio, 0.35) + 0.20 * part(edge, 0.20))
    return F.floor(score * 10000 + 0.5) / 10000


def is_strong(c: StateConfig = StateConfig()) -> Column:
    return (F.col("kind") == "SCENE") | (F.col("changed_pixel_ratio") >= c.strong_ratio) | (F.col("change_score") >= c.strong_score)


def change_clusters(changes: DataFrame, c: CoverageConfig = CoverageConfig()) -> DataFrame:
    """Sessions of large changes: a gap of more than ``cluster_gap`` seconds begins a new one."""
    strong = changes.where((F.col("kind") == "SCENE") | ((F.col("kind") == "STRUCTURAL") & (F.col("change_score") >= c.structural_score)))
    begins = F.coalesce(F.col("timestamp_seconds") - F.lag("timestamp_seconds").over(in_order()) > c.cluster_gap, F.lit(True))
    numbered = strong.withColumn("begins", begins.cast("int")).withColumn("cluster_index", F.sum("begins").over(in_order().rowsBetween(Window.unboundedPreceding, 0)) - 1)
    out = numbered.groupBy("video_id", "cluster_index").agg(
        F.min_by("previous_timestamp_seconds", F.struct("timestamp_seconds", "frame_index")).alias("start_seconds"),
        F.max("timestamp_seconds").alias("end_seconds"),
        F.max("change_score").alias("peak_score"),
        F.count_if(F.col("kind") == "SCENE").alias("scene_count"),
        F.count_if(F.col("kind") == "STRUCTURAL").alias("structural_count"),
    )
    return out.withColumns({"midpoint": (F.col("start_seconds") + F.col("end_seconds")) / 2, "cluster_index": F.col("cluster_index").cast("int")})


def merge_windows(windows: DataFrame, durations: DataFrame, before: float = 1.0, after: float = 2.0, gap: float = 2.0) -> DataFrame:
    """Padded activity windows of each lecture, merged where they are no more than ``gap`` apart."""
    padded = windows.join(durations, "video_id").withColumns({"lo": F.greatest(F.lit(0.0), F.col("start_seconds") - before), "hi": F.least("duration", F.col("end_seconds") + after)})
    order = Window.partitionBy("video_id").orderBy("lo", "hi", "window_index")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = padded.withColumn("begins", F.coalesce(F.col("lo") - reach > gap, F.lit(True)).cast("int"))
    islands = begins.withColumn("island", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("video_id", "island").agg(
        F.min("lo").alias("start_seconds"), F.max("hi").alias("end_seconds"), F.max("peak_score").alias("peak_score"),
        F.bool_or("scene_change").alias("scene_change"), F.bool_or("structural_change").alias("structural_change"), F.sum("coarse_sample_count").alias("coarse_sample_count"),
        F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("lo", "hi", "window_index", "reason"))), lambda x: x["reason"])).alias("reasons"),
    )
    return merged.withColumn("window_index", (F.col("island") - 1).cast("int")).drop("island")


ORDER = ("timestamp_seconds", "frame_index")


class WindowFold:
    """Activity windows of one lecture's samples in order: they end with the last activity before ``quiet_seconds`` of quiet.

    Activity is a STRUCTURAL or SCENE difference from the sample before or from
    the stable anchor, or a LOCAL one from the sample before that is the second in
    a run (a NONE pair ends the run) or comes with any difference from the anchor.
    """

    # A part of a window: whether it goes on with one of the slice before, start, end, peak, scene, structural, samples.
    PART = "goes_on boolean, start_seconds double, end_seconds double, peak_score double, scene_change boolean, structural_change boolean, coarse_sample_count long"

    def __init__(self, quiet_seconds: float, state: list | None = None):
        self.run, last = state or (0, None)
        self.quiet, self.now = quiet_seconds, None if last is None else (True, None, last, 0.0, False, False, 0)

    def add(self, before: float, at: float, pair: str, score: float, anchor: str = "NONE", anchor_score: float = 0.0) -> tuple[list[tuple], bool]:
        """Take a sample: (windows that it closed, whether it is the new anchor: it closed one, or nothing goes on and nothing changed)."""
        self.run = self.run + 1 if pair == "LOCAL" else 0 if pair == "NONE" else self.run
        kinds = {pair, anchor}
        if kinds & {"STRUCTURAL", "SCENE"} or pair == "LOCAL" and (self.run >= 2 or anchor != "NONE"):
            goes_on, start, _, peak, scene, structural, n = self.now or (False, before, at, 0.0, False, False, 0)
            self.now = (goes_on, start, at, max(peak, score, anchor_score), scene or "SCENE" in kinds, structural or "STRUCTURAL" in kinds, n + 1)
            return [], False
        if self.now is None:
            return [], pair == "NONE"
        if at - self.now[2] < self.quiet:
            return [], False
        return self.end(), True

    def end(self) -> list[tuple]:
        done, self.now = [self.now] if self.now else [], None
        return done

    def cut(self) -> list[tuple]:
        return [self.now] if self.now else []

    def state(self) -> list:
        return [min(self.run, 2), self.now and self.now[2]]


class PairWindows(WindowFold):
    """Windows of classified pairs: (time before, time, kind, score)."""

    def add(self, before: float, at: float, kind: str, score: float) -> list[tuple]:
        return super().add(before, at, kind, score)[0]


def joined_windows(parts: DataFrame) -> DataFrame:
    """The windows whose parts, in slices, these are."""
    number = F.sum((~F.col("goes_on")).cast("int")).over(Window.partitionBy("video_id").orderBy("slice", "nth").rowsBetween(Window.unboundedPreceding, 0)) - 1
    out = parts.withColumn("window_index", number.cast("int")).groupBy("video_id", "window_index").agg(
        F.min("start_seconds").alias("start_seconds"), F.max("end_seconds").alias("end_seconds"), F.max("peak_score").alias("peak"),
        F.bool_or("scene_change").alias("scene_change"), F.bool_or("structural_change").alias("structural_change"), F.sum("coarse_sample_count").alias("coarse_sample_count"),
    )
    reason = F.when(F.col("scene_change"), "SCENE_TRANSITION").when(F.col("structural_change"), "STRUCTURAL_ACTIVITY").otherwise("PERSISTENT_LOCAL_CHANGE")
    return out.select("video_id", "window_index", "start_seconds", "end_seconds", F.round("peak", 4).alias("peak_score"), "scene_change", "structural_change", "coarse_sample_count", reason.alias("reason"))


def coarse_windows(changes: DataFrame, quiet_seconds: float = 1.0, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Activity windows of classified pairs, where there are no frames to compare with an anchor."""
    columns = ("previous_timestamp_seconds", "timestamp_seconds", "kind", "change_score")
    return joined_windows(sliced(changes, Fold(partial(PairWindows, quiet_seconds), columns, ORDER, WindowFold.PART), slice_rows))


class FrameWindows:
    """Windows of frames, each compared with the one before and with the anchor; both are part of the state.

    The frames of a slice are known ahead and are compared in blocks.
    """

    def __init__(self, width: int, edge: float, c: ChangeConfig, quiet_seconds: float, state: list | None = None):
        self.at, last, anchor, windows = state or (None, None, None, None)
        self.windows, self.width, self.edge, self.c = WindowFold(quiet_seconds, windows), width, edge, c
        self.last, self.anchor = (None if x is None else self.frame(x) for x in (last, anchor))
        self.ahead_: list[np.ndarray] = []
        self.place, self.steps, self.apart = 0, {}, {}  # frames taken; differences of frames ahead from the one before and from the anchor

    def frame(self, thumb) -> np.ndarray:
        return np.asarray(thumb, np.float64).reshape(-1, self.width)

    def ahead(self, rows: list[tuple]) -> None:
        self.ahead_ = [self.frame(thumb) for _, thumb in rows]

    def differ(self, before: np.ndarray, after: np.ndarray) -> list[tuple[str, float]]:
        return classify(measure(before, after, self.edge, self.c.pixel_delta), self.c)

    def block(self, now: np.ndarray, most: int) -> np.ndarray:
        """The frame and those known ahead that are compared with it at once."""
        size = max(1, min(most, VALUES // now.size))
        return np.stack(self.ahead_[self.place : self.place + size] or [now])

    def step(self, now: np.ndarray) -> tuple[str, float]:
        if self.place not in self.steps:
            after = self.block(now, 256)
            self.steps = dict(enumerate(self.differ(np.concatenate([self.last[None], after[:-1]]), after), self.place))
        return self.steps[self.place]

    def from_anchor(self, now: np.ndarray) -> tuple[str, float]:
        if self.place not in self.apart:
            after = self.block(now, 16)
            self.apart = dict(enumerate(self.differ(self.anchor[None], after), self.place))
        return self.apart[self.place]

    def add(self, at: float, thumb) -> list[tuple]:
        now, out = self.frame(thumb), []
        if self.last is None:
            self.anchor = now
        else:
            pair = self.step(now)
            # The anchor is the frame before as long as nothing changes.
            out, moves = self.windows.add(self.at, at, *pair, *(pair if self.anchor is self.last else self.from_anchor(now)))
            if moves:
                self.anchor, self.apart = now, {}
        self.last, self.at, self.place = now, at, self.place + 1
        return out

    def end(self) -> list[tuple]:
        return self.windows.end()

    def cut(self) -> list[tuple]:
        return self.windows.cut()

    def state(self) -> list:
        return [self.at, self.last.ravel().tolist(), self.anchor.ravel().tolist(), self.windows.state()]


#: Frames of a lecture that one task folds at once: about a hundred MB of frames of 160 x 90.
FRAME_ROWS = 1_024


def anchored_windows(frames: DataFrame, width: int, edge: float, c: ChangeConfig = ChangeConfig(), quiet_seconds: float = 1.0, slice_rows: int = FRAME_ROWS) -> DataFrame:
    """Activity windows of sampled frames (video_id, frame_index, timestamp_seconds, thumb), each compared with the one before and with the stable anchor.

    The anchor catches slow writing, no step of which is a change of its own.
    """
    fold = Fold(partial(FrameWindows, width, edge, c, quiet_seconds), ("timestamp_seconds", "thumb"), ORDER, WindowFold.PART)
    return joined_windows(sliced(frames, fold, slice_rows))


METRICS = ("mean_pixel_delta", "edge_change_ratio", "change_bbox_area_ratio")


class Sentinels:
    """Rows of one lecture: the pairs within its windows, in order, and quiet rows over the time between.

    A row of role WINDOW opens a window, and the pairs within it follow as rows of
    role PAIR; a lecture without windows has one row of role NOTHING.
    """

    OUT = (
        "previous_frame_index int, frame_index int, previous_timestamp_seconds double, timestamp_seconds double, "
        "activity_window_index int, kind string, change_score double, changed_pixel_ratio double, delta_seconds double, mean_pixel_delta double, edge_change_ratio double, change_bbox_area_ratio double"
    )
    NOTHING, WINDOW, PAIR = range(3)
    ORDER = ("window_start", "window_index", "role", "at", "number")
    COLUMNS = ("frames", "duration", "role", "window_index", "window_start", "number_before", "number", "at_before", "at", "kind", "change_score", "changed_pixel_ratio", *METRICS)

    def __init__(self, stable: float, state: list | None = None):
        # up to where rows were made, and the last pair's frame in this window
        self.at, self.frame, self.made, self.previous = state or (0.0, 0, False, None)
        self.stable = stable

    def row(self, previous: int, target: int, since: float, until: float, window: int | None = None, kind: str = "NONE", score: float = 0.0, ratio: float = 0.0, metrics: tuple = (0.0,) * len(METRICS)) -> tuple:
        self.at, self.frame, self.made = float(until), int(target), True
        return int(previous), int(target), float(since), float(until), window, kind, score, ratio, round(max(0.0, float(until) - float(since)), 6), *metrics

    def bridge(self, until: float, target: int) -> list[tuple]:
        target = min(max(target, self.frame + 1), self.last)
        return [self.row(self.frame, target, self.at, until)] if until > self.at and target > self.frame else []

    def placed(self, number: int, seconds: float) -> int:
        return min(max(number, self.frame + 1) if self.made and seconds > self.at else number, self.last)

    def add(self, frames: int, duration: float, role: int, window: int, start: float, number_before: int, number: int, at_before: float, at: float, kind: str, score: float, ratio: float, *metrics: float) -> list[tuple]:
        self.last, self.duration, self.fps = max(int(frames) - 1, 0), float(duration), int(frames) / float(duration)
        if role == self.NOTHING:
            return []
        if role == self.WINDOW:
            self.previous = None
            return self.bridge(float(start), round(float(start) * self.fps) - 1) if start - self.at >= self.stable else []
        if self.previous is None:
            self.previous = int(self.placed(number_before, at_before))
        now = int(self.placed(number, at))
        previous, target = self.previous, min(max(self.previous + 1, now), self.last)
        self.previous = now
        if target > previous and target > self.frame and at_before >= self.at:
            return [self.row(previous, target, at_before, at, int(window), kind, score, ratio, metrics)]
        return []

    def end(self) -> list[tuple]:
        out = []
        if not self.made:
            until = min(self.duration, max(self.stable, 0.1))
            out.append(self.row(0, min(max(1, round(until * self.fps)), max(1, self.last)), 0.0, until))
        if self.duration - self.at >= self.stable:
            until = min(self.duration, max(self.at, self.last / max(self.fps, 0.001)))
            out += self.bridge(until, round(until * self.fps))
        return out

    def cut(self) -> list[tuple]:
        return []

    def state(self) -> list:
        return [self.at, self.frame, self.made, self.previous]


def quiet_sentinels(windows: DataFrame, fine_pairs: DataFrame, timeline: DataFrame, c: StateConfig = StateConfig(), slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Pairs within the activity windows, and one quiet row for each longer stretch between them that was not looked at.

    ``timeline`` has frame_count and duration_seconds of each lecture; a lecture
    without windows gets quiet rows only.  Times are compared unrounded.  Metrics
    that the pairs lack, and those of quiet rows, are 0.
    """
    lectures = timeline.where("duration_seconds > 0 AND NOT isnan(duration_seconds)").select("video_id", F.col("frame_count").alias("frames"), F.col("duration_seconds").alias("duration"))
    own = windows.select("video_id", F.col("window_index").cast("int").alias("window_index"), F.col("start_seconds").alias("window_start"), F.col("end_seconds").alias("window_end"))
    spans = lectures.join(own, "video_id", "left")
    pairs = fine_pairs.select(
        "video_id", F.col("previous_frame_index").alias("number_before"), F.col("frame_index").alias("number"), F.col("previous_timestamp_seconds").alias("at_before"), F.col("timestamp_seconds").alias("at"),
        "kind", "change_score", "changed_pixel_ratio", *(m if m in fine_pairs.columns else F.lit(0.0).alias(m) for m in METRICS),
    )
    at, start = F.col("at"), F.col("window_start")
    inside = meet(spans, pairs, (start, F.col("window_end")), (at, at), 64.0).where(F.col("at_before") >= start).withColumn("role", F.lit(Sentinels.PAIR))
    # Whole numbers are 0 in these rows, not null, which pandas makes floats of.
    whole = {"window_index": F.coalesce("window_index", F.lit(0)), "number_before": F.lit(0), "number": F.lit(0), "role": F.when(start.isNull(), Sentinels.NOTHING).otherwise(Sentinels.WINDOW)}
    rows = inside.unionByName(spans.withColumns(whole), allowMissingColumns=True)
    return sliced(rows, Fold(partial(Sentinels, c.stable_seconds), Sentinels.COLUMNS, Sentinels.ORDER, Sentinels.OUT), slice_rows).drop("slice", "nth")


CHANGE_COLUMNS = ("previous_frame_index", "frame_index", "previous_timestamp_seconds", "timestamp_seconds", "kind", "change_score", "changed_pixel_ratio")


class StateMachine:
    """The checkpoint rules, one lecture's rows in order; usable row by row (batch and stream share it)."""

    # state: pending, had_change, quiet_start, last_ts, last_frame, max_score, n_changes, last_kind, emitted, last row seen
    START = (True, False, None, None, -1, 0.0, 0, "NONE", 0, None, None)

    def __init__(self, c: StateConfig, state: tuple | None = None):
        self.c = c
        self.state_ = list(state or self.START)

    def _emit(self, frame: int, at: float, reason: str, stability: float, protected: bool) -> tuple:
        s = self.state_
        row = (s[8], int(frame), float(at), reason, round(max(0.0, stability), 6), s[7], float(s[5]), int(s[6]), protected)
        s[3], s[4], s[5], s[6], s[8] = float(at), int(frame), 0.0, 0, s[8] + 1
        return row

    def _may(self, frame: int, at: float) -> bool:
        return frame > self.state_[4] and (self.state_[3] is None or at - self.state_[3] >= self.c.minimum_gap_seconds)

    def add(self, previous_frame: int, frame: int, previous_at: float, at: float, kind: str, score: float, ratio: float) -> tuple | None:
        s, c, row = self.state_, self.c, None
        s[9], s[10] = int(frame), float(at)
        if kind == "NONE":
            if s[2] is None:
                s[2] = float(previous_at)
            if s[0] and at - s[2] >= c.stable_seconds and self._may(frame, at):
                row = self._emit(frame, at, "STABLE_AFTER_CHANGE" if s[1] or s[8] else "INITIAL_STABLE", at - s[2], False)
                s[0], s[1], s[7] = False, False, "NONE"
            return row
        strong = kind == "SCENE" or ratio >= c.strong_ratio or score >= c.strong_score
        if strong and s[0] and s[2] is not None and previous_at - s[2] >= c.protection_seconds and self._may(previous_frame, previous_at):
            row = self._emit(previous_frame, previous_at, "PRE_TRANSITION_PROTECTION", previous_at - s[2], True)
        s[0], s[1], s[2], s[5], s[6], s[7] = True, True, None, max(s[5], float(score)), s[6] + 1, kind
        return row

    def end(self) -> tuple | None:
        s = self.state_
        if s[9] is not None and s[0] and self._may(s[9], s[10]):
            return self._emit(s[9], s[10], "END_OF_VIDEO_FALLBACK", s[10] - s[2] if s[2] is not None else 0.0, True)
        return None


class StateSlices(StateMachine):
    """The machine over a slice: what it sums up since the last checkpoint starts anew, the rest goes on."""

    OUT = "frame_index int, timestamp_seconds double, reason string, stability_seconds double, kind string, max_score double, n_changes int, protected boolean"

    def add(self, *row) -> list[tuple]:
        made = super().add(*row)
        return [] if made is None else [made[1:]]

    def end(self) -> list[tuple]:
        made = super().end()
        return [] if made is None else [made[1:]]

    def cut(self) -> list[tuple]:
        """What the slice adds to a checkpoint of a later one."""
        return [(None, None, None, None, None, float(self.state_[5]), int(self.state_[6]), None)]

    def state(self) -> list:
        s = list(self.state_)
        s[5], s[6], s[8] = 0.0, 0, min(s[8], 1)
        return s


def stable_states(changes: DataFrame, c: StateConfig = StateConfig(), slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Checkpoints of each lecture: a sequential fold."""
    parts = sliced(changes, Fold(partial(StateSlices, c), CHANGE_COLUMNS, ORDER, StateSlices.OUT), slice_rows)
    # Parts without a checkpoint belong to the next one.
    before = F.count("reason").over(Window.partitionBy("video_id").orderBy("slice", "nth").rowsBetween(Window.unboundedPreceding, -1))
    found = lambda name: F.max(name).alias(name)  # noqa: E731  (one checkpoint a group)
    out = parts.withColumn("checkpoint_index", before.cast("int")).groupBy("video_id", "checkpoint_index").agg(
        *map(found, ("frame_index", "timestamp_seconds", "reason", "stability_seconds")), F.max("kind").alias("source_change_kind"), F.max("max_score").alias("max_change_score_since_previous"),
        F.sum("n_changes").cast("int").alias("activity_pair_count_since_previous"), F.max("protected").alias("protected_before_transition"),
    )
    return out.where("reason IS NOT NULL").select(*(x.split()[0] for x in STATES.split(", ")))


def clamp_states(states: DataFrame, timeline: DataFrame) -> DataFrame:
    """Frames and times within the video, strictly increasing; a lecture without a state gets its last frame."""
    last, order = F.col("frame_count") - 1, Window.partitionBy("video_id").orderBy("checkpoint_index")
    inside = states.join(timeline, "video_id").withColumns({"frame_index": F.least("frame_index", last.cast("int")), "timestamp_seconds": F.least("timestamp_seconds", "duration_seconds")})
    kept = inside.withColumn("before", F.max("frame_index").over(order.rowsBetween(Window.unboundedPreceding, -1))).where(F.col("before").isNull() | (F.col("frame_index") > F.col("before")))
    kept = kept.select("video_id", (F.row_number().over(order) - 1).alias("checkpoint_index"), "frame_index", "timestamp_seconds", "reason", "source_change_kind", "protected_before_transition")
    none = timeline.join(states.select("video_id").distinct(), "video_id", "left_anti").select(
        "video_id", F.lit(0).alias("checkpoint_index"), last.cast("int").alias("frame_index"), F.col("last_timestamp_seconds").alias("timestamp_seconds"),
        F.lit("END_OF_VIDEO_FALLBACK").alias("reason"), F.lit("NONE").alias("source_change_kind"), F.lit(True).alias("protected_before_transition"),
    )
    return kept.unionByName(none)


def span_metrics(changes: DataFrame, states: DataFrame) -> DataFrame:
    """For each checkpoint the largest score and the number of changes since the one before."""
    marks = states.select("video_id", "frame_index", "checkpoint_index")
    # From the last row back: a window that ends with the partition is summed up anew for each row.
    back = Window.partitionBy("video_id").orderBy(F.desc("timestamp_seconds"), F.desc("frame_index")).rowsBetween(Window.unboundedPreceding, 0)
    rows = changes.join(marks, ["video_id", "frame_index"], "left").withColumn("next", F.min("checkpoint_index").over(back))
    busy = F.col("kind") != "NONE"
    return rows.where(F.col("next").isNotNull()).groupBy("video_id", F.col("next").alias("checkpoint_index")).agg(
        F.coalesce(F.max(F.when(busy, F.col("change_score"))), F.lit(0.0)).alias("max_score"), F.count_if(busy).alias("change_count")
    )


class Repair:
    def __init__(self, state: list | None = None):
        self.last = state[0] if state else 0.0

    def add(self, frame: int, raw: float, fps: float) -> list[tuple]:
        t = raw if raw > 0 else frame / fps
        self.last = max(self.last, frame / fps if t < self.last else t)
        return [(frame, self.last)]

    def end(self) -> list[tuple]:
        return []

    cut = end

    def state(self) -> list:
        return [float(self.last)]


def repair_timestamps(frames: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """frame_index, raw, fps -> timestamp: raw where it is positive and not behind the last, else index / fps."""
    fold = Fold(Repair, ("frame_index", "raw", "fps"), ("frame_index",), "frame_index int, timestamp_seconds double")
    return sliced(frames, fold, slice_rows).drop("slice", "nth")
