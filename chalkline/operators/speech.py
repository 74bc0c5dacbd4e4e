"""Speech segments, their alignment with screenshots, topics and titles."""

from __future__ import annotations

from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chalkline.config import TopicConfig
from chalkline.functions import text as tx
from chalkline.functions.bands import meet
from chalkline.operators.folds import SLICE_ROWS, Fold, sliced


def in_order():
    """Rows of a lecture in order."""
    return Window.partitionBy("video_id").orderBy("segment_index")


def clean_segments(raw: DataFrame) -> DataFrame:
    """Segments of raw rows (video_id, raw_index, start, end, text): times not negative or reversed, no blank text."""
    t = F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    start = F.greatest(F.lit(0.0), F.col("start"))
    rows = raw.select("video_id", "raw_index", F.round(start, 6).alias("start_seconds"), F.round(F.greatest(start, F.col("end")), 6).alias("end_seconds"), t.alias("text")).where(F.col("text") != "")
    index = F.row_number().over(Window.partitionBy("video_id").orderBy("raw_index")) - 1
    return rows.select("video_id", index.cast("int").alias("segment_index"), "start_seconds", "end_seconds", "text")


def align(trusted: DataFrame, segments: DataFrame, c: TopicConfig = TopicConfig()) -> DataFrame:
    """For each screenshot the segments that overlap [t - before, t + after], closed on both sides."""
    lo, hi = F.greatest(F.lit(0.0), F.col("timestamp_seconds") - c.before_seconds), F.col("timestamp_seconds") + c.after_seconds
    near = trusted.select("video_id", "trusted_index", "candidate_index", "timestamp_seconds", lo.alias("context_start_seconds"), hi.alias("context_end_seconds"))
    pairs = meet(near.select("video_id", "trusted_index", "context_start_seconds", "context_end_seconds"), segments, (F.col("context_start_seconds"), F.col("context_end_seconds")), (F.col("start_seconds"), F.col("end_seconds")), 32.0)
    found = pairs.groupBy("video_id", "trusted_index").agg(F.sort_array(F.collect_list(F.struct("segment_index", "text"))).alias("parts"))
    out = near.join(found, ["video_id", "trusted_index"], "left").withColumn("parts", F.coalesce("parts", F.array().cast("array<struct<segment_index:int,text:string>>")))
    said = F.filter(F.transform("parts", lambda x: x["text"]), lambda x: F.btrim(x) != "")
    return out.select(*near.columns, F.transform("parts", lambda x: x["segment_index"]).alias("segment_indexes"), F.array_join(said, " ").alias("text"))


def near_visual_signal(segments: DataFrame, trusted: DataFrame, signals: DataFrame, c: TopicConfig = TopicConfig()) -> DataFrame:
    """Segments that start within ``visual_seconds`` of a trusted screenshot of a signal candidate."""
    at, start = F.col("timestamp_seconds"), F.col("start_seconds")
    shown = trusted.join(signals, ["video_id", "candidate_index"]).select("video_id", "timestamp_seconds")
    # The buckets are a little wider than the band, which the difference itself decides.
    pairs = meet(segments.select("video_id", "segment_index", "start_seconds"), shown, (start, start), (at - c.visual_seconds - 0.001, at + c.visual_seconds + 0.001), 2 * c.visual_seconds)
    return pairs.where(F.abs(at - start) <= c.visual_seconds).select("video_id", "segment_index").distinct()


def boundary_scores(segments: DataFrame, near: DataFrame, c: TopicConfig = TopicConfig()) -> DataFrame:
    """How likely a topic begins with each segment but the first."""
    words = lambda lo, hi: F.array_distinct(F.flatten(F.collect_list("tokens").over(in_order().rowsBetween(lo, hi))))
    rows = segments.select("video_id", "segment_index", F.col("start_seconds").alias("timestamp_seconds"), F.array_distinct(tx.speech_tokens(F.col("text"))).alias("tokens"), tx.is_cue(F.col("text")).alias("cue"), (F.col("start_seconds") - F.lag("end_seconds").over(in_order())).alias("gap"))
    rows = rows.withColumns({"left": words(-c.window, -1), "right": words(0, c.window - 1)})
    enough = (F.size("left") >= c.lexical_tokens) & (F.size("right") >= c.lexical_tokens)
    rows = rows.withColumn("novelty", F.when(enough, 1 - tx.jaccard(F.col("left"), F.col("right")))).drop("tokens", "left", "right")  # the join gets numbers, not words
    rows = rows.join(near.withColumn("visual", F.lit(True)), ["video_id", "segment_index"], "left").where("segment_index >= 1")
    score = (
        F.when(F.col("gap") >= c.long_gap, 0.9).when(F.col("gap") >= c.gap, 0.55).otherwise(0.0)
        + F.when(F.col("cue"), 0.65).otherwise(0.0)
        + F.coalesce(0.55 * F.col("novelty"), F.lit(0.0))
        + F.when(F.col("visual"), 0.5).otherwise(0.0)
    )
    reasons = F.array_compact(F.array(
        F.when(F.col("gap") >= c.long_gap, "LONG_SPEECH_GAP").when(F.col("gap") >= c.gap, "SPEECH_GAP"),
        F.when(F.col("cue"), "TRANSITION_PHRASE"),
        F.when(F.col("novelty") >= c.novelty, "VOCABULARY_SHIFT"),
        F.when(F.col("visual"), "VISUAL_SECTION_CHANGE"),
    ))
    return rows.select("video_id", "segment_index", "timestamp_seconds", F.round(score, 6).alias("score"), reasons.alias("reasons"))


class Boundaries:
    """The boundaries of one lecture, its rows in order.

    The best of the rows seen is kept as they come: a row's distance from the
    section's start is fixed until a boundary is taken, and only then are the
    rows behind that boundary looked at again.
    """

    OUT = "segment_index int, timestamp_seconds double, score double, reasons array<string>"

    def __init__(self, c: TopicConfig, state: list | None = None):
        # last, pending: segments from which on rows may be taken: any, and strong ones; held: the rows since the last boundary
        self.c, self.best, self.pool = c, None, None
        self.start, self.last, self.pending, self.held = state or (None, 0, 0, [])
        for row in self.held:
            self.see(row)

    def see(self, row: list) -> None:
        index, at, score, _ = row
        if at - self.start < self.c.min_seconds:
            return
        if index > self.pending and score >= self.c.threshold and (self.best is None or (score, at) > (self.best[2], self.best[1])):
            self.best = row
        if index > self.last and (self.pool is None or score > self.pool[2]):  # the earliest of equals
            self.pool = row

    def add(self, index: int, at: float, score: float, reasons: list, first: float) -> list[tuple]:
        self.start = first if self.start is None else self.start
        row = [int(index), float(at), float(score), list(reasons)]
        self.held.append(row)
        self.see(row)
        taken = None
        if self.best is not None and at - self.start >= self.c.min_seconds:
            taken, behind, why = self.best, self.best[0], self.best[3]
        elif self.pool is not None and at - self.start >= self.c.max_seconds:
            taken, behind, why = self.pool, row[0], self.pool[3] or ["MAX_SECTION_DURATION"]
        if taken is None:
            return []
        at_taken = next(i for i, x in enumerate(self.held) if x is taken)
        self.start, self.last, self.pending, self.best, self.pool, self.held = taken[1], taken[0], behind, None, None, self.held[at_taken + 1 :]
        for x in self.held:
            self.see(x)
        return [(*taken[:3], why)]

    def end(self) -> list[tuple]:
        return []

    cut = end

    def state(self) -> list:
        return [self.start, self.last, self.pending, self.held]


def choose_boundaries(scores: DataFrame, first_start: DataFrame, c: TopicConfig = TopicConfig(), slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The boundaries taken: strong ones once a section is long enough, the best at hand once it is too long."""
    fold = Fold(partial(Boundaries, c), ("segment_index", "timestamp_seconds", "score", "reasons", "first_start"), ("segment_index",), Boundaries.OUT)
    return sliced(scores.join(first_start, "video_id"), fold, slice_rows).drop("slice", "nth")


def topic_of_segments(segments: DataFrame, starts: DataFrame) -> DataFrame:
    """video_id, segment_index, topic_index: the last of ``starts`` (segment_start_index, topic_index) at or before each segment.

    Starts and segments stand in one order and the last start is carried along.
    """
    begin = starts.select("video_id", F.col("segment_start_index").alias("segment_index"), F.lit(0).alias("role"), "topic_index")
    rows = begin.unionByName(segments.select("video_id", "segment_index", F.lit(1).alias("role"), F.lit(None).cast("int").alias("topic_index")))
    order = Window.partitionBy("video_id").orderBy("segment_index", "role").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("topic_index", F.last("topic_index", ignorenulls=True).over(order))
    return rows.where("role = 1 AND topic_index IS NOT NULL").drop("role")


def topic_spans(segments: DataFrame, boundaries: DataFrame, trusted: DataFrame, durations: DataFrame) -> DataFrame:
    """Sections between boundaries: segment ranges and times that also cover the screenshots."""
    firsts = segments.select("video_id").distinct().select("video_id", F.lit(0).alias("segment_start_index"), F.array(F.lit("LECTURE_START")).alias("boundary_reasons"))
    starts = firsts.unionByName(boundaries.select("video_id", F.col("segment_index").alias("segment_start_index"), F.col("reasons").alias("boundary_reasons")))
    order = Window.partitionBy("video_id").orderBy("segment_start_index")
    starts = starts.withColumn("topic_index", (F.row_number().over(order) - 1).cast("int"))
    seg = segments.select("video_id", "segment_index", "start_seconds", "end_seconds").join(topic_of_segments(segments, starts), ["video_id", "segment_index"])
    ranges = seg.groupBy("video_id", "topic_index").agg(F.max("segment_index").alias("segment_end_index"), F.min_by("start_seconds", "segment_index").alias("s"), F.max_by("end_seconds", "segment_index").alias("e"))
    spans = starts.join(ranges, ["video_id", "topic_index"])
    earliest = trusted.groupBy("video_id").agg(F.min("timestamp_seconds").alias("earliest"))
    spans = spans.join(earliest, "video_id", "left").join(durations, "video_id", "left")
    topic = Window.partitionBy("video_id").orderBy("topic_index")
    spans = spans.withColumn("start_seconds", F.when(F.col("topic_index") == 0, F.least("s", "earliest")).otherwise(F.col("s")))
    following = F.lead("s").over(topic)
    end = F.when(following.isNotNull(), F.greatest("e", following)).otherwise(F.greatest("e", F.coalesce("duration", F.lit(0.0))))
    return spans.withColumn("end_seconds", end).withColumn("is_last", F.lead("topic_index").over(topic).isNull()).select("video_id", "topic_index", "segment_start_index", "segment_end_index", "start_seconds", "end_seconds", "is_last", "boundary_reasons")


def visual_only_topics(trusted: DataFrame, durations: DataFrame, c: TopicConfig = TopicConfig()) -> DataFrame:
    """Sections of lectures without speech, from the times of their screenshots."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("trusted_index", kind="stable")
        group, start, last, out = 0, None, None, []
        for t in rows.timestamp_seconds:
            if start is not None and (t - last >= c.visual_gap and t - start >= c.min_seconds or t - start >= c.max_seconds):
                group, start = group + 1, t
            start, last = t if start is None else start, t
            out.append(group)
        return pd.DataFrame({"video_id": rows.video_id, "trusted_index": rows.trusted_index, "timestamp_seconds": rows.timestamp_seconds, "topic_index": out})

    ids = trusted.groupBy("video_id").applyInPandas(fold, "video_id string, trusted_index int, timestamp_seconds double, topic_index int")
    groups = ids.groupBy("video_id", "topic_index").agg(F.min("timestamp_seconds").alias("start_seconds"), F.count("*").alias("screenshot_count"))
    following = F.lead("start_seconds").over(Window.partitionBy("video_id").orderBy("topic_index"))
    return groups.join(durations, "video_id").withColumn("end_seconds", F.coalesce(following, F.greatest("start_seconds", "duration"))).drop("duration")


def assign_to_topics(trusted: DataFrame, spans: DataFrame) -> DataFrame:
    """(topic_index, trusted_index): the band [start, end), open-ended for the last topic."""
    rows, at = trusted.select("video_id", "trusted_index", "candidate_index", "timestamp_seconds"), F.col("timestamp_seconds")
    s = spans.select("video_id", "topic_index", "start_seconds", "end_seconds", "is_last")
    inner = meet(rows, s.where("NOT is_last"), (at, at), (F.col("start_seconds"), F.col("end_seconds")), 64.0).where(at < F.col("end_seconds"))
    last = rows.join(s.where("is_last"), "video_id").where(at >= F.col("start_seconds"))  # one span a lecture
    return inner.unionByName(last).select("video_id", "topic_index", "trusted_index", "candidate_index", "timestamp_seconds")


def in_topics(segments: DataFrame, spans: DataFrame) -> DataFrame:
    """Segments and the topic in whose range they are."""
    return segments.join(topic_of_segments(segments, spans.select("video_id", "segment_start_index", "topic_index")), ["video_id", "segment_index"]).select(*segments.columns, "topic_index")


def top_tokens(rows: DataFrame, order: str, tokens, k: int) -> DataFrame:
    """topic_index, rank, token, n: the k commonest tokens of each topic, ties by first occurrence.

    Row and position are one number, for the least of a struct would sort all tokens.
    """
    # Dealt by topic before they become tokens, which are many times their size: the groups and the window below need no exchange.
    dealt = rows.repartition("video_id", "topic_index")
    found = dealt.select("video_id", "topic_index", F.col(order).cast("long").alias("row"), F.posexplode(tokens).alias("pos", "token"))
    place = F.shiftleft("row", 32) + F.col("pos")
    counts = found.groupBy("video_id", "topic_index", "token").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    best = Window.partitionBy("video_id", "topic_index").orderBy(F.desc("n"), "first")
    return counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("video_id", "topic_index", "rank", "token", "n")


def topic_keywords(segments: DataFrame, spans: DataFrame, k: int = 5) -> DataFrame:
    return top_tokens(in_topics(segments, spans), "segment_index", tx.speech_tokens(F.col("text")), k)


def topic_titles(segments: DataFrame, spans: DataFrame, keywords: DataFrame) -> DataFrame:
    """The segment with most keywords, else the keywords, else a number."""
    words = keywords.groupBy("video_id", "topic_index").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "token"))), lambda x: x["token"]).alias("keywords"))
    rows = in_topics(segments, spans).withColumn("clean", tx.strip_cue(F.col("text"))).join(words, ["video_id", "topic_index"], "left")
    rows = rows.where(tx.word_count(F.col("clean")).between(3, 12))
    hits = F.size(F.filter(tx.speech_tokens(F.col("clean")), lambda x: F.array_contains(F.col("keywords"), x)))
    best = rows.groupBy("video_id", "topic_index").agg(F.max_by("clean", F.struct(F.coalesce(hits, F.lit(0)).alias("h"), (-F.col("segment_index")).alias("i"))).alias("clean"))
    out = spans.select("video_id", "topic_index").join(best, ["video_id", "topic_index"], "left").join(words, ["video_id", "topic_index"], "left")
    nine = F.btrim(F.array_join(F.slice(F.split("clean", " "), 1, 9), " "), F.lit(" ,.-:"))
    named = F.array_join(F.transform(F.slice("keywords", 1, 3), lambda x: tx.title_words(F.regexp_replace(x, "-", " "))), " · ")
    return out.select("video_id", "topic_index", F.when(F.col("clean").isNotNull(), tx.sentence_case(nine)).when(F.size("keywords") > 0, named).otherwise(F.concat(F.lit("Lecture Section "), (F.col("topic_index") + 1).cast("string"))).alias("title"))


def topic_stats(segments: DataFrame, spans: DataFrame, assigned: DataFrame) -> DataFrame:
    said = in_topics(segments, spans).groupBy("video_id", "topic_index").agg(F.count("*").alias("segment_count"), F.sum(tx.word_count(F.col("text"))).alias("word_count"))
    shown = assigned.groupBy("video_id", "topic_index").agg(F.sort_array(F.collect_list("trusted_index")).alias("trusted_screenshot_indexes"), F.count("*").alias("screenshot_count"))
    out = spans.join(said, ["video_id", "topic_index"], "left").join(shown, ["video_id", "topic_index"], "left")
    return out.select("video_id", "topic_index", "start_seconds", "end_seconds", F.round(F.col("end_seconds") - F.col("start_seconds"), 6).alias("duration_seconds"), F.coalesce("segment_count", F.lit(0)).alias("segment_count"), F.coalesce("word_count", F.lit(0)).alias("word_count"), F.coalesce("screenshot_count", F.lit(0)).alias("screenshot_count"), F.coalesce("trusted_screenshot_indexes", F.array().cast("array<int>")).alias("trusted_screenshot_indexes"))
