"""One-row-per-lecture summaries of the stage tables; lectures without rows are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.functions.text import word_count


def _per_lecture(lectures: DataFrame, rows: DataFrame, **aggregates) -> DataFrame:
    return lectures.join(rows, "video_id", "left").groupBy("video_id").agg(*(v.alias(k) for k, v in aggregates.items()))


def _n(condition):
    return F.count_if(F.coalesce(condition, F.lit(False)))


def summary_changes(lectures: DataFrame, changes: DataFrame) -> DataFrame:
    kind = lambda k: _n(F.col("kind") == k)
    best = F.min_by(F.struct("change_score", "frame_index"), F.struct(-F.col("change_score"), F.col("frame_index")))
    out = _per_lecture(lectures, changes, pair_count=F.count("frame_index"), none_count=kind("NONE"), local_count=kind("LOCAL"), structural_count=kind("STRUCTURAL"), scene_count=kind("SCENE"), total=F.coalesce(F.sum("change_score"), F.lit(0.0)), best=best)
    mean = F.when(F.col("pair_count") > 0, F.round(F.col("total") / F.col("pair_count"), 4)).otherwise(0.0)
    return out.select("video_id", "pair_count", "none_count", "local_count", "structural_count", "scene_count", mean.alias("mean_score"), F.coalesce("best.change_score", F.lit(0.0)).alias("max_score"), F.col("best.frame_index").alias("max_score_frame"))


def adaptive_savings(timeline: DataFrame, windows: DataFrame, coarse: DataFrame, fine: DataFrame) -> DataFrame:
    n = lambda df, name: df.groupBy("video_id").agg(F.count("*").alias(name))
    active = windows.groupBy("video_id").agg(F.sum(F.col("end_seconds") - F.col("start_seconds")).alias("activity_seconds"))
    rows = timeline.select("video_id", "frame_count", "duration_seconds").join(n(coarse, "coarse_samples"), "video_id", "left").join(n(fine, "fine_samples"), "video_id", "left").join(active, "video_id", "left")
    rows = rows.withColumns({"coarse_samples": F.coalesce("coarse_samples", F.lit(0)), "fine_samples": F.coalesce("fine_samples", F.lit(0)), "activity_seconds": F.round(F.coalesce("activity_seconds", F.lit(0.0)), 4)})
    rows = rows.withColumn("analysed_samples", F.col("coarse_samples") + F.col("fine_samples"))
    return rows.select(
        "video_id", "coarse_samples", "fine_samples", "analysed_samples", "activity_seconds", F.round(F.greatest(F.lit(0.0), F.col("duration_seconds") - F.col("activity_seconds")), 4).alias("static_seconds_skipped"),
        F.round(F.greatest(F.lit(0.0), 100 * (1 - F.col("analysed_samples") / F.col("frame_count"))), 4).alias("estimated_frame_reduction_percent"), F.round(F.col("analysed_samples") / F.col("duration_seconds"), 4).alias("effective_fps"),
    )


def summary_states(lectures: DataFrame, states: DataFrame) -> DataFrame:
    r = lambda x: _n(F.col("reason") == x)
    return _per_lecture(lectures, states, checkpoint_count=F.count("checkpoint_index"), initial_count=r("INITIAL_STABLE"), stable_count=r("STABLE_AFTER_CHANGE"), protection_count=r("PRE_TRANSITION_PROTECTION"), fallback_count=r("END_OF_VIDEO_FALLBACK"), single_count=r("SINGLE_FRAME"), first_seconds=F.min("timestamp_seconds"), last_seconds=F.max("timestamp_seconds"))


def summary_candidates(lectures: DataFrame, candidates: DataFrame) -> DataFrame:
    kept, protected, risk = F.col("kept"), F.col("protected"), F.col("content_loss_risk")
    return _per_lecture(lectures, candidates, checkpoint_count=F.count("candidate_index"), kept_count=_n(kept), duplicate_count=_n(~kept), protected_kept_count=_n(protected & kept), risk_count=_n(risk))


def summary_trusted(lectures: DataFrame, reviewed: DataFrame) -> DataFrame:
    s, m = F.col("selected"), F.col("manual_decision")
    return _per_lecture(lectures, reviewed, selected_count=_n(s), manual_keep_count=_n(s & m), manual_suppress_count=_n(~m), auto_protected_count=_n(s & F.col("auto_protected")), restored_count=_n(s & ~F.col("kept")))


def summary_transcript(lectures: DataFrame, segments: DataFrame, durations: DataFrame) -> DataFrame:
    out = _per_lecture(lectures, segments, segment_count=F.count("segment_index"), word_count=F.coalesce(F.sum(word_count(F.col("text"))), F.lit(0)))
    return out.join(durations, "video_id", "left").select("video_id", "segment_count", "word_count", F.coalesce(F.nullif("duration", F.lit(0.0)), F.lit(1.0)).alias("duration_seconds"))


def summary_alignment(lectures: DataFrame, alignment: DataFrame) -> DataFrame:
    out = _per_lecture(lectures, alignment, trusted_count=F.count("trusted_index"), aligned_count=_n(F.size("segment_indexes") > 0))
    percent = F.when(F.col("trusted_count") > 0, F.floor(100 * F.col("aligned_count") / F.col("trusted_count") + 0.5)).otherwise(0)
    return out.withColumns({"unaligned_count": F.col("trusted_count") - F.col("aligned_count"), "aligned_percent": percent.cast("long")})


def summary_topics(lectures: DataFrame, topics: DataFrame, segments: DataFrame, trusted: DataFrame, assigned: DataFrame, scores: DataFrame, boundaries: DataFrame, threshold: float) -> DataFrame:
    out = lectures
    shown = assigned.select("video_id", "trusted_index").distinct()
    for name, df in (("topic_count", topics), ("segment_count", segments), ("trusted_count", trusted), ("assigned_count", shown), ("candidate_boundary_count", scores.where(F.col("score") >= threshold)), ("accepted_boundary_count", boundaries)):
        out = out.join(df.groupBy("video_id").agg(F.count("*").alias(name)), "video_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out.withColumn("unassigned_count", F.col("trusted_count") - F.col("assigned_count")).drop("trusted_count")


def summary_ocr(lectures: DataFrame, ocr: DataFrame) -> DataFrame:
    has = F.col("has_text")
    out = _per_lecture(lectures, ocr, processed_count=F.count("trusted_index"), text_count=_n(has), empty_count=_n(~has), low_confidence_count=_n(F.col("low_confidence")), word_count=F.coalesce(F.sum("word_count"), F.lit(0)), mean_confidence=F.round(F.coalesce(F.avg(F.when(has, F.col("mean_confidence"))), F.lit(0.0)), 3))
    return out.withColumn("text_percent", F.when(F.col("processed_count") > 0, F.floor(100 * F.col("text_count") / F.col("processed_count") + 0.5)).otherwise(0).cast("long"))


def summary_content(lectures: DataFrame, content: DataFrame, trusted: DataFrame) -> DataFrame:
    out = _per_lecture(lectures, content, topic_count=F.count_distinct("topic_index"), enriched_count=F.count("trusted_index"))
    n = trusted.groupBy("video_id").agg(F.count("*").alias("n"))
    return out.join(n, "video_id", "left").select("video_id", "topic_count", "enriched_count", (F.col("enriched_count") == F.coalesce("n", F.lit(0))).alias("coverage_complete"))


def summary_pages(lectures: DataFrame, plan: DataFrame) -> DataFrame:
    return _per_lecture(lectures, plan, page_count=F.count("page_no"), screenshot_count=_n(F.col("page_kind") == "SCREENSHOT"), topic_count=F.count_distinct("topic_index"))
