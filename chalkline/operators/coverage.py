"""Coverage audit: is anything that was shown or taught missing from the trusted screenshots?"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chalkline.config import CoverageConfig
from chalkline.functions import text as tx
from chalkline.functions.bands import meet
from chalkline.operators.changes import change_clusters

# One struct holds the evidence of all rules; what a rule has not is null.
EVIDENCE = (
    ("candidate_index", "int"), ("topic_index", "int"), ("trusted_index", "int"), ("scene_change_count", "long"), ("structural_change_count", "long"), ("max_change_score", "double"),
    ("nearest_trusted_screenshot_seconds", "double"), ("nearby_stable_state_timestamps", "string"), ("unresolved_stable_state_timestamps", "string"), ("gap_seconds", "double"),
    ("transcript_segment_count", "long"), ("transcript_word_count", "long"), ("visual_change_count", "long"), ("stable_state_count", "long"), ("unresolved_stable_state_count", "long"), ("mean_confidence", "double"), ("word_count", "long"),
)


def lecture_duration(topics: DataFrame, segments: DataFrame, trusted: DataFrame) -> DataFrame:
    ends = topics.select("video_id", F.col("end_seconds").alias("t")).union(segments.select("video_id", "end_seconds")).union(trusted.select("video_id", "timestamp_seconds"))
    return ends.groupBy("video_id").agg(F.greatest(F.lit(0.0), F.max("t")).alias("duration"))


def nearest_distance(clusters: DataFrame, trusted: DataFrame) -> DataFrame:
    """Clusters and the time to the nearest trusted screenshot: an as-of join both ways, null where there is none.

    Clusters and screenshots are put in one order by time; the last screenshot
    before and the first after are carried along it, so no pairs are made.
    """
    rows = clusters.select("video_id", F.col("midpoint").alias("t"), "cluster_index").unionByName(trusted.select("video_id", F.col("timestamp_seconds").alias("t"), F.lit(None).cast("int").alias("cluster_index")))
    seen = F.when(F.col("cluster_index").isNull(), F.col("t"))
    # Both ways from an end: a window that ends with the partition is gone through anew for each row.
    carried = lambda order: F.last(seen, ignorenulls=True).over(Window.partitionBy("video_id").orderBy(order).rangeBetween(Window.unboundedPreceding, 0))
    before, after = carried(F.asc("t")), carried(F.desc("t"))
    near = rows.select("video_id", "cluster_index", F.least(F.col("t") - before, after - F.col("t")).alias("distance")).where(F.col("cluster_index").isNotNull())
    return clusters.join(near, ["video_id", "cluster_index"])


def resolve_states(states: DataFrame, reviewed: DataFrame, trusted: DataFrame, c: CoverageConfig = CoverageConfig()) -> DataFrame:
    """What became of each stable state, by the candidate nearest in time (at most ``match_seconds`` away)."""
    near = reviewed.join(trusted.select("video_id", "candidate_index", F.lit(True).alias("is_trusted")), ["video_id", "candidate_index"], "left")
    near = near.select("video_id", "candidate_index", F.col("timestamp_seconds").alias("at"), "kept", "selected", "manual_decision", F.coalesce("is_trusted", F.lit(False)).alias("is_trusted"))
    far = F.abs(F.col("at") - F.col("timestamp_seconds"))
    # Farther candidates leave a state unresolved, as none does, so the band bounds the join.
    t, at = F.col("timestamp_seconds"), F.col("at")
    pairs = meet(states.select("video_id", "checkpoint_index", "timestamp_seconds"), near, (t, t), (at - c.match_seconds - 0.001, at + c.match_seconds + 0.001), 4 * c.match_seconds).where(far <= c.match_seconds)
    best = pairs.groupBy("video_id", "checkpoint_index").agg(F.min_by(F.struct("is_trusted", "selected", "kept", "manual_decision"), F.struct(far, "candidate_index")).alias("n"))
    nearest = states.select("video_id", "checkpoint_index", "timestamp_seconds").join(best, ["video_id", "checkpoint_index"], "left")
    n = F.col("n")
    resolution = (
        F.when(n.isNull(), "UNRESOLVED").when(n["is_trusted"] | n["selected"], "TRUSTED").when(~n["kept"], "AUTO_DISMISSED_DUPLICATE").when(n["manual_decision"] == F.lit(False), "MANUALLY_DISMISSED").otherwise("UNRESOLVED")
    )
    return nearest.select("video_id", "checkpoint_index", "timestamp_seconds", resolution.alias("resolution"))


def states_near(clusters: DataFrame, resolved: DataFrame, c: CoverageConfig = CoverageConfig()) -> DataFrame:
    """Clusters with the number and the first eight times of states nearby, all and unresolved."""
    s = resolved.select("video_id", F.round("timestamp_seconds", 4).alias("at"), F.col("timestamp_seconds").alias("exact"), (F.col("resolution") == "UNRESOLVED").alias("open"))
    key = ["video_id", "cluster_index"]
    ranks = {"nth": F.row_number().over(Window.partitionBy(*key).orderBy("at")), "nth_open": F.row_number().over(Window.partitionBy(*key, "open").orderBy("at"))}
    first = lambda x: tx.joined(F.sort_array(F.collect_list(F.when(x, F.col("at")))).cast("array<string>"))
    spans = clusters.select("video_id", "cluster_index", "start_seconds", "end_seconds")
    pairs = meet(spans, s, (F.col("start_seconds") - c.near_seconds, F.col("end_seconds") + c.near_seconds), (F.col("exact"), F.col("exact")), 4 * c.near_seconds)
    found = pairs.withColumns(ranks).groupBy(*key).agg(
        F.count("at").alias("state_count"), F.count_if(F.col("open")).alias("unresolved_count"), first(F.col("nth") <= 8).alias("state_times"), first(F.col("open") & (F.col("nth_open") <= 8)).alias("unresolved_times")
    )
    zero = {"state_count": F.lit(0), "unresolved_count": F.lit(0), "state_times": F.lit(""), "unresolved_times": F.lit("")}
    return clusters.join(found, key, "left").withColumns({x: F.coalesce(x, v) for x, v in zero.items()})


def trusted_gaps(trusted: DataFrame, durations: DataFrame, c: CoverageConfig = CoverageConfig()) -> DataFrame:
    """Stretches of at least ``gap_seconds`` between screenshots, the lecture's ends included."""
    ends = durations.select("video_id", F.explode(F.when(F.col("duration") > 0, F.array(F.struct(F.lit(0.0).alias("t"), F.lit(0).alias("kind")), F.struct(F.col("duration").alias("t"), F.lit(2).alias("kind")))).otherwise(F.array(F.struct(F.lit(0.0).alias("t"), F.lit(0).alias("kind"))))).alias("e"))
    rows = ends.select("video_id", "e.t", "e.kind").unionByName(trusted.select("video_id", F.col("timestamp_seconds").alias("t"), F.lit(1).alias("kind")))
    left = F.lag("t").over(Window.partitionBy("video_id").orderBy("kind", "t"))
    return rows.select("video_id", left.alias("left"), F.col("t").alias("right")).where(F.col("right") - F.col("left") >= c.gap_seconds)


def _in_gaps(gaps: DataFrame, rows: DataFrame, low, high, within=None, **aggregates) -> DataFrame:
    """Gaps with aggregates of the rows that they meet, 0 where there are none."""
    key = ["video_id", "left", "right"]
    pairs = meet(gaps.select(*key), rows, (F.col("left"), F.col("right")), (low, high), 64.0)
    found = (pairs if within is None else pairs.where(within)).groupBy(*key).agg(*(x.alias(n) for n, x in aggregates.items()))
    return gaps.join(found, key, "left").select(*key, *(F.coalesce(n, F.lit(0)).alias(n) for n in aggregates))


def gap_speech(gaps: DataFrame, segments: DataFrame) -> DataFrame:
    """Gaps with the speech that overlaps them."""
    spoken = segments.select("video_id", "start_seconds", "end_seconds", tx.word_count(F.col("text")).alias("words"))
    return _in_gaps(gaps, spoken, F.col("start_seconds"), F.col("end_seconds"), segment_count=F.count("*"), word_count=F.sum("words"))


def gap_changes(gaps: DataFrame, changes: DataFrame) -> DataFrame:
    """Gaps with the changes within (closed)."""
    at = F.col("timestamp_seconds")
    return _in_gaps(gaps, changes.where("kind <> 'NONE'").select("video_id", "timestamp_seconds"), at, at, change_count=F.count("*"))


def gap_states(gaps: DataFrame, resolved: DataFrame) -> DataFrame:
    """Gaps with the states within (open)."""
    at = F.col("timestamp_seconds")
    inside = (at > F.col("left")) & (at < F.col("right"))
    return _in_gaps(gaps, resolved.select("video_id", "timestamp_seconds", "resolution"), at, at, inside, state_count=F.count("*"), unresolved_count=F.count_if(F.col("resolution") == "UNRESOLVED"))


def gap_evidence(gaps: DataFrame, segments: DataFrame, changes: DataFrame, resolved: DataFrame) -> DataFrame:
    """Gaps with speech, changes and states."""
    key = ["video_id", "left", "right"]
    return gap_speech(gaps, segments).join(gap_changes(gaps, changes), key).join(gap_states(gaps, resolved), key)


def _finding(df: DataFrame, rule: int, order: list, severity, blocking, start, end, reasons, **evidence) -> DataFrame:
    found = F.struct(*(evidence.get(n, F.lit(None)).cast(t).alias(n) for n, t in EVIDENCE))
    index = F.row_number().over(Window.partitionBy("video_id").orderBy(*order))
    return df.select("video_id", F.lit(rule).alias("rule"), index.alias("rule_order"), severity.alias("severity"), blocking.alias("blocking"), start.alias("start_seconds"), end.alias("end_seconds"), reasons.alias("reasons"), found.alias("evidence"))


def rule_uncaptured_change(changes: DataFrame, trusted: DataFrame, resolved: DataFrame, c: CoverageConfig = CoverageConfig()) -> DataFrame:
    clusters = nearest_distance(change_clusters(changes, c), trusted).where(F.col("distance").isNull() | (F.col("distance") > c.near_seconds))
    rows = states_near(clusters, resolved, c).where(~((F.col("state_count") > 0) & (F.col("unresolved_count") == 0) & (F.col("scene_count") == 0)))
    hard = (F.col("scene_count") > 0) & (F.col("unresolved_count") > 0)
    reasons = F.when(F.col("unresolved_count") > 0, "UNCAPTURED_STRONG_VISUAL_CHANGE,STABLE_STATE_NOT_IN_TRUSTED_SET").otherwise("UNCAPTURED_STRONG_VISUAL_CHANGE")
    return _finding(
        rows, 1, ["cluster_index"], F.when(hard, "HIGH").otherwise("REVIEW"), hard, F.col("start_seconds"), F.col("end_seconds"), reasons, scene_change_count=F.col("scene_count"),
        structural_change_count=F.col("structural_count"), max_change_score=F.round("peak_score", 4), nearest_trusted_screenshot_seconds=F.round("distance", 4), nearby_stable_state_timestamps=F.col("state_times"), unresolved_stable_state_timestamps=F.col("unresolved_times"),
    )


def protected_not_trusted(candidates: DataFrame, trusted: DataFrame) -> DataFrame:
    return candidates.where(F.col("protected") | F.col("content_loss_risk")).join(trusted, ["video_id", "candidate_index"], "left_anti")


def rule_protected_lost(candidates: DataFrame, trusted: DataFrame) -> DataFrame:
    at = F.col("timestamp_seconds")
    return _finding(protected_not_trusted(candidates, trusted), 2, ["candidate_index"], F.lit("HIGH"), F.lit(True), at, at, F.lit("PROTECTED_EVIDENCE_NOT_TRUSTED"), candidate_index=F.col("candidate_index"))


def rule_long_gap(trusted: DataFrame, durations: DataFrame, segments: DataFrame, changes: DataFrame, resolved: DataFrame, c: CoverageConfig = CoverageConfig()) -> DataFrame:
    rows = gap_evidence(trusted_gaps(trusted, durations, c), segments, changes, resolved).withColumn("gap", F.col("right") - F.col("left"))
    rows = rows.where(((F.col("gap") >= c.long_gap_seconds) | (F.col("word_count") >= c.dense_words) | (F.col("change_count") >= c.busy_changes)) & (F.col("unresolved_count") > 0))
    reasons = F.when(F.col("word_count") >= c.dense_words, "LONG_TRUSTED_SCREENSHOT_GAP,SPEECH_DENSE_GAP,UNUSED_STABLE_STATE_IN_GAP").otherwise("LONG_TRUSTED_SCREENSHOT_GAP,UNUSED_STABLE_STATE_IN_GAP")
    return _finding(
        rows, 3, ["left", "right"], F.lit("REVIEW"), F.lit(False), F.col("left"), F.col("right"), reasons, gap_seconds=F.round("gap", 3), transcript_segment_count=F.col("segment_count"),
        transcript_word_count=F.col("word_count"), visual_change_count=F.col("change_count"), stable_state_count=F.col("state_count"), unresolved_stable_state_count=F.col("unresolved_count"),
    )


def rule_topic_without_visual(topics: DataFrame) -> DataFrame:
    return _finding(topics.where("screenshot_count <= 0"), 4, ["topic_index"], F.lit("HIGH"), F.lit(True), F.col("start_seconds"), F.col("end_seconds"), F.lit("TOPIC_WITHOUT_TRUSTED_SCREENSHOT"), topic_index=F.col("topic_index"), transcript_segment_count=F.col("segment_count"), word_count=F.col("word_count"))


def poor_text(ocr: DataFrame) -> DataFrame:
    return ocr.where(~F.col("has_text") | F.col("low_confidence")).select("video_id", "trusted_index", "has_text", "mean_confidence", "word_count")


def ocr_warnings(ocr: DataFrame, trusted: DataFrame) -> DataFrame:
    """Screenshots whose text is missing or uncertain, with their times; rows of no screenshot are in ocr_rejects()."""
    return poor_text(ocr).join(trusted.select("video_id", "trusted_index", "timestamp_seconds"), ["video_id", "trusted_index"])


def ocr_rejects(ocr: DataFrame, trusted: DataFrame) -> DataFrame:
    """Rows with missing or uncertain text whose index is out of range: they belong to no screenshot."""
    return poor_text(ocr).join(trusted.select("video_id", "trusted_index"), ["video_id", "trusted_index"], "left_anti").withColumn("reject_reason", F.lit("NO_SUCH_SCREENSHOT"))


def rule_ocr_uncertain(ocr: DataFrame, trusted: DataFrame) -> DataFrame:
    at, reason = F.col("timestamp_seconds"), F.when(~F.col("has_text"), "OCR_NO_TEXT").otherwise("OCR_LOW_CONFIDENCE")
    return _finding(ocr_warnings(ocr, trusted), 5, ["trusted_index"], F.lit("WARNING"), F.lit(False), at, at, reason, trusted_index=F.col("trusted_index"), mean_confidence=F.col("mean_confidence"), word_count=F.col("word_count"))


def coverage_findings(rules: list[DataFrame]) -> DataFrame:
    """All findings of a lecture under one index, in the order of the rules."""
    index = F.row_number().over(Window.partitionBy("video_id").orderBy("rule", "rule_order")) - 1
    start = F.greatest(F.lit(0.0), F.col("start_seconds"))
    rows = reduce(DataFrame.unionByName, rules).withColumn("finding_index", index.cast("int"))
    return rows.select("video_id", "finding_index", "severity", "blocking", F.round(start, 6).alias("start_seconds"), F.round(F.greatest(F.col("start_seconds"), F.col("end_seconds")), 6).alias("end_seconds"), "reasons", "evidence")


def summary_coverage(lectures: DataFrame, findings: DataFrame) -> DataFrame:
    """Counts and the gate of every lecture, those without findings included."""
    n = lambda s: F.count_if(F.col("severity") == s)
    rows = lectures.join(findings, "video_id", "left").groupBy("video_id").agg(
        F.count("finding_index").alias("finding_count"), n("HIGH").alias("high_count"), n("MEDIUM").alias("medium_count"), n("REVIEW").alias("review_count"), n("WARNING").alias("warning_count"), F.count_if(F.col("blocking")).alias("blocking_count")
    )
    status = F.when(F.col("blocking_count") > 0, "BLOCKED").when(F.col("review_count") > 0, "REVIEW").otherwise("READY")
    return rows.withColumns({"ready_for_pdf": F.col("blocking_count") == 0, "pdf_status": status})


def library_rollup(summaries: DataFrame, findings: DataFrame) -> DataFrame:
    """Lectures and findings by gate and severity, with subtotals."""
    rows = summaries.select("video_id", "pdf_status").join(findings.select("video_id", "severity", "finding_index"), "video_id", "left")
    return rows.rollup("pdf_status", "severity").agg(F.count_distinct("video_id").alias("lectures"), F.count("finding_index").alias("findings"))


def top_findings(findings: DataFrame, blocking: int = 20, review: int = 12) -> DataFrame:
    """The first findings of each class and lecture."""
    kind = F.when(F.col("blocking"), "blocking").when(F.col("severity") == "REVIEW", "review")
    rank = F.row_number().over(Window.partitionBy("video_id", "class").orderBy("finding_index"))
    rows = findings.withColumn("class", kind).where(F.col("class").isNotNull()).withColumn("rank", rank)
    return rows.where(F.col("rank") <= F.when(F.col("class") == "blocking", blocking).otherwise(review)).select("video_id", "class", "rank", "finding_index")
