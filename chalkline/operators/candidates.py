"""Screenshot candidates: duplicates, content loss, decisions, the trusted set."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.config import CandidateConfig


def in_order():
    """Rows of a lecture in order."""
    return Window.partitionBy("video_id").orderBy("candidate_index")


PROTECTED_REASONS = ("PRE_TRANSITION_PROTECTION", "END_OF_VIDEO_FALLBACK", "SINGLE_FRAME")
SIGNAL_REASONS = ("PRE_TRANSITION_PROTECTION", "END_OF_VIDEO_FALLBACK")


def candidate_protected(before_transition: Column, reason: Column) -> Column:
    return before_transition | reason.isin(*PROTECTED_REASONS)


def suppress_near_duplicates(frames: DataFrame, c: CandidateConfig = CandidateConfig()) -> DataFrame:
    """kept and, where a recent kept frame matches, what it matches and how closely (newest first)."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        recent: list[tuple[int, int, np.ndarray]] = []
        out = []
        for r in rows.sort_values("candidate_index", kind="stable").itertuples():
            vector, match = np.asarray(r.thumb, np.float64), None
            for index, bits, other in recent:
                distance = ((int(r.dhash) ^ bits) & (1 << 64) - 1).bit_count()
                if distance <= c.max_hash_distance:
                    difference = float(np.abs(vector - other).sum() / len(vector))
                    if difference <= c.max_mean_abs_difference:
                        match = (index, distance, difference)
                        break
            kept = bool(r.protected) or match is None
            out.append((r.video_id, r.candidate_index, kept, None if kept else match[0], match and match[1], match and round(match[2], 6)))
            if kept:
                recent = [(r.candidate_index, int(r.dhash), vector), *recent[: c.recent - 1]]
        frame = pd.DataFrame(out, columns=["video_id", "candidate_index", "kept", "duplicate_of_candidate_index", "duplicate_hash_distance", "duplicate_mean_abs_difference"])
        return frame.astype({"duplicate_of_candidate_index": "Int32", "duplicate_hash_distance": "Int32", "duplicate_mean_abs_difference": "Float64"})

    schema = "video_id string, candidate_index int, kept boolean, duplicate_of_candidate_index int, duplicate_hash_distance int, duplicate_mean_abs_difference double"
    return frames.groupBy("video_id").applyInPandas(fold, schema)


def content_loss(candidates: DataFrame, c: CandidateConfig = CandidateConfig()) -> DataFrame:
    """Whether the next candidate has lost what this one shows, and why."""
    following = {f"next_{x}": F.lead(x).over(in_order()) for x in ("source_change_kind", "edge_density", "contrast_std")}
    drop = (
        (F.col("edge_density") >= c.min_edge)
        & (F.col("next_edge_density") <= c.edge_share * F.col("edge_density"))
        & (F.col("next_contrast_std") <= F.greatest(F.lit(c.contrast_floor), c.contrast_share * F.col("contrast_std")))
    )
    out = candidates.withColumns(following).withColumn("content_loss_reason", F.when(F.col("next_source_change_kind") == "SCENE", "SCENE_REPLACEMENT").when(drop, "DETAIL_DROP"))
    return out.withColumn("content_loss_risk", F.col("content_loss_reason").isNotNull()).drop(*following)


def protect(candidates: DataFrame) -> DataFrame:
    auto = F.col("protected") | F.col("content_loss_risk")
    return candidates.withColumns({"auto_protected": auto, "default_selected": F.col("kept") | auto})


def latest_decisions(events: DataFrame) -> DataFrame:
    """The decision log compacted: of each candidate, and each ``candidate_version`` where there is one, the event that counts."""
    key = ["video_id", "candidate_index", *(["candidate_version"] if "candidate_version" in events.columns else [])]
    latest = Window.partitionBy(*key).orderBy(F.desc("updated_at"), F.desc("selected"))
    return events.withColumn("nth", F.row_number().over(latest)).where("nth = 1").drop("nth")


def apply_decisions(review: DataFrame, events: DataFrame, versions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(overrides, rejects) of decision events video_id, candidate_index, selected, force, updated_at: the latest counts.

    Unknown candidates and unforced removals of protected ones are rejected; a
    decision equal to the default removes the override.  With ``versions``
    (video_id, version of its candidates) the events say by candidate_version what
    they were made on: those made on another version are void, and listed.
    """
    events, reason = latest_decisions(events), F.lit(None).cast("string")
    if versions is not None:
        events = events.join(versions.select("video_id", F.col("version").alias("__now")), "video_id", "left")
        reason = F.when(~F.col("candidate_version").eqNullSafe(F.col("__now")), "OTHER_VERSION")
    known = events.join(review.select("video_id", "candidate_index", "auto_protected", "default_selected"), ["video_id", "candidate_index"], "left")
    guard = F.when(F.col("default_selected").isNull(), "UNKNOWN_CANDIDATE").when(F.col("auto_protected") & ~F.col("selected") & ~F.coalesce(F.col("force"), F.lit(False)), "PROTECTED")
    judged = known.withColumn("reject_reason", F.coalesce(reason, guard))
    overrides = judged.where(F.col("reject_reason").isNull() & (F.col("selected") != F.col("default_selected"))).select("video_id", "candidate_index", F.col("selected").alias("manual_decision"))
    return overrides, judged.where(F.col("reject_reason").isNotNull()).select("video_id", "candidate_index", "reject_reason")


def merge_decisions(review: DataFrame, overrides: DataFrame) -> DataFrame:
    return review.join(overrides, ["video_id", "candidate_index"], "left").withColumn("selected", F.coalesce("manual_decision", "default_selected"))


def trusted_set(reviewed: DataFrame) -> DataFrame:
    """Selected candidates under a dense index."""
    chosen = reviewed.where("selected").withColumn("trusted_index", (F.row_number().over(in_order()) - 1).cast("int"))
    return chosen.select("video_id", "trusted_index", "candidate_index", "frame_index", "timestamp_seconds", "reason", "auto_protected", "content_loss_risk", "manual_decision", "image_filename")


def section_signals(candidates: DataFrame) -> DataFrame:
    kind = F.col("source_change_kind")
    wanted = candidates.where((kind == "SCENE") | F.col("reason").isin(*SIGNAL_REASONS))
    return wanted.select("video_id", "candidate_index", F.coalesce(F.nullif(kind, F.lit("")), "reason").alias("signal"))
