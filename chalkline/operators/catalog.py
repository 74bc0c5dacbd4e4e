"""Catalog of lectures: URLs, metadata, media checks, timelines, sampling grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.config import HostRules
from chalkline.functions.bands import meet
from chalkline.functions.text import duration_text


def normalize_source_catalog(urls: DataFrame, rules: HostRules = HostRules()) -> DataFrame:
    """video_id, normalized_url, accepted: one row an accepted id, and one for each rejected URL."""
    url = F.col("url")
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^(?i:https?)://([^/?#:]+)", 1)), r"^www\.", "")
    path, query = F.regexp_extract(url, r"^[^:]+://[^/?#]*(/[^?#]*)", 1), F.regexp_extract(url, r"[?&]v=([^&#]*)", 1)
    part = lambda n: F.coalesce(F.get(F.split(path, "/"), n), F.lit(""))
    main = F.when(path == "/watch", query).otherwise(part(F.lit(2)))
    id_ = F.when(host.isin(*rules.short_hosts), part(F.lit(1))).when(host.isin(*rules.main_hosts), main).otherwise("")
    ok = id_.rlike(rules.id_pattern)
    rows = urls.select(F.when(ok, id_).alias("video_id"), F.when(ok, F.concat(F.lit(f"https://{rules.main_hosts[0]}/watch?v="), id_)).otherwise(url).alias("normalized_url"), ok.alias("accepted"))
    return rows.distinct()


def normalize_catalog_metadata(raw: DataFrame) -> DataFrame:
    """raw video_id, title, duration, live_status, height, format_heights, channel, uploader."""
    reject = F.when(F.col("live_status").isin("is_live", "is_upcoming"), "LIVE").when(F.col("duration").isNull(), "NO_DURATION")
    seconds = F.greatest(F.lit(0).cast("long"), F.bround("duration").cast("long"))
    height = F.coalesce("height", F.array_max("format_heights"))
    return raw.select(
        "video_id", F.coalesce(F.nullif(F.btrim("title"), F.lit("")), F.lit("Untitled lecture")).alias("title"), F.when(reject.isNull(), seconds).alias("duration_seconds"),
        F.when(reject.isNull(), duration_text(F.col("duration"))).alias("duration_formatted"), F.coalesce("channel", "uploader").alias("channel"), F.concat(height.cast("string"), F.lit("p")).alias("resolution"), reject.alias("reject_reason"),
    )


def verify_media(probes: DataFrame) -> DataFrame:
    """probes video_id, expected, probed, has_video, width, height."""
    shape = F.col("has_video") & (F.col("width") > 0) & (F.col("height") > 0) & (F.col("probed") > 0)
    close = (F.col("expected") <= 0) | (F.abs(F.col("probed") - F.col("expected")) <= F.greatest(F.lit(3.0), F.col("expected") * 0.01))
    reason = F.when(~shape, "NOT_A_VIDEO").when(~close, "DURATION_MISMATCH")
    return probes.select("video_id", reason.isNull().alias("accepted"), reason.alias("reject_reason"))


def timeline_metadata(probes: DataFrame) -> DataFrame:
    """probes video_id, fps, frame_count, width, height, duration; what is missing is worked out, what can't be is dropped."""
    count = F.coalesce(F.when(F.col("frame_count") > 0, F.col("frame_count")), F.when(F.col("duration") > 0, F.greatest(F.lit(1).cast("long"), F.bround(F.col("duration") * F.col("fps")).cast("long"))))
    rows = probes.where((F.col("fps") > 0) & (F.col("width") > 0) & (F.col("height") > 0)).withColumn("frame_count", count)
    rows = rows.withColumn("duration_seconds", F.coalesce(F.when(F.col("duration") > 0, F.col("duration")), F.col("frame_count") / F.col("fps"))).where(F.col("frame_count").isNotNull() & (F.col("duration_seconds") > 0))
    last = F.least("duration_seconds", F.greatest(F.lit(0.0), (F.col("frame_count") - 1) / F.col("fps")))
    return rows.select("video_id", "frame_count", "fps", "width", "height", F.round("duration_seconds", 6).alias("duration_seconds"), F.lit(0.0).alias("first_timestamp_seconds"), F.round(last, 6).alias("last_timestamp_seconds"))


def sample_grid(windows: DataFrame, fps: float, source_fps: float, least: float = 1.0) -> DataFrame:
    """Samples of each window at ``fps``, no faster than the source and no slower than ``least``."""
    rate = min(max(fps, least), source_fps)
    n = F.floor((F.col("end_seconds") - F.col("start_seconds")) * rate).cast("int")
    rows = windows.select("video_id", "window_index", "start_seconds", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), n))).alias("sample_index"))
    at = F.col("start_seconds") + F.col("sample_index") / F.lit(rate)
    return rows.select("video_id", "window_index", "sample_index", F.greatest(F.lit(0).cast("long"), F.bround(at * source_fps).cast("long")).alias("frame_index"), F.round(at, 6).alias("timestamp_seconds"))


def fine_scan_filter(samples: DataFrame, windows: DataFrame) -> DataFrame:
    """Samples inside a window (closed), with its index."""
    w, at = windows.select("video_id", "window_index", "start_seconds", "end_seconds"), F.col("timestamp_seconds")
    return meet(samples.select("video_id", "frame_index", "timestamp_seconds"), w, (at, at), (F.col("start_seconds"), F.col("end_seconds")), 16.0).select("video_id", "frame_index", "timestamp_seconds", "window_index")
