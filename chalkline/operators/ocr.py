"""Visible text: word boxes to lines and screenshots, enrichment with speech and topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chalkline.config import CoverageConfig
from chalkline.functions import text as tx
from chalkline.operators.speech import top_tokens

LINE = ["video_id", "trusted_index", "page", "block", "par", "line"]


def ocr_lines(words: DataFrame) -> DataFrame:
    """Words (with their position ``pos`` in the image) as lines: text, mean confidence, box."""
    parts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ")
    out = words.groupBy(*LINE).agg(
        F.min("pos").alias("first_pos"), parts.alias("text"), F.coalesce(F.round(F.avg(F.when(F.col("conf") >= 0, F.col("conf"))), 3), F.lit(0.0)).alias("confidence"),
        F.min("left").alias("left"), F.min("top").alias("top"), (F.max(F.col("left") + F.col("width")) - F.min("left")).alias("width"), (F.max(F.col("top") + F.col("height")) - F.min("top")).alias("height"), F.count("*").alias("words"),
    )
    index = F.row_number().over(Window.partitionBy("video_id", "trusted_index").orderBy("first_pos")) - 1
    return out.withColumn("line_index", index.cast("int"))


def ocr_pages(words: DataFrame) -> DataFrame:
    """Screenshots: text by lines, counts, and the mean confidence over words with one."""
    lines = ocr_lines(words).groupBy("video_id", "trusted_index").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_index", "text"))), lambda x: x["text"]), "\n").alias("text"), F.count("*").alias("line_count")
    )
    counts = words.groupBy("video_id", "trusted_index").agg(F.count("*").alias("word_count"), F.coalesce(F.round(F.avg(F.when(F.col("conf") >= 0, F.col("conf"))), 3), F.lit(0.0)).alias("mean_confidence"))
    return lines.join(counts, ["video_id", "trusted_index"]).withColumn("has_text", F.btrim("text") != "")


def with_flags(pages: DataFrame, c: CoverageConfig = CoverageConfig()) -> DataFrame:
    """has_text from the text where it is missing; low_confidence."""
    has = F.coalesce("has_text", F.btrim(F.coalesce("text", F.lit(""))) != "")
    return pages.withColumn("has_text", has).withColumn("low_confidence", F.col("has_text") & (F.coalesce("mean_confidence", F.lit(0.0)) < c.low_confidence))


def pages_of_trusted(trusted: DataFrame, pages: DataFrame) -> DataFrame:
    """One row for each trusted screenshot; those without words have empty text."""
    rows = trusted.select("video_id", "trusted_index", "candidate_index", "timestamp_seconds").join(pages, ["video_id", "trusted_index"], "left")
    zero = {"text": F.lit(""), "line_count": F.lit(0), "word_count": F.lit(0), "mean_confidence": F.lit(0.0), "has_text": F.lit(False)}
    return with_flags(rows.withColumns({c: F.coalesce(c, v) for c, v in zero.items()}))


def coverage_flags(has_text, low, speech):
    return F.array_compact(F.array(F.when(~has_text, "OCR_NO_TEXT"), F.when(has_text & low, "OCR_LOW_CONFIDENCE"), F.when(F.btrim(F.coalesce(speech, F.lit(""))) == "", "NO_NEARBY_SPEECH")))


def combined_context(visible, speech):
    return F.concat_ws("\n\n", F.nullif(visible, F.lit("")), F.nullif(speech, F.lit("")))


def enrich(ocr: DataFrame, alignment: DataFrame, assigned: DataFrame, titles: DataFrame) -> DataFrame:
    """Screenshots with speech and topic; those in no topic or in several are left to check_exactly_once."""
    once = assigned.groupBy("video_id", "trusted_index").agg(F.count("*").alias("topics"), F.min("topic_index").alias("topic_index")).where("topics = 1").drop("topics")
    speech = alignment.select("video_id", "trusted_index", F.col("text").alias("nearby_speech"))
    # Titles first meet the numbers: the texts are then joined by one key alone, and dealt by it once.
    named = once.join(titles.withColumnRenamed("title", "topic_title"), ["video_id", "topic_index"])
    rows = ocr.join(named, ["video_id", "trusted_index"]).join(speech, ["video_id", "trusted_index"])
    return rows.select(
        "video_id", "trusted_index", "candidate_index", "topic_index", "topic_title", F.col("text").alias("visible_text"), "nearby_speech", combined_context(F.col("text"), F.col("nearby_speech")).alias("combined_context"),
        F.col("mean_confidence").alias("ocr_mean_confidence"), F.col("word_count").alias("ocr_word_count"), coverage_flags(F.col("has_text"), F.col("low_confidence"), F.col("nearby_speech")).alias("coverage_flags"),
    )


def visual_keywords(content: DataFrame, k: int = 8) -> DataFrame:
    return top_tokens(content, "trusted_index", tx.visible_tokens(F.col("visible_text")), k)


def topic_content(content: DataFrame, k: int = 8) -> DataFrame:
    words = visual_keywords(content, k).groupBy("video_id", "topic_index").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "token"))), lambda x: x["token"]), ",").alias("visual_keywords"))
    totals = content.groupBy("video_id", "topic_index").agg(F.count("*").alias("screenshot_count"), F.count_if(F.btrim("visible_text") != "").alias("screenshots_with_ocr_text"), F.sum("ocr_word_count").alias("ocr_word_count"))
    return totals.join(words, ["video_id", "topic_index"], "left").withColumn("visual_keywords", F.coalesce("visual_keywords", F.lit("")))
