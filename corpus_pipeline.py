"""Corpus pipeline: documents are scored, cleaned, deduplicated twice and packed.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept.  All but the last return the columns of documents; stages that
change a text set n_chars to its new length.  SQL can't express the fitted model
of the first stage, so the pipeline is tested against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.llm import jaccard, packing, quality_model, quality_rules, substring_dedup
from chalkline.llm.common import read, write_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words in a packed sequence.
CAPACITY = 2_048


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls good.

    Rows are judged one by one: repeated rows and ties fare alike, null and empty
    texts by the bias alone, texts of any length whole.  Extra columns are left out.
    """
    return quality_model.quality_scores(docs, read(spark, sf_dir, "labels")).where("predicted = 1").select(COLUMNS)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines that fail.

    Rows are judged one by one.  Null and empty texts have too few words and go.
    """
    judged = quality_rules.accepted(quality_rules.judge(docs))
    return judged.select("doc_id", F.col("cleaned_text").alias("text"), "lang", "source", F.length("cleaned_text").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar documents: the one with the smallest id.

    Null and empty texts are similar to nothing and stay.  Rows that repeat id and
    text are one document: that with the least language, source and length stays.
    All texts of an id stay or go together.  Rows with a null id stay as they are.
    """
    first = jaccard.join_components(docs, jaccard.Similarity(words=5, percent=80)).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("rest")).select("doc_id", "text", "rest.*")
    return kept.select(COLUMNS).union(docs.where(F.col("doc_id").isNull()).select(COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur before, by id and place.

    No row goes: a text may become empty, null texts stay null.  Repeated rows get
    equal texts.  Rows with a null id keep their text.
    """
    out = substring_dedup.dedupe(docs)
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences.

    Null and empty texts have one piece of length 0 in no bin; long texts have
    several pieces.  Repeated rows are pieces of their own; ties go by id.
    """
    return packing.pack(docs, CAPACITY)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("best-fit packing", best_fit),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again before the next stage."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = write_table(docs, f"stage-{i}")
    return docs
