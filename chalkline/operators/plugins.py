"""User functions: text extraction from images and transcription of audio, built once a worker."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.operators.ocr import with_flags

LINES = "array<struct<text string, confidence double, bbox array<int>>>"
#: What the factories of this worker process have built, models and all.
_BUILT: dict[str, Any] = {}


def built(key: str, factory: Callable[[], Any]) -> Any:
    if key not in _BUILT:
        _BUILT[key] = factory()
    return _BUILT[key]


def once_a_worker(factory: Callable[[], Any]) -> Callable[[], Any]:
    """``factory``, but a worker process that serves several tasks builds once; factories are told apart by what is sent of them."""
    key = hashlib.sha256(cloudpickle.dumps(factory)).hexdigest()

    def get() -> Any:
        from chalkline.operators import plugins  # the worker's own module: what is sent with this function would be a copy

        return plugins.built(key, factory)

    return get


def spread_by_size(rows: DataFrame) -> DataFrame:
    """Rows dealt anew so that tasks get about equal bytes, whatever the sizes of single ones."""
    return rows.hint("rebalance")


def line_record(line: Any) -> dict:
    """A line as text, confidence and box (left, top, width, height); bare strings have neither of the latter."""
    if isinstance(line, str):
        return {"text": line, "confidence": None, "bbox": None}
    box, confidence = line.get("bbox"), line.get("confidence")
    return {"text": str(line.get("text") or ""), "confidence": None if confidence is None else float(confidence), "bbox": None if box is None else [int(x) for x in box]}


def apply_text_extractor(images: DataFrame, factory: Callable[[], Callable[[bytes], dict]], spread: bool = False) -> DataFrame:
    """images video_id, trusted_index, content -> text, lines, line_count, word_count, mean_confidence and flags of each image.

    ``lines`` are those of the callable's result (none if it has none), records of
    text, confidence and bbox or bare strings; its line_count too, and the number
    of lines where it gives no count.  The callable is built once a worker.
    ``spread``: deal the images anew by their sizes first.
    """
    get = once_a_worker(factory)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extract = get()
        for part in parts:
            results = [extract(bytes(x)) for x in part.content]
            found = pd.DataFrame(results, columns=["text", "word_count", "mean_confidence", "has_text"], index=part.index)
            found["lines"] = [[line_record(x) for x in r["lines"]] if isinstance(r.get("lines"), list) else [] for r in results]
            found["line_count"] = [int(r.get("line_count") or len(n)) for r, n in zip(results, found["lines"], strict=True)]
            yield pd.concat([part[["video_id", "trusted_index"]], found], axis=1)

    images = spread_by_size(images) if spread else images
    return with_flags(images.mapInPandas(run, f"video_id string, trusted_index int, text string, word_count long, mean_confidence double, has_text boolean, lines {LINES}, line_count int"))


def extracted_lines(pages: DataFrame) -> DataFrame:
    """The lines of apply_text_extractor() as rows, with the columns that ocr_lines() has for lines made of words."""
    rows = pages.select("video_id", "trusted_index", F.posexplode("lines").alias("line_index", "line"))
    box = {name: F.get("line.bbox", i).alias(name) for i, name in enumerate(("left", "top", "width", "height"))}
    return rows.select("video_id", "trusted_index", "line_index", F.col("line.text").alias("text"), F.col("line.confidence").alias("confidence"), *box.values())


def apply_transcriber(audio: DataFrame, factory: Callable[[], Callable[[bytes], Iterator[tuple[float, float, str]]]], spread: bool = False) -> DataFrame:
    """audio video_id, raw_base, content -> raw segments, one row to many.  The callable is built once a worker."""
    get = once_a_worker(factory)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        transcribe = get()
        for part in parts:
            rows = [(r.video_id, r.raw_base * 1_000_000 + i, *x) for r in part.itertuples() for i, x in enumerate(transcribe(bytes(r.content)))]
            yield pd.DataFrame(rows, columns=["video_id", "raw_index", "start", "end", "text"])

    audio = spread_by_size(audio) if spread else audio
    return audio.mapInPandas(run, "video_id string, raw_index long, start double, end double, text string")
