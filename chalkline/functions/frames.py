"""Differences of gray frames in Arrow batches: many pairs of frames as one array, for frames too long for column functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from chalkline.config import ChangeConfig

#: Values of frames that are held at once, on each side of the pairs.
VALUES = 1 << 22
METRICS = ("mean_pixel_delta", "changed_pixel_ratio", "edge_change_ratio", "change_bbox_area_ratio")


def measure(before: np.ndarray, after: np.ndarray, edge: float, pixel_delta: float) -> np.ndarray:
    """METRICS of each pair; frames are (pairs, rows, columns), ``before`` may be one frame for all."""
    size = after[0].size
    delta = np.abs(after - before)
    changed = delta >= pixel_delta
    edges = lambda x: np.abs(np.diff(x, axis=-1)) > edge
    moved = (edges(before) != edges(after)).sum((1, 2)) / size
    extent = lambda flags: np.where(flags.any(1), flags.shape[1] - flags[:, ::-1].argmax(1) - flags.argmax(1), 0)
    box = extent(changed.any(2)) * extent(changed.any(1)) / size
    flat = delta.reshape(len(delta), -1)
    return np.stack([flat.mean(1), changed.reshape(len(delta), -1).mean(1), moved, box], axis=1)


def classify(metrics: np.ndarray, c: ChangeConfig) -> list[tuple[str, float]]:
    """Class and score of each row of METRICS."""
    mean, ratio, moved, box = metrics.T
    none = (mean <= c.quiet_mean) & (ratio <= c.quiet_ratio) & (moved <= c.quiet_edge)
    scene = (ratio >= c.scene_ratio) | (mean >= c.scene_mean)
    local = (ratio <= c.local_ratio) & (box <= c.local_bbox) & (mean <= c.local_mean)
    kind = np.select([none, scene, local], ["NONE", "SCENE", "LOCAL"], "STRUCTURAL")
    score = 100.0 * (0.35 * np.minimum(1.0, mean / 40.0) + 0.45 * np.minimum(1.0, ratio / 0.35) + 0.20 * np.minimum(1.0, moved / 0.20))
    return list(zip(kind.tolist(), (np.floor(score * 10000 + 0.5) / 10000).tolist(), strict=True))


def pair_metrics(pairs: DataFrame, before: str, after: str, columns: int, edge: float, pixel_delta: float) -> DataFrame:
    """``pairs`` and METRICS of two frames in each row (arrays of numbers, row by row, of ``columns`` columns; all of one size).

    Rows in which a frame is null have null metrics; columns named as metrics are
    replaced.  Batches are taken in blocks of VALUES values.
    """
    new = [T.StructField(n, T.DoubleType()) for n in METRICS]
    pairs = pairs.drop(*METRICS)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            out = np.full((batch.num_rows, len(METRICS)), np.nan)
            sides = [batch.column(n) for n in (before, after)]
            rows = np.flatnonzero(~(sides[0].is_null().to_numpy(zero_copy_only=False) | sides[1].is_null().to_numpy(zero_copy_only=False)))
            size = len(sides[0][rows[0]]) if len(rows) else 1
            step = max(1, VALUES // max(1, size))
            for at in range(0, len(rows), step):
                part = pa.array(rows[at : at + step])
                a, b = (np.asarray(s.take(part).flatten(), np.float64).reshape(len(part), -1, columns) for s in sides)
                out[rows[at : at + step]] = measure(a, b, edge, pixel_delta)
            made = [pa.array(out[:, i], from_pandas=True) for i in range(len(METRICS))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *METRICS])

    return pairs.mapInArrow(run, T.StructType([*pairs.schema.fields, *new]))
