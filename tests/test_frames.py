"""Differences of frames in Arrow batches against column functions and against one pair at a time."""

import numpy as np
from pyspark.sql import functions as F

from chalkline.config import ChangeConfig
from chalkline.functions import frames
from chalkline.functions import vectors as vx


def one_pair(a, b, edge, limit):
    """The metrics of a pair, place by place."""
    height, width = a.shape
    changed = [(r, k) for r in range(height) for k in range(width) if abs(b[r, k] - a[r, k]) >= limit]
    has = lambda x, r, k: abs(x[r, k + 1] - x[r, k]) > edge
    moved = sum(has(a, r, k) != has(b, r, k) for r in range(height) for k in range(width - 1))
    rows, columns = [r for r, _ in changed], [k for _, k in changed]
    box = (max(rows) - min(rows) + 1) * (max(columns) - min(columns) + 1) if changed else 0
    return [np.abs(b - a).mean(), len(changed) / a.size, moved / a.size, box / a.size]


def test_measures_of_single_pairs():
    rng = np.random.default_rng(7)
    before = rng.integers(0, 255, (30, 9, 16)).astype(float)
    after = before.copy()
    for i in range(1, 30):
        after[i].ravel()[rng.integers(0, 144, i // 3)] += rng.uniform(-40, 40)
    got = frames.measure(before, after, 8.0, 12.0)
    assert np.allclose(got, [one_pair(a, b, 8.0, 12.0) for a, b in zip(before, after, strict=True)])
    same = frames.measure(before[0], after[:5], 8.0, 12.0)
    assert np.allclose(same, [one_pair(before[0], b, 8.0, 12.0) for b in after[:5]])
    c = ChangeConfig()
    assert [k for k, _ in frames.classify(np.array([[0, 0, 0, 0], [40, 0.9, 0.2, 1], [2, 0.01, 0.01, 0.1], [20, 0.2, 0.1, 0.9]]), c)] == ["NONE", "SCENE", "LOCAL", "STRUCTURAL"]


def test_batches_as_column_functions(spark, monkeypatch):
    """Blocks of a few pairs, nulls, a clashing column, and no rows."""
    monkeypatch.setattr(frames, "VALUES", 500)
    rng, rows = np.random.default_rng(8), []
    for i in range(60):
        a = rng.uniform(0, 255, 144)
        b = a.copy()
        b[rng.integers(0, 144, i % 7)] += 30
        rows.append((i, a.tolist(), b.tolist(), "clash"))
    rows += [(60, None, rows[0][1], "clash"), (61, rows[0][1], None, "clash")]
    df = spark.createDataFrame(rows, "n int, a array<double>, b array<double>, change_bbox_area_ratio string")
    got = {r.n: [r[m] for m in frames.METRICS] for r in frames.pair_metrics(df, "a", "b", 16, 8.0, 12.0).collect()}
    assert got[60] == got[61] == [None] * 4
    edges = lambda v: vx.edges(F.col(v), 16, 8.0)
    wide = df.where("n < 60").withColumns({"changed": F.zip_with("a", "b", lambda x, y: F.abs(y - x) >= 12.0), "moved": F.zip_with(edges("a"), edges("b"), lambda x, y: x != y)})
    want = wide.select("n", vx.mean_abs_difference(F.col("a"), F.col("b")), vx.share(F.col("changed")), vx.share(F.col("moved")), vx.bbox_share(F.col("changed"), 16)).collect()
    assert all(np.allclose(got[r[0]], list(r)[1:]) for r in want)
    assert frames.pair_metrics(df.limit(0), "a", "b", 16, 8.0, 12.0).collect() == []
