"""Sequential rules in slices of a lecture against the same rules over whole lectures."""

import numpy as np
import pytest

from chalkline.config import ChangeConfig, StateConfig, TopicConfig
from chalkline.operators import changes as chg
from chalkline.operators import speech
from chalkline.operators.folds import Fold, sliced

CHANGES = "video_id string, previous_frame_index int, frame_index int, previous_timestamp_seconds double, timestamp_seconds double, kind string, change_score double, changed_pixel_ratio double"
SIZES = (7, 1_000)  # rows a slice; slices of one row are tried on the short lecture b


def agree(fold, df, least):
    """The rule over whole lectures, and in slices."""
    want = rows_of(fold(df, 1 << 20))
    assert len(want) >= least
    for n in SIZES:
        assert rows_of(fold(df, n)) == want
    assert rows_of(fold(df.where("video_id = 'b'"), 1)) == [r for r in want if r[0] == "b"]


@pytest.fixture(scope="module")
def changes(spark):
    """Three lectures: one of 1,200 rows with bursts and quiet, a short one, and one that never rests."""
    rng, rows = np.random.default_rng(21), []
    for video, n, quiet in (("a", 1_200, 0.9), ("b", 40, 0.9), ("c", 160, 0.0)):
        at = np.round(np.cumsum(rng.uniform(0.02, 0.5, n + 1)), 3)
        kind = "NONE"
        for i in range(n):
            if rng.random() < 0.2:
                kind = "NONE" if rng.random() < quiet * 0.7 else str(rng.choice(["LOCAL", "STRUCTURAL", "SCENE"]))
            score = 0.0 if kind == "NONE" else round(float(rng.uniform(1, 60)), 2)
            rows.append((video, i, i + 1, float(at[i]), float(at[i + 1]), kind, score, score / 200))
    return spark.createDataFrame(rows, CHANGES).repartition(5).cache()


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("config", [StateConfig(), StateConfig(0.5, 0.3, 4.0)])
def test_states_in_slices(changes, config):
    """The second setting has a gap so long that slices depend on those before them for many rows."""
    agree(lambda df, n: chg.stable_states(df, config, n), changes, 20)


def test_pair_windows_in_slices(changes):
    agree(lambda df, n: chg.coarse_windows(df, slice_rows=n), changes, 20)


def test_frame_windows_in_slices(spark):
    rng, rows = np.random.default_rng(4), []
    for video, n in (("a", 1_100), ("b", 40)):
        frame = still = rng.random(64)
        for i in range(n):
            if rng.random() < 0.15:  # something moves, or all is as it was
                frame = still.copy()
                frame[rng.integers(0, 64, rng.choice([0, 1, 3, 20], p=[0.7, 0.1, 0.1, 0.1]))] += 0.5
            rows.append((video, i, i * 0.4, frame.tolist()))
    df = spark.createDataFrame(rows, "video_id string, frame_index int, timestamp_seconds double, thumb array<double>").repartition(3)
    c = ChangeConfig(pixel_delta=0.2, local_ratio=0.05, quiet_edge=1.0)
    agree(lambda df, n: chg.anchored_windows(df, 8, 0.5, c, slice_rows=n), df, 20)


def test_boundaries_in_slices(spark):
    rng, rows = np.random.default_rng(9), []
    for video, n in (("a", 1_200), ("b", 40), ("c", 150)):
        at = np.cumsum(rng.integers(1, 40, n)).astype(float)
        score = rng.choice([0.0, 0.2, 0.55, 0.9, 0.95, 1.4], n, p=[0.5, 0.2, 0.15, 0.05, 0.05, 0.05])
        score = np.minimum(score, 0.6) if video == "c" else score
        rows += [(video, i + 1, float(at[i]), float(score[i]), [] if score[i] < 0.5 else ["X"]) for i in range(n)]
    df = spark.createDataFrame(rows, "video_id string, segment_index int, timestamp_seconds double, score double, reasons array<string>")
    first = spark.createDataFrame([(v, 0.0) for v in "abc"], "video_id string, first_start double")
    agree(lambda df, n: speech.choose_boundaries(df, first, TopicConfig(), n), df, 50)


def test_timestamps_in_slices_no_larger_than_asked_for(spark):
    rng, rows = np.random.default_rng(2), []
    for video, n in (("a", 2_500), ("b", 5)):
        raw = np.round(np.arange(n) / 4 + rng.choice([0, 0, 0, -9, 30], n), 3)
        rows += [(video, i, float(0 if rng.random() < 0.1 else raw[i]), 4.0) for i in range(n)]
    df = spark.createDataFrame(rows, "video_id string, frame_index int, raw double, fps double").repartition(4)
    agree(chg.repair_timestamps, df, 2_505)
    fold = Fold(chg.Repair, ("frame_index", "raw", "fps"), ("frame_index",), "frame_index int, timestamp_seconds double")
    parts = sliced(df, fold, 100).groupBy("video_id", "slice").count().collect()
    assert max(r["count"] for r in parts) <= 100 and len(parts) >= 26


def test_no_rows(changes):
    assert chg.stable_states(changes.limit(0)).count() == 0 and chg.coarse_windows(changes.limit(0), slice_rows=1).count() == 0
