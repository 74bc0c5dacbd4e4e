"""Operators on hand-made rows, two lectures each so that a missing key shows."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from chalkline.config import CandidateConfig, ChangeConfig, StateConfig, TopicConfig
from chalkline.functions import text as tx
from chalkline.functions import vectors as vx
from chalkline.operators import candidates as cand
from chalkline.operators import catalog, lineage, ocr, pages, speech
from chalkline.operators import changes as chg

CHANGES = "video_id string, previous_frame_index int, frame_index int, previous_timestamp_seconds double, timestamp_seconds double, kind string, change_score double, changed_pixel_ratio double"


def change_rows(kinds, fps, video="a"):
    """(kind, score, ratio) a frame from frame 1 on."""
    return [(video, i, i + 1, i / fps, (i + 1) / fps, k, float(s), float(r)) for i, (k, s, r) in enumerate(kinds)]


QUIET = ("NONE", 0, 0)


@pytest.mark.parametrize(
    ("kinds", "fps", "config", "expected"),
    [
        ([QUIET] * 6 + [("LOCAL", 3, 0.01)] * 6 + [QUIET] * 7, 10, StateConfig(0.5, 0.45, 0.2), [("INITIAL_STABLE", 5, 0), ("STABLE_AFTER_CHANGE", 17, 6)]),
        ([("LOCAL", 3, 0.01)] * 2 + [QUIET] * 4 + [("SCENE", 80, 0.7), QUIET], 10, StateConfig(1.0, 0.3, 0.2), [("PRE_TRANSITION_PROTECTION", 6, 2), ("END_OF_VIDEO_FALLBACK", 8, 1)]),
        ([("LOCAL", 3, 0.01)] * 2 + [("STRUCTURAL", 20, 0.1)], 10, StateConfig(), [("END_OF_VIDEO_FALLBACK", 3, 3)]),
    ],
)
def test_stable_states(spark, kinds, fps, config, expected):
    rows = change_rows(kinds, fps) + change_rows([QUIET] * 3, fps, "b")
    got = chg.stable_states(spark.createDataFrame(rows, CHANGES), config).where("video_id = 'a'").orderBy("checkpoint_index").collect()
    assert [(r.reason, r.frame_index, r.activity_pair_count_since_previous) for r in got] == expected


def test_quiet_sentinels(spark):
    """10 fps, 100 frames: a window from 3 to 4 s, a lecture without windows, and one shorter than a stable stretch."""
    timeline = spark.createDataFrame([("a", 100, 10.0), ("b", 100, 10.0), ("c", 10, 1.0)], "video_id string, frame_count long, duration_seconds double")
    windows = spark.createDataFrame([("a", 0, 3.0, 4.0)], "video_id string, window_index int, start_seconds double, end_seconds double")
    pairs = spark.createDataFrame(change_rows([("LOCAL", 3, 0.01)] * 99, 10), CHANGES)
    got = chg.quiet_sentinels(windows, pairs, timeline).orderBy("video_id", "timestamp_seconds").collect()
    a = [r for r in got if r.video_id == "a"]
    assert [(r.previous_frame_index, r.frame_index, r.timestamp_seconds, r.kind) for r in (a[0], a[-1])] == [(0, 29, 3.0, "NONE"), (40, 99, 9.9, "NONE")]
    assert [r.frame_index for r in a[1:-1]] == list(range(31, 41)) and {r.activity_window_index for r in a[1:-1]} == {0}
    assert [(r.frame_index, r.timestamp_seconds, r.activity_window_index) for r in got if r.video_id == "b"] == [(12, 1.25, None), (99, 9.9, None)]
    assert [(r.frame_index, r.timestamp_seconds) for r in got if r.video_id == "c"] == [(9, 1.0)]


def test_timeline_drops_what_cannot_be_worked_out(spark):
    rows = [("a", 10.0, None, 640, 480, None), ("b", 10.0, 50, 640, 480, None), ("c", 10.0, None, 640, 480, 2.55), ("d", 10.0, 0, 640, 480, 0.0), ("e", 0.0, 5, 640, 480, 1.0)]
    df = spark.createDataFrame(rows, "video_id string, fps double, frame_count int, width int, height int, duration double")
    assert {r.video_id: (r.frame_count, r.duration_seconds) for r in catalog.timeline_metadata(df).collect()} == {"b": (50, 5.0), "c": (26, 2.55)}


def test_windows_of_frames_with_an_anchor(spark):
    """A lone LOCAL step counts, for it differs from the anchor too; a change that stays keeps its window open."""
    still = np.random.default_rng(3).random(64)
    frames = []
    for video, busy in (("a", True), ("b", False)):
        for i in range(24):
            v = still.copy()
            v[0] += 0.5 * (busy and i >= 4)
            v[:16] += 0.5 * (busy and i >= 10)
            frames.append((video, i, i * 0.5, v.tolist()))
    df = spark.createDataFrame(frames, "video_id string, frame_index int, timestamp_seconds double, thumb array<double>")
    got = chg.anchored_windows(df, 8, 0.5, ChangeConfig(pixel_delta=0.2, local_ratio=0.05, quiet_edge=1.0)).orderBy("window_index").collect()
    assert [(r.video_id, r.start_seconds, r.end_seconds, r.reason, r.coarse_sample_count) for r in got] == [("a", 1.5, 2.0, "PERSISTENT_LOCAL_CHANGE", 1), ("a", 4.5, 11.5, "STRUCTURAL_ACTIVITY", 14)]


def test_boundaries_against_a_plain_scan(spark):
    """All rows seen so far are looked at again at every row."""
    c, rng = TopicConfig(), np.random.default_rng(4)
    rows, want = [], []
    for video in "abc":
        at = np.cumsum(rng.integers(1, 40, 150)).astype(float)
        score = rng.choice([0.0, 0.2, 0.55, 0.9, 0.95, 1.4], 150, p=[0.5, 0.2, 0.15, 0.05, 0.05, 0.05])
        if video == "c":
            score = np.minimum(score, 0.6)
        seen, start, last, pending = [], 0.0, 0, 0
        for i in range(150):
            rows.append((video, i + 1, float(at[i]), float(score[i]), [] if score[i] < 0.5 else ["X"]))
            seen.append((i + 1, float(at[i]), float(score[i])))
            ready = [x for x in seen if x[0] > pending and x[2] >= c.threshold and x[1] - start >= c.min_seconds]
            pool = [x for x in seen if x[0] > last and x[1] - start >= c.min_seconds]
            if ready:
                best = max(ready, key=lambda x: (x[2], x[1]))
                pending = best[0]
            elif at[i] - start >= c.max_seconds and pool:
                best = max(pool, key=lambda x: x[2])
                pending = i + 1
            else:
                continue
            want.append((video, best[0]))
            start, last = best[1], best[0]
    df = spark.createDataFrame(rows, "video_id string, segment_index int, timestamp_seconds double, score double, reasons array<string>")
    first = spark.createDataFrame([(v, 0.0) for v in "abc"], "video_id string, first_start double")
    got = speech.choose_boundaries(df, first).collect()
    assert sorted((r.video_id, r.segment_index) for r in got) == want and {tuple(r.reasons) for r in got if r.video_id == "c"} <= {("X",), ("MAX_SECTION_DURATION",)}


def test_spans_meet_as_in_all_pairs(spark):
    from chalkline.functions.bands import meet

    rng = np.random.default_rng(5)
    left = [(str(v), i, float(x), float(x + w)) for i, (v, x, w) in enumerate(zip(rng.integers(0, 3, 60), rng.integers(0, 90, 60) / 2, rng.integers(-2, 30, 60), strict=True))] + [("0", 99, None, 3.0)]
    right = [(str(v), i, float(x), float(x + w)) for i, (v, x, w) in enumerate(zip(rng.integers(0, 3, 60), rng.integers(-10, 90, 60) / 2, rng.integers(0, 9, 60), strict=True))]
    a = spark.createDataFrame(left, "video_id string, i int, lo double, hi double")
    b = spark.createDataFrame(right, "video_id string, j int, low double, high double")
    got = sorted((r.i, r.j) for r in meet(a, b, (F.col("lo"), F.col("hi")), (F.col("low"), F.col("high")), 4.0).collect())
    assert got == sorted((i, j) for v, i, x, y in left for w, j, p, q in right if v == w and x is not None and x <= y and p <= q and x <= q and p <= y)


def test_text_extractor_keeps_lines(spark):
    """Line records, bare strings, and a result without lines."""
    from chalkline.operators import plugins

    record = {"text": "Binary Search", "confidence": 85.0, "bbox": [10, 20, 90, 10]}
    results = {
        b"one": {"text": "Binary Search\nMid", "lines": [record, {"text": "Mid", "confidence": 70, "bbox": [10, 40, 20, 10]}], "word_count": 3, "mean_confidence": 80.0, "has_text": True},
        b"two": {"text": "", "word_count": 0, "mean_confidence": 0.0, "has_text": False}, b"three": {"text": "a", "lines": ["a"], "line_count": 4, "word_count": 1, "mean_confidence": 50.0},
    }
    df = spark.createDataFrame([("v", 0, b"one"), ("w", 0, b"two"), ("w", 1, b"three")], "video_id string, trusted_index int, content binary")
    pages = plugins.apply_text_extractor(df, lambda: results.__getitem__).cache()
    got = {(r.video_id, r.trusted_index): ([x.asDict() for x in r.lines], r.line_count, r.low_confidence) for r in pages.collect()}
    mid = {"text": "Mid", "confidence": 70.0, "bbox": [10, 40, 20, 10]}
    assert got == {("v", 0): ([record, mid], 2, False), ("w", 0): ([], 0, False), ("w", 1): ([{"text": "a", "confidence": None, "bbox": None}], 4, True)}
    # The same lines as those made of word boxes.
    boxes = [("Binary", 0, 10, 20, 40, 10, 90.0), ("Search", 1, 60, 20, 40, 10, 80.0), ("Mid", 2, 10, 40, 20, 10, 70.0)]
    words = spark.createDataFrame([("v", 0, 1, 1, 1, 1 + (t == "Mid"), p, a, b, w, h, c, t) for t, p, a, b, w, h, c in boxes], "video_id string, trusted_index int, page int, block int, par int, line int, pos int, left int, top int, width int, height int, conf double, text string")
    columns = ["video_id", "trusted_index", "line_index", "text", "confidence", "left", "top", "width", "height"]
    made = sorted(tuple(r) for r in ocr.ocr_lines(words).select(*columns).collect())
    assert made == sorted(tuple(r) for r in plugins.extracted_lines(pages).where("video_id = 'v'").select(*columns).collect())


def test_callables_are_built_once_a_worker(spark, tmp_path):
    from chalkline.operators import plugins

    folder = str(tmp_path)

    def factory():
        import os
        import uuid

        open(os.path.join(folder, f"{os.getpid()}-{uuid.uuid4().hex}"), "w").close()
        return lambda content: {"text": content.decode(), "word_count": 1, "mean_confidence": 1.0, "has_text": True}

    df = spark.range(64).repartition(16).selectExpr("string(id) AS video_id", "0 AS trusted_index", "binary(string(id)) AS content")
    for _ in range(2):
        assert plugins.apply_text_extractor(df, factory).count() == 64
    workers = [name.split("-")[0] for name in os.listdir(folder)]
    assert 0 < len(workers) < 16 and len(workers) == len(set(workers))


def test_decisions_of_another_version_are_void(spark):
    """Candidates made anew clear what was decided on those before; a later decision on the new ones counts."""
    review = spark.createDataFrame([("a", i, i == 2, i != 1) for i in range(4)] + [("b", 0, False, True)], "video_id string, candidate_index int, auto_protected boolean, default_selected boolean")
    events = [("a", 0, False, False, 5, 2), ("a", 0, True, False, 9, 1), ("a", 1, True, False, 3, 2), ("a", 3, False, False, 4, 1), ("a", 2, False, False, 4, 2), ("b", 0, False, False, 1, 1), ("c", 0, False, False, 1, 1)]
    df = spark.createDataFrame(events, "video_id string, candidate_index int, selected boolean, force boolean, updated_at long, candidate_version int")
    versions = spark.createDataFrame([("a", 2), ("b", 1)], "video_id string, version int")
    overrides, rejects = cand.apply_decisions(review, df, versions)
    assert sorted(tuple(r) for r in overrides.collect()) == [("a", 0, False), ("a", 1, True), ("b", 0, False)]
    assert sorted(tuple(r) for r in rejects.collect()) == [("a", 0, "OTHER_VERSION"), ("a", 2, "PROTECTED"), ("a", 3, "OTHER_VERSION"), ("c", 0, "OTHER_VERSION")]


def test_states_without_rows(spark):
    assert chg.stable_states(spark.createDataFrame([], CHANGES)).count() == 0


@pytest.mark.parametrize(("a", "b", "reason"), [((0.04, 0.2, "LOCAL"), (0.04, 0.2, "SCENE"), "SCENE_REPLACEMENT"), ((0.05, 0.25, "LOCAL"), (0.01, 0.10, "LOCAL"), "DETAIL_DROP"), ((0.05, 0.25, "LOCAL"), (0.05, 0.25, "LOCAL"), None)])
def test_content_loss(spark, a, b, reason):
    df = spark.createDataFrame([("v", 0, *a), ("v", 1, *b), ("w", 0, *a)], "video_id string, candidate_index int, edge_density double, contrast_std double, source_change_kind string")
    got = {(r.video_id, r.candidate_index): r.content_loss_reason for r in cand.content_loss(df).collect()}
    assert got == {("v", 0): reason, ("v", 1): None, ("w", 0): None}


def test_near_duplicates_keep_protected(spark):
    v = [0.0, 1.0, 0.5]
    df = spark.createDataFrame([("v", 0, v, 5, False), ("v", 1, v, 5, False), ("v", 2, v, 5, True), ("w", 0, v, 5, False)], "video_id string, candidate_index int, thumb array<double>, dhash long, protected boolean")
    got = {(r.video_id, r.candidate_index): (r.kept, r.duplicate_of_candidate_index) for r in cand.suppress_near_duplicates(df, CandidateConfig()).collect()}
    assert got == {("v", 0): (True, None), ("v", 1): (False, 0), ("v", 2): (True, None), ("w", 0): (True, None)}


def test_decisions(spark):
    review = spark.createDataFrame([("v", 0, True, True, False), ("v", 1, False, False, False), ("v", 2, False, True, True)], "video_id string, candidate_index int, kept boolean, default_selected boolean, auto_protected boolean")
    events = spark.createDataFrame([("v", 1, True, False, 1), ("v", 0, True, False, 1), ("v", 0, False, False, 2), ("v", 2, False, False, 1), ("v", 9, True, False, 1)], "video_id string, candidate_index int, selected boolean, force boolean, updated_at int")
    overrides, rejects = cand.apply_decisions(review, events)
    assert sorted(map(tuple, overrides.collect())) == [("v", 0, False), ("v", 1, True)]
    assert sorted(map(tuple, rejects.collect())) == [("v", 2, "PROTECTED"), ("v", 9, "UNKNOWN_CANDIDATE")]


def test_change_kind_and_score(spark):
    rows = [(0.0, 0.0, 0.0, 0.0), (2.0, 0.03, 0.01, 0.1), (40.0, 0.95, 0.5, 1.0), (12.0, 0.1, 0.1, 0.5)]
    df = spark.createDataFrame(rows, "m double, r double, e double, b double")
    got = df.select(chg.change_kind(*map(F.col, "mreb")).alias("k"), chg.change_score(*map(F.col, "mre")).alias("s")).collect()
    assert [r.k for r in got] == ["NONE", "LOCAL", "SCENE", "STRUCTURAL"] and got[0].s == 0 and got[2].s == 100


def test_alignment_is_closed_on_both_sides(spark):
    trusted = spark.createDataFrame([("v", 0, 0, 10.0), ("v", 1, 1, 22.0), ("w", 0, 0, 100.0)], "video_id string, trusted_index int, candidate_index int, timestamp_seconds double")
    segments = spark.createDataFrame([("v", 0, 0.0, 5.0, "the middle index"), ("v", 1, 8.0, 14.0, " "), ("v", 2, 18.0, 25.0, "left boundary")], "video_id string, segment_index int, start_seconds double, end_seconds double, text string")
    got = {(r.video_id, r.trusted_index): (r.segment_indexes, r.text) for r in speech.align(trusted, segments).collect()}
    assert got == {("v", 0): ([0, 1, 2], "the middle index left boundary"), ("v", 1): ([2], "left boundary"), ("w", 0): ([], "")}


def test_ocr_lines_and_pages(spark):
    rows = [("v", 0, 1, 0, 0, 0, 0, 10, 20, 40, 10, 90.0, "Binary"), ("v", 0, 1, 0, 0, 0, 1, 55, 20, 45, 10, 80.0, "Search"), ("v", 0, 1, 0, 0, 1, 2, 10, 40, 30, 10, 70.0, "Mid")]
    df = spark.createDataFrame(rows, "video_id string, trusted_index int, page int, block int, par int, line int, pos long, `left` int, top int, width int, height int, conf double, text string")
    page = ocr.ocr_pages(df).first()
    line = ocr.ocr_lines(df).where("line_index = 0").first()
    assert (page.text, page.line_count, page.word_count, page.mean_confidence) == ("Binary Search\nMid", 2, 3, 80.0)
    assert (line.left, line.top, line.width, line.height) == (10, 20, 90, 10)


def test_page_order_and_plan(spark):
    trusted = spark.createDataFrame([("v", i) for i in range(3)] + [("w", 0)], "video_id string, trusted_index int")
    orders = spark.createDataFrame([("v", 0, 2), ("v", 1, 0), ("v", 2, 1)], "video_id string, position int, trusted_index int")
    assert {r.video_id: r.valid for r in pages.order_is_permutation(orders, trusted).collect()} == {"v": True, "w": False}
    items = spark.createDataFrame([("v", 0, 0, 0), ("v", 1, 1, 0), ("v", 2, 2, 1)], "video_id string, position int, trusted_index int, topic_index int")
    assert [r.page_kind for r in pages.page_plan(items).orderBy("page_no").collect()] == ["COVER", "DIVIDER", "SCREENSHOT", "SCREENSHOT", "DIVIDER", "SCREENSHOT"]


def test_scalars(spark):
    df = spark.createDataFrame([(3661.0, "Okay, next  let us see foo.bar the thing", "")], "s double, t string, e string")
    got = df.select(tx.duration_text(F.col("s")).alias("d"), tx.duration_text(-F.col("s")).alias("n"), tx.word_count(F.col("e")).alias("w"), tx.speech_tokens(F.col("t")).alias("k"), tx.strip_cue(F.col("t")).alias("c"), tx.title_words(F.lit("foo.bar")).alias("h")).first()
    assert (got.d, got.n, got.w, got.k, got.c, got.h) == ("1:01:01", "0:00", 0, ["next", "foo.bar"], "let us see foo.bar the thing", "Foo.Bar")


def test_vectors_against_numpy(spark):
    rng = np.random.default_rng(0)
    a, b = rng.random(64), rng.random(64)
    df = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<double>, b array<double>")
    got = df.select(vx.mean_abs_difference(F.col("a"), F.col("b")).alias("d"), vx.dhash(F.col("a"), 8, 8).alias("h"), vx.contrast_std(F.col("a"), 1.0).alias("s")).first()
    grid = a.reshape(8, 8)
    bits = (grid[:, 1:] > grid[:, :-1]).ravel()
    assert abs(got.d - np.abs(a - b).mean()) < 1e-12 and abs(got.s - a.std()) < 1e-12 and got.h == int("".join(str(int(x)) for x in bits), 2)


def test_catalog_urls(spark):
    ok = "https://example.com/watch?v=abcdefghijk"
    urls = [ok, "http://www.example.com/watch?x=1&v=abcdefghijk#t", "https://EXAMPLE.org/abcdefghijk", "https://m.example.com/shorts/abcdefghijk", "https://example.com/watch?v=short", "ftp://example.com/watch?v=abcdefghijk", "nonsense", None]
    got = catalog.normalize_source_catalog(spark.createDataFrame([(u,) for u in urls], "url string")).collect()
    assert [(r.video_id, r.normalized_url) for r in got if r.accepted] == [("abcdefghijk", ok)]
    assert len([r for r in got if not r.accepted]) == 4


def test_lineage_cascades(spark):
    rows = [("v", s, "in", 1 if s != "states" else 0) for s in lineage.DAG]
    fresh = lineage.artifact_freshness(spark.createDataFrame(rows, "video_id string, stage string, input string, recorded_version int"), spark.createDataFrame([("v", "in", 1)], "video_id string, input string, version int"))
    got = {r.stage: r.status for r in lineage.stale_cascade(fresh).collect()}
    assert got["changes"] == got["transcript"] == "FRESH" and got["states"] == got["coverage"] == got["topics"] == "STALE"


def test_windows_come_from_every_change(spark):
    """Strong changes at odd frames and a run of LOCAL ones each open a window; quiet_sentinels keeps their pairs."""
    from chalkline.plans import queries
    from chalkline.plans.library import Library

    class Fixture(Library):
        @property
        def changes(self):
            busy = {101: "SCENE", 303: "STRUCTURAL", 501: "LOCAL", 502: "LOCAL", 701: "LOCAL"}
            rows = [("a", i - 1, i, (i - 1) / 10, i / 10, busy.get(i, "NONE"), 50.0 if i in busy else 0.0, 0.1) for i in range(1, 1000)]
            return spark.createDataFrame(rows, "video_id string, previous_frame_index int, frame_index int, previous_timestamp_seconds double, timestamp_seconds double, kind string, change_score double, changed_pixel_ratio double")

        @property
        def timeline(self):
            return spark.createDataFrame([("a", 1000, 99.9, 99.9)], "video_id string, frame_count long, duration_seconds double, last_timestamp_seconds double")

    x = Fixture(spark, "")
    assert [(round(r.start_seconds, 1), round(r.end_seconds, 1)) for r in x.windows.orderBy("window_index").collect()] == [(9.0, 12.1), (29.2, 32.3), (49.1, 52.2)]
    made = getattr(queries.quiet_sentinels, "__wrapped__", queries.quiet_sentinels)(x).collect()
    assert {r.frame_index for r in made if r.kind != "NONE"} == {101, 303, 501, 502}
