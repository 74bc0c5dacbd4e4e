"""Work that must grow no faster than the rows of a lecture: plans and results on longer lectures."""

from types import SimpleNamespace

import numpy as np
from pyspark.sql import functions as F

from chalkline.functions import text as tx
from chalkline.operators import changes as chg
from chalkline.operators import coverage, speech
from chalkline.plans import queries
from chalkline.plans.library import STAGES, Library
from chalkline.sources import artifacts


def plan(df) -> str:
    return df._jdf.queryExecution().toString().lower()


def test_span_metrics_reads_each_row_once(spark):
    """No window ends with the partition, which Spark sums up anew for each row; results as counted by hand."""
    rows = spark.range(1, 3001).select(
        F.lit("a").alias("video_id"), F.col("id").cast("int").alias("frame_index"), (F.col("id") / 10).alias("timestamp_seconds"),
        F.when(F.col("id") % 3 == 0, "LOCAL").otherwise("NONE").alias("kind"), F.col("id").cast("double").alias("change_score"),
    )
    states = spark.createDataFrame([("a", 0, 9), ("a", 1, 10), ("a", 2, 2000)], "video_id string, checkpoint_index int, frame_index int")
    got = chg.span_metrics(rows, states)
    assert "unboundedfollowing" not in plan(got)
    assert sorted(map(tuple, got.collect())) == [("a", 0, 9.0, 3), ("a", 1, 0.0, 0), ("a", 2, 1998.0, 663)]


def test_tokens_are_counted_where_the_rows_of_a_topic_are(spark):
    """Rows are dealt by topic; the tokens made of them, many times their size, are not shuffled."""
    rows = spark.createDataFrame([("a", 0, 0, "tree graph tree"), ("a", 1, 0, "graph node tree"), ("a", 2, 1, "node")], "video_id string, segment_index int, topic_index int, text string")
    got = speech.top_tokens(rows, "segment_index", tx.speech_tokens(F.col("text")), 2)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString().split("Generate")[0]
    assert sorted(map(tuple, got.select("topic_index", "rank", "token", "n").collect())) == [(0, 1, "tree", 3), (0, 2, "graph", 2), (1, 1, "node", 1)]


def test_boundary_scores_join_numbers(spark):
    """The words of the windows are compared before the join, which then has none of them to shuffle."""
    segments = spark.createDataFrame([("a", i, i * 10.0, i * 10.0 + 9, f"word{i} other{i % 3}") for i in range(6)], "video_id string, segment_index int, start_seconds double, end_seconds double, text string")
    near = spark.createDataFrame([("a", 2)], "video_id string, segment_index int")
    got = speech.boundary_scores(segments, near)
    below = got._jdf.queryExecution().optimizedPlan().toString().split("Join LeftOuter")[1].split("\n")[1]
    assert "AS novelty" in below
    assert [r.segment_index for r in got.where(F.array_contains("reasons", "VISUAL_SECTION_CHANGE")).collect()] == [2]


def test_nearest_distance_goes_through_a_lecture_once_each_way(spark):
    shots = [("a", 5.0, 0), ("a", 5.0, 1), ("a", 40.0, 2), ("b", 7.0, 0)]
    at = [("a", 0, 1.0), ("a", 1, 5.0), ("a", 2, 22.0), ("a", 3, 23.0), ("a", 4, 50.0), ("b", 0, 9.0), ("c", 0, 1.0)]
    trusted = spark.createDataFrame(shots, "video_id string, timestamp_seconds double, trusted_index int")
    clusters = spark.createDataFrame(at, "video_id string, cluster_index int, midpoint double")
    got = coverage.nearest_distance(clusters, trusted)
    assert "unboundedfollowing" not in plan(got)
    brute = {(v, i): min((abs(t - s) for w, s, _ in shots if w == v), default=None) for v, i, t in at}
    assert {(r.video_id, r.cluster_index): r.distance for r in got.collect()} == brute


def test_gap_queries_make_only_what_they_return(spark):
    """Each gets the one table besides the gaps that it counts: speech, changes or states."""
    trusted = spark.createDataFrame([("a", 1000.0)], "video_id string, timestamp_seconds double")
    durations = spark.createDataFrame([("a", 2000.0)], "video_id string, duration double")
    tables = {
        "segments": [("a", 990.0, 1010.0, "two words"), ("a", 1500.0, 1501.0, "one")], "changes": [("a", 1000.0, "SCENE"), ("a", 5.0, "NONE"), ("a", 1999.0, "LOCAL")],
        "resolved": [("a", 1000.0, "TRUSTED"), ("a", 1200.0, "TRUSTED"), ("a", 1300.0, "UNRESOLVED")],
    }
    columns = {"segments": "start_seconds double, end_seconds double, text string", "changes": "timestamp_seconds double, kind string", "resolved": "timestamp_seconds double, resolution string"}
    expected = {"gap_speech_overlap": ("segments", (1, 2), (2, 3)), "gap_visual_activity": ("changes", (1,), (2,)), "gap_states": ("resolved", (0, 0), (2, 1))}
    for name, (table, first, second) in expected.items():
        rows = spark.createDataFrame(tables[table], f"video_id string, {columns[table]}")
        got = queries.SPARK[name](SimpleNamespace(trusted=trusted, lecture_durations=durations, **{table: rows}))
        assert sorted(map(tuple, got.collect())) == [("a", 0.0, 1000.0, *first), ("a", 1000.0, 2000.0, *second)]


def test_scan_of_a_long_lecture_in_slices(spark):
    """slices of 1, 7 and 1,000 rows give the rows of one run by plain rules, and no group holds a whole lecture."""
    rng = np.random.default_rng(5)
    pairs, windows, frames = [], [], {}
    for video in ("a", "b", "c"):
        times = np.round(np.cumsum(rng.choice([0.0, 0.02, 0.1, 0.7], 400)), 4)
        pairs += [(video, i - 1, i, float(times[i - 1]), float(times[i]), "LOCAL", float(i % 9), 0.01, float(i)) for i in range(1, 400)]
        frames[video] = (400 if video == "a" else 300, float(times[-1]))  # in b frames are beyond the last
        starts = [] if video == "c" else sorted(rng.uniform(0, times[-1], 6).tolist())
        windows += [(video, n, s, s + float(rng.uniform(0.1, 9))) for n, s in enumerate(starts)]
    timeline = spark.createDataFrame([(v, *x) for v, x in [*frames.items(), ("d", (5, 0.0))]], "video_id string, frame_count long, duration_seconds double")
    changes = spark.createDataFrame(pairs, "video_id string, previous_frame_index int, frame_index int, previous_timestamp_seconds double, timestamp_seconds double, kind string, change_score double, changed_pixel_ratio double, mean_pixel_delta double")
    spans = spark.createDataFrame(windows, "video_id string, window_index int, start_seconds double, end_seconds double")

    def plain(video: str) -> list[tuple]:
        (count, duration), out, at, frame = frames[video], [], 0.0, 0
        last, fps = count - 1, count / duration

        def bridge(until, target):
            nonlocal at, frame
            target = min(max(target, frame + 1), last)
            if until > at and target > frame:
                out.append((frame, target, at, until, None, "NONE", 0.0, round(until - at, 6), 0.0))
                at, frame = until, target

        def placed(number, seconds):
            return min(max(number, frame + 1) if out and seconds > at else number, last)

        for _, index, start, end in (w for w in windows if w[0] == video):
            if start - at >= 1.25:
                bridge(start, round(start * fps) - 1)
            previous = None
            for _, i, j, since, until, kind, score, _, mean in (p for p in pairs if p[0] == video and p[3] >= start and p[4] <= end):
                previous = placed(i, since) if previous is None else previous
                now = placed(j, until)
                target = min(max(previous + 1, now), last)
                if target > previous and target > frame and since >= at:
                    out.append((previous, target, since, until, index, kind, score, round(until - since, 6), mean))
                    at, frame = until, target
                previous = now
        if not out:
            bridge(min(duration, 1.25), max(1, round(min(duration, 1.25) * fps)))
        if duration - at >= 1.25:
            bridge(min(duration, max(at, last / fps)), round(min(duration, max(at, last / fps)) * fps))
        return [(video, *r) for r in out]

    names = ("video_id", "previous_frame_index", "frame_index", "previous_timestamp_seconds", "timestamp_seconds", "activity_window_index", "kind", "change_score", "delta_seconds", "mean_pixel_delta")
    expected = sorted((r for v in frames for r in plain(v)), key=str)
    for slice_rows in (1_000, 7, 1):
        made = chg.quiet_sentinels(spans, changes, timeline, slice_rows=slice_rows)
        assert sorted((tuple(r) for r in made.select(*names).collect()), key=str) == expected


def test_image_folders_are_listed_by_a_few_tasks(spark, tmp_path):
    """200 folders of one image each, which Spark lists by a task a folder unless told otherwise."""
    names = spark.range(200).select(F.concat(F.lit("a b-"), "id", F.lit(".png")).alias("image_filename"))
    names.withColumn("value", F.lit("x")).write.partitionBy("image_filename").text(str(tmp_path / "images"))
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before, context = spark.conf.get(key), spark.sparkContext
    context.setJobGroup("listing", "listing")
    try:
        got = artifacts.read_image_assets(spark, str(tmp_path / "images"))
        tracker = context.statusTracker()
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert [s.numTasks <= 4 * context.defaultParallelism < 200 for s in stages] == [True]
    assert spark.conf.get(key) == before
    assert {tuple(r) for r in got.collect()} == {(f"a b-{i}.png", 2) for i in range(200)}


def test_images_are_written_by_many_tasks(spark, tmp_path):
    """the files of one task's rows are not all written by that task."""
    rows = spark.range(300).coalesce(1).select(F.lit("0").alias("video_id"), F.col("id").cast("int").alias("candidate_index"), F.concat("id", F.lit(".png")).alias("image_filename"))
    x = SimpleNamespace(spark=spark, trusted=rows)
    path = queries._image_folder(x)
    tasks = {r.t for r in spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"part-(\d+)", 1).alias("t")).collect()}
    assert len(tasks) > 1 and spark.read.format("binaryFile").load(path).count() == 250


def test_a_rule_makes_its_own_tables_only(spark):
    """topics without a screenshot need neither events, nor states, nor visible text."""
    topics = spark.createDataFrame([("a", 0, 0.0, 9.0, 1, 5, 0), ("a", 1, 9.0, 12.0, 1, 5, 2)], "video_id string, topic_index int, start_seconds double, end_seconds double, segment_count int, word_count int, screenshot_count int")
    x = Library(spark, "/nowhere")
    x._made["topics"] = topics
    got = queries.SPARK["rule_topic_without_visual"](x).collect()
    assert [(r.video_id, r.start_seconds, r.end_seconds) for r in got] == [("a", 0.0, 9.0)] and set(x._made) == {"topics"}


def test_keywords_of_titles_are_counted_once(spark):
    """titles read the keywords twice, so queries over many stages write them."""
    x = Library(spark, "/nowhere")
    x.shared = STAGES
    x._made["segments"] = spark.createDataFrame([("a", 0, 0.0, 5.0, "alpha alpha beta gamma")], "video_id string, segment_index int, start_seconds double, end_seconds double, text string")
    x._made["spans"] = spark.createDataFrame([("a", 0, 0)], "video_id string, segment_start_index int, topic_index int")
    assert "posexplode" not in plan(x.titles)
    assert [tuple(r) for r in x.titles.collect()] == [("a", 0, "Alpha alpha beta gamma")]
