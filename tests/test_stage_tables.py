"""Committed stage tables, recomputing what is stale, and the plans above stage tables."""

import pytest
from pyspark.sql import functions as F

from chalkline.operators import changes as chg
from chalkline.operators import lineage, pages
from chalkline.plans import recompute
from chalkline.plans.queries import SPARK
from chalkline.plans.library import Library
from chalkline.sources import artifacts, committed
from chalkline.sources.scratch import children, scratch_path

ROWS = "video_id string, n int"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_a_lecture_without_rows_reads_as_empty(spark, fmt):
    path = scratch_path(spark, "stage")
    df = lambda *r: spark.createDataFrame(list(r), ROWS)
    read = lambda: rows(artifacts.read_artifact(spark, path, df().schema, fmt))
    artifacts.write_artifact(df(("a", 1), ("a", 2), ("b", 1), ("c", 5)), path, fmt)
    artifacts.write_artifact(df(("b", 7)), path, fmt)
    assert read() == [("a", 1), ("a", 2), ("b", 7), ("c", 5)]
    artifacts.write_artifact(df(("c", 6)), path, fmt, df(("a", 0), ("c", 0)))
    assert read() == [("b", 7), ("c", 6)]
    assert {r.video_id: r.version for r in committed.manifest(spark, path).collect()} == {"a": 3, "b": 2, "c": 3}
    committed.compact(spark, path, df().schema, fmt)
    assert read() == [("b", 7), ("c", 6)] and len(children(spark, f"{path}/data")) == 1


def test_a_write_that_is_killed_changes_nothing(spark, monkeypatch):
    path = scratch_path(spark, "stage")
    df = spark.createDataFrame([("a", 1), ("b", 1)], ROWS)
    committed.commit(df, path)
    broken = df.withColumn("n", F.when(F.col("video_id") == "b", F.raise_error(F.lit("killed"))).otherwise(F.lit(9)).cast("int"))
    with pytest.raises(Exception, match="killed"):  # while the data are written
        committed.commit(broken, path)
    assert rows(committed.read_committed(spark, path, df.schema)) == [("a", 1), ("b", 1)]
    rename = committed.rename
    monkeypatch.setattr(committed, "rename", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):  # before the manifest is switched
        committed.commit(df.withColumn("n", F.lit(9)), path)
    monkeypatch.setattr(committed, "rename", rename)
    assert rows(committed.read_committed(spark, path, df.schema)) == [("a", 1), ("b", 1)]
    monkeypatch.setattr(committed, "manifest", lambda *_: committed_manifest)
    committed_manifest = spark.createDataFrame([], committed.MANIFEST)
    monkeypatch.setattr(committed, "last_version", lambda *_: 0)
    with pytest.raises(RuntimeError, match="another write"):  # two writers that began with the same manifest
        committed.commit(df, path)


CHANGES = "video_id string, previous_frame_index int, frame_index int, previous_timestamp_seconds double, timestamp_seconds double, kind string, change_score double, changed_pixel_ratio double"
STAGES = [
    recompute.Stage("states", ("changes",), lambda t: chg.stable_states(t["changes"]), chg.STATES),
    recompute.Stage("clusters", ("changes",), lambda t: chg.change_clusters(t["changes"]).select("video_id", "cluster_index", "start_seconds"), "video_id string, cluster_index int, start_seconds double"),
    recompute.Stage("summary", ("states", "clusters"), lambda t: t["states"].select("video_id").unionAll(t["clusters"].select("video_id")).groupBy("video_id").agg(F.count("*").alias("n")), "video_id string, n long"),
]


def test_only_stale_lectures_are_made_again(spark):
    def source(touched):
        out = []
        for v in range(20):
            kinds = ["NONE" if v in touched else "SCENE" if (i + v) % 9 == 0 else "LOCAL" if (i + v) % 9 < 3 else "NONE" for i in range(60)]
            out += [(str(v), i, i + 1, i * 0.4, (i + 1) * 0.4, k, 40.0, 0.3) for i, k in enumerate(kinds)]
        df = spark.createDataFrame(out, CHANGES)
        versions = [(str(v), "changes", 2 if v in touched else 1) for v in range(20)]
        return {"changes": df}, spark.createDataFrame(versions, "video_id string, input string, version int")

    path, plain = scratch_path(spark, "stages"), scratch_path(spark, "stages-at-once")
    first = recompute.refresh(spark, path, STAGES, *source(()))
    assert {n: c["lectures"] for n, c in first.items()} == {"states": 20, "clusters": 20, "summary": 20} and first["states"]["changes"] == 1_200
    assert recompute.refresh(spark, path, STAGES, *source(())) == {}
    again = recompute.refresh(spark, path, STAGES, *source((3, 11)))
    assert {n: c["lectures"] for n, c in again.items()} == {"states": 2, "clusters": 2, "summary": 2}
    assert again["states"]["changes"] == again["clusters"]["changes"] == 120 and again["summary"]["clusters"] == 0
    recompute.refresh(spark, plain, STAGES, *source((3, 11)))
    for s in STAGES:
        read = lambda p, s=s: rows(committed.read_committed(spark, f"{p}/{s.name}", recompute.schema_of(s.schema)))
        assert read(path) == read(plain)
    assert not any(r[0] in ("3", "11") for r in rows(committed.read_committed(spark, f"{path}/clusters", recompute.schema_of(STAGES[1].schema))))


def test_an_applied_order_makes_its_pages_stale(spark):
    shots = spark.createDataFrame([(v, i) for v in "abc" for i in range(3)], "video_id string, trusted_index int")
    order = lambda **o: spark.createDataFrame([(v, p, i) for v, ids in o.items() for p, i in enumerate(ids)], "video_id string, position int, trusted_index int")
    outcome = pages.apply_page_order(order(a=[0, 1, 2], b=[0, 1, 2], c=[0, 1, 2]), order(a=[2, 1, 0], b=[0, 1, 2], c=[0, 0, 1]), shots)
    assert {r.video_id: r.outcome for r in outcome.collect()} == {"a": "APPLIED", "b": "UNCHANGED", "c": "REJECTED"}
    edges = spark.createDataFrame([(s, i) for s, inputs in lineage.DAG.items() for i in inputs or ("raw",)], "stage string, input string")
    recorded = shots.select("video_id").distinct().crossJoin(edges).withColumn("recorded_version", F.lit(1))
    current = recorded.select("video_id", "input").distinct().join(outcome.select("video_id", "version_bump"), "video_id")
    current = current.select("video_id", "input", (1 + F.when(F.col("input") == "order", F.col("version_bump")).otherwise(0)).alias("version"))
    stale = lineage.stale_cascade(lineage.artifact_freshness(recorded, current)).where("status = 'STALE'")
    assert rows(stale.select("video_id", "stage")) == [("a", "pages")]


def test_no_exchange_by_lecture_above_stage_tables(spark):
    """Stage tables lie in buckets of the lecture."""
    import os

    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(sf):
        pytest.skip("needs the given tables")
    df = SPARK["library_rollup"](Library(spark, sf))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(video_id" not in plan and "Bucketed: true" in plan
