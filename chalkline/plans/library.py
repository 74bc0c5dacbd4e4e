"""The library's stage tables, bound to a folder of source tables.

Each method is one table; what a stage makes is made by its operators.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import wraps
from threading import Lock, RLock

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chalkline.functions import vectors as vx
from chalkline.operators import candidates as cand
from chalkline.operators import changes as chg
from chalkline.operators import coverage as cov
from chalkline.operators import ocr, speech
from chalkline.sources.scratch import bucketed

GRID = 8  # embeddings are read as GRID x GRID frames
EDGE = 0.1
TILES = 20  # lectures


def table(method):
    """Built once a library: a plan, or a written table if it is one of the ``shared`` ones.

    Several threads may ask for tables: the first builds one, the others wait for it.
    """

    @wraps(method)
    def get(self):
        name = method.__name__
        with self._guard:
            lock = self._locks.setdefault(name, RLock())
        with lock:
            if name not in self._made:
                made = method(self)
                self._made[name] = bucketed(made, name) if name in self.shared else made
            return self._made[name]

    return property(get)


#: Tables that two stages or more behind them read: queries over many stages write each once.
STAGES = frozenset(("lectures", "all_changes", "segments", "candidates", "reviewed", "trusted", "scores", "spans", "assigned", "keywords", "topics", "ocr", "resolved", "findings"))
#: The ends of the branches that don't read each other, longest first: built at the same time.
BRANCHES = ("topics", "resolved", "ocr", "lectures")


class Library:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}
        self._guard, self._locks = Lock(), {}
        self.shared: frozenset[str] = frozenset()  # tables to be written when they are first asked for

    def build(self, *names: str) -> None:
        """Write tables that several stages read, at the same time as far as they don't wait for one another."""
        with ThreadPoolExecutor(len(names)) as pool:
            list(pool.map(lambda name: getattr(self, name), names))

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @table
    def all_changes(self):
        micros = F.timestamp_diff("MICROSECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
        kind = F.when(F.col("event_type").isin("view", "signup"), "NONE").when(F.col("event_type") == "click", "LOCAL").when(F.col("event_type") == "purchase", "STRUCTURAL").otherwise("SCENE")
        order = Window.partitionBy("video_id").orderBy("ts", "event_id")
        rows = self.read("events").select(
            (F.col("user_id") % TILES).cast("string").alias("video_id"), "ts", "event_id", (F.floor(micros / 2000) / 1e6).alias("timestamp_seconds"), kind.alias("kind"), "value",
        )
        rows = rows.withColumn("frame_index", (F.row_number().over(order) - 1).cast("int"))
        rows = rows.withColumns({"previous_frame_index": F.lag("frame_index").over(order), "previous_timestamp_seconds": F.lag("timestamp_seconds").over(order)})
        quiet = F.col("kind") == "NONE"
        return rows.select(
            "video_id", "previous_frame_index", "frame_index", "previous_timestamp_seconds", "timestamp_seconds", "kind", F.when(quiet, 0.0).otherwise(F.least(F.lit(100.0), F.col("value") / 2)).alias("change_score"), (F.col("value") / 500).alias("changed_pixel_ratio"),
            (F.col("value") / 10).alias("mean_pixel_delta"), (F.col("value") / 1000).alias("edge_change_ratio"), F.least(F.lit(1.0), F.col("value") / 250).alias("change_bbox_area_ratio"),
        )

    @table
    def changes(self):
        return self.all_changes.where("previous_frame_index IS NOT NULL")

    @table
    def lectures(self):
        ids = [self.all_changes, self.segments, self.frames]
        return ids[0].select("video_id").union(ids[1].select("video_id")).union(ids[2].select("video_id")).distinct()

    @table
    def timeline(self):
        rows = self.all_changes.groupBy("video_id").agg(F.count("*").alias("frame_count"), F.max("timestamp_seconds").alias("duration_seconds"))
        return rows.withColumn("last_timestamp_seconds", F.col("duration_seconds"))

    @table
    def raw_segments(self):
        order = Window.partitionBy("video_id").orderBy("doc_id")
        slot = F.floor(F.col("doc_id") / 20)
        rows = self.read("documents").select(F.regexp_extract("source", r"(\d+)", 1).alias("video_id"), "doc_id", slot.alias("slot"), (F.coalesce("n_chars", F.lit(0).cast("long")) * 5).alias("ms"), (slot % 7 * 3000).alias("pause"), "text")
        rows = rows.withColumn("start_ms", F.coalesce(F.sum(F.col("ms") + F.col("pause")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")) + F.col("pause"))
        text = F.when(F.col("slot") % 5 == 0, F.concat(F.lit("Next, "), F.col("text"))).otherwise(F.col("text"))
        return rows.select("video_id", (F.row_number().over(order) - 1).cast("int").alias("raw_index"), (F.col("start_ms") / 1000).alias("start"), ((F.col("start_ms") + F.col("ms")) / 1000).alias("end"), text.alias("text"))

    @table
    def segments(self):
        return speech.clean_segments(self.raw_segments)

    @table
    def frames(self):
        """Screenshot frames: the vectors of embeddings."""
        index = F.floor(F.col("vec_id") / TILES).cast("int")
        return self.read("embeddings").select((F.col("vec_id") % TILES).cast("string").alias("video_id"), index.alias("candidate_index"), F.col("embedding").cast("array<double>").alias("thumb"), "label")

    @table
    def plain_candidates(self):
        i, label = F.col("candidate_index"), F.col("label")
        kinds, reasons = ("NONE", "LOCAL", "STRUCTURAL", "SCENE"), ("INITIAL_STABLE", "STABLE_AFTER_CHANGE", "STABLE_AFTER_CHANGE", "PRE_TRANSITION_PROTECTION", "END_OF_VIDEO_FALLBACK")
        name = lambda values: F.get(F.array(*map(F.lit, values)), (label % len(values)).cast("int"))
        edge, contrast = vx.share(vx.edges(F.col("thumb"), GRID, EDGE)), vx.contrast_std(F.col("thumb"), 1.0)
        return self.frames.select(
            "video_id", "candidate_index", (i * 10).alias("frame_index"), (i * 48 + 7).cast("double").alias("timestamp_seconds"), name(reasons).alias("reason"), name(kinds).alias("source_change_kind"), (label == 3).alias("protected"),
            (i % 4 != 1).alias("kept"), F.concat(F.lit("frame-"), i, F.lit(".png")).alias("image_filename"), F.round(edge * (1 + i % 3) / 3, 6).alias("edge_density"), F.round(contrast * (1 + i % 3) / 3, 6).alias("contrast_std"),
        )

    @table
    def candidates(self):
        return cand.content_loss(self.plain_candidates)

    @table
    def review(self):
        return cand.protect(self.candidates)

    @table
    def decision_events(self):
        index = F.floor(F.col("doc_id") / TILES).cast("int")
        off = (F.col("quality") == 0) | (index % 5 == 0)
        rows = self.read("labels").select((F.col("doc_id") % TILES).cast("string").alias("video_id"), index.alias("candidate_index"), F.when(off, F.lit(False)).when(F.col("toxic") == 1, F.lit(True)).alias("selected"), (index % 2 == 0).alias("force"), F.col("doc_id").alias("updated_at"))
        return rows.where(F.col("selected").isNotNull())

    @table
    def overrides(self):
        return cand.apply_decisions(self.review, self.decision_events)[0]

    @table
    def rejects(self):
        return cand.apply_decisions(self.review, self.decision_events)[1]

    @table
    def reviewed(self):
        return cand.merge_decisions(self.review, self.overrides)

    @table
    def trusted(self):
        return cand.trusted_set(self.reviewed)

    @table
    def states(self):
        return chg.clamp_states(chg.stable_states(self.changes), self.timeline)

    @table
    def durations(self):
        return self.segments.groupBy("video_id").agg(F.max("end_seconds").alias("duration"))

    @table
    def signals(self):
        return cand.section_signals(self.candidates)

    @table
    def near(self):
        return speech.near_visual_signal(self.segments, self.trusted, self.signals)

    @table
    def scores(self):
        return speech.boundary_scores(self.segments, self.near)

    @table
    def boundaries(self):
        first = self.segments.where("segment_index = 0").select("video_id", F.col("start_seconds").alias("first_start"))
        return speech.choose_boundaries(self.scores, first)

    @table
    def spans(self):
        return speech.topic_spans(self.segments, self.boundaries, self.trusted, self.durations)

    @table
    def assigned(self):
        return speech.assign_to_topics(self.trusted, self.spans)

    @table
    def keywords(self):
        return speech.topic_keywords(self.segments, self.spans)

    @table
    def titles(self):
        return speech.topic_titles(self.segments, self.spans, self.keywords)

    @table
    def topics(self):
        return speech.topic_stats(self.segments, self.spans, self.assigned)

    @table
    def alignment(self):
        return speech.align(self.trusted, self.segments)

    @table
    def ocr_words(self):
        rows = self.read("conversations").select((F.col("conv_id") % TILES).cast("string").alias("video_id"), F.floor(F.col("conv_id") / TILES).cast("int").alias("trusted_index"), "conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("line", "t"))
        rows = rows.select("video_id", "trusted_index", "conv_id", "turn", "line", F.posexplode(F.split("t", " ")).alias("word", "text")).where(F.btrim("text") != "")
        n, word, line, turn = F.length("text"), F.col("word"), F.col("line"), F.col("turn")
        conf = F.least(F.lit(100).cast("long"), (7 * n + 13 * word) % 101 - 1 + 15 * (F.col("conv_id") % 3)).cast("double")
        return rows.select(
            "video_id", "trusted_index", F.lit(1).alias("page"), turn.cast("int").alias("block"), F.lit(0).alias("par"), line.alias("line"), (turn * 1000000 + line * 10000 + word).alias("pos"),
            (10 * word).alias("left"), (20 * line + 400 * turn).cast("int").alias("top"), (6 * n).alias("width"), F.lit(12).alias("height"), conf.alias("conf"), "text",
        )

    @table
    def ocr(self):
        return ocr.pages_of_trusted(self.trusted, ocr.ocr_pages(self.ocr_words))

    @table
    def content(self):
        return ocr.enrich(self.ocr, self.alignment, self.assigned, self.titles)

    @table
    def resolved(self):
        return cov.resolve_states(self.states, self.reviewed, self.trusted)

    @table
    def lecture_durations(self):
        return cov.lecture_duration(self.spans, self.segments, self.trusted)  # topics end as their spans do

    def rule(self, number: int) -> DataFrame:
        """What one rule finds; tables that only others read are not made."""
        if number == 1:
            return cov.rule_uncaptured_change(self.changes, self.trusted, self.resolved)
        if number == 2:
            return cov.rule_protected_lost(self.candidates, self.trusted)
        if number == 3:
            return cov.rule_long_gap(self.trusted, self.lecture_durations, self.segments, self.changes, self.resolved)
        return cov.rule_topic_without_visual(self.topics) if number == 4 else cov.rule_ocr_uncertain(self.ocr, self.trusted)

    @table
    def rules(self):
        return [self.rule(number) for number in range(1, 6)]

    @table
    def findings(self):
        return cov.coverage_findings(self.rules)

    @table
    def summary(self):
        return cov.summary_coverage(self.lectures, self.findings)

    @table
    def orders(self):
        """Requested page orders: as it is, reversed, one index twice, one missing, by lecture."""
        n = F.count("*").over(Window.partitionBy("video_id"))
        i, kind = F.col("trusted_index"), F.col("video_id").cast("int") % 4
        rows = self.trusted.select("video_id", i, n.cast("int").alias("n"), kind.alias("kind"))
        asked = F.when(kind == 1, F.col("n") - 1 - i).when((kind == 2) & (i == 1), F.lit(0)).otherwise(i)
        return rows.where(~((F.col("kind") == 3) & (i == 0))).select("video_id", i.alias("position"), asked.cast("int").alias("trusted_index"))

    @table
    def raw_windows(self):
        return chg.coarse_windows(self.changes)

    @table
    def windows(self):
        """Activity windows over all changes, merged."""
        return chg.merge_windows(self.raw_windows, self.timeline.select("video_id", F.col("duration_seconds").alias("duration")))

    @table
    def scanned(self):
        """The changes that a scan of the windows alone sees, with quiet rows over the rest."""
        return chg.quiet_sentinels(self.windows, self.changes, self.timeline)

    @table
    def stage_inputs(self):
        """Recorded input versions of every lecture and stage: equal, older or none by a rule of both."""
        from chalkline.operators.lineage import DAG

        edges = [(s, i, p) for s, (stage, inputs) in enumerate(DAG.items()) for p in [stage] for i in inputs or ("raw",)]
        stages = self.spark.createDataFrame(edges, "number int, input string, stage string")
        v = F.col("video_id").cast("int")
        version = F.when((v + F.col("number")) % 7 == 3, None).when((v * 3 + F.col("number")) % 11 == 5, F.lit(0)).otherwise(1)
        return self.lectures.crossJoin(F.broadcast(stages)).select("video_id", "stage", "input", version.cast("int").alias("recorded_version"))

    @table
    def versions(self):
        return self.stage_inputs.select("video_id", "input").distinct().withColumn("version", F.lit(1))

    @table
    def shuffled_changes(self):
        """Changes with a swapped pair of rows in every third lecture and a wrong kind in every fifth."""
        v, i = F.col("video_id").cast("int"), F.col("frame_index")
        swap = F.when((v % 3 == 0) & (i == 10), 11).when((v % 3 == 0) & (i == 11), 10).otherwise(i)
        kind = F.when((v % 5 == 0) & (i % 50 == 7), "BLUR").otherwise(F.col("kind"))
        return self.changes.withColumns({"row_index": swap.cast("int"), "kind": kind})
