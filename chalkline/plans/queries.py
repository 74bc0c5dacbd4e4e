"""The registered queries: each operator over the library's tables, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.config import ChangeConfig
from chalkline.functions import frames
from chalkline.functions import text as tx
from chalkline.functions import vectors as vx
from chalkline.operators import candidates as cand
from chalkline.operators import catalog, coverage, lineage, ocr, pages, plugins, quality, speech
from chalkline.operators import changes as chg
from chalkline.operators import summaries as sm
from chalkline.plans import oracle as o
from chalkline.plans import recompute
from chalkline.plans.library import BRANCHES, EDGE, GRID, STAGES, TILES, Library
from chalkline.sources import artifacts
from chalkline.sources.scratch import scratch_path
from chalkline.streaming import states as stream

SPARK: dict[str, Callable[[Library], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, stages: bool = False, once: tuple[str, ...] = (), first: tuple[str, ...] = ()):
    """Register a function of the library under its name, with its SQL where there is one.

    ``stages``: it reads tables of many stages, each of which is written once, but
    for those it reads ``once`` only; ``first`` are built at the same time.
    """

    def add(f):
        def run(x):
            x.shared = STAGES.difference(once) if stages else x.shared
            if first:
                x.build(*first)
            return f(x)

        SPARK[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql if sql.startswith("WITH RECURSIVE") else o.with_tables(sql)
        return f

    return add


# Sources and sinks ---------------------------------------------------------------------------------------------------
@query("SELECT video_id, segment_index, start_seconds, end_seconds, text FROM segments")
def read_artifact(x):
    path = scratch_path(x.spark, "segments")
    artifacts.write_artifact(x.segments, path, "json")
    return artifacts.read_artifact(x.spark, path, x.segments.schema)


@query("SELECT video_id, count(*) AS segment_count FROM segments GROUP BY ALL")
def read_summary(x):
    path = scratch_path(x.spark, "summary")
    rows = x.segments.groupBy("video_id").agg(F.count("*").alias("segment_count"))
    text = rows.select(F.to_json(F.struct("video_id", "segment_count")).alias("value")).union(x.spark.sql("SELECT '{broken' AS value"))
    text.repartition(64, "value").write.option("maxRecordsPerFile", 1).text(path)
    return artifacts.read_summary(x.spark, path, rows.schema)


@query("SELECT video_id, trusted_index, block, line, pos, \"left\", top, width, height, conf, text FROM ocr_words WHERE NOT contains(text, chr(9))")
def read_ocr_words(x):
    path = scratch_path(x.spark, "words")
    words = x.ocr_words.where(~F.col("text").contains("\t"))
    columns = [F.lit(5).alias("level"), F.col("trusted_index").alias("page_num"), F.col("block").alias("block_num"), F.col("video_id").cast("int").alias("par_num"), F.col("line").alias("line_num"), F.col("pos").alias("word_num"), "left", "top", "width", "height", F.col("conf").cast("string").alias("conf"), "text"]
    bad = x.spark.sql("SELECT 5 AS level, 0 AS page_num, 0 AS block_num, 0 AS par_num, 0 AS line_num, 0L AS word_num, 0 AS `left`, 0 AS top, 1 AS width, 1 AS height, 'x' AS conf, 'word' AS text UNION ALL SELECT 5, 0, 0, 0, 0, 0L, 0, 0, 1, 1, '50', ' '")
    words.select(*columns).union(bad).write.option("sep", "\t").option("header", True).option("quote", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    rows = artifacts.read_ocr_words(x.spark, path)
    return rows.select(F.col("par_num").cast("string").alias("video_id"), F.col("page_num").alias("trusted_index"), F.col("block_num").alias("block"), F.col("line_num").alias("line"), F.col("word_num").cast("long").alias("pos"), "left", "top", "width", "height", "conf", "text")


def _image_folder(x):
    """One file for each trusted screenshot but every sixth candidate: a copy of its name.

    Each is a folder of its own, so they are dealt to many tasks, which also put
    what they wrote in place (version 2); the driver would do so one by one.
    """
    path = scratch_path(x.spark, "images")
    named = x.trusted.where("candidate_index % 6 <> 0").select(F.concat("video_id", F.lit("-"), "image_filename").alias("image_filename")).withColumn("value", F.col("image_filename"))
    dealt = named.repartition(int(x.spark.conf.get("spark.sql.shuffle.partitions")), "image_filename")
    dealt.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("image_filename").text(path)
    return path


@query("SELECT video_id, trusted_index, video_id || '-' || image_filename AS image_filename, candidate_index % 6 <> 0 AS present FROM trusted")
def read_image_assets(x):
    manifest = x.trusted.select("video_id", "trusted_index", F.concat("video_id", F.lit("-"), "image_filename").alias("image_filename"))
    return artifacts.read_image_assets(x.spark, _image_folder(x), manifest).select("video_id", "trusted_index", "image_filename", "present")


@query("SELECT video_id, segment_index, start_seconds, end_seconds, text FROM segments")
def write_artifact(x):
    path = scratch_path(x.spark, "segments")
    artifacts.write_artifact(x.segments.where("segment_index % 2 = 0"), path)
    artifacts.write_artifact(x.segments, path)  # replaces the first
    return artifacts.read_artifact(x.spark, path, x.segments.schema, "parquet")


# Projections and scalar functions ------------------------------------------------------------------------------------
RULES = catalog.HostRules(("example.com", "m.example.com", "spam-farm.example.com"), ("example.org", "spam-farm.example.org"), "^[A-Za-z0-9_.-]{2,11}$")


def _catalog_urls(x):
    """Page addresses without the names that vary before the domain."""
    return x.read("pages").select(F.regexp_replace("url", r"^(https?)://(?:www\.)?(?:blog\.|m\.)?[a-z]+\.example\.", "$1://example.").alias("url"))


@query(f"""WITH u AS (SELECT regexp_replace(url, '^(https?)://(?:www\\.)?(?:blog\\.|m\\.)?[a-z]+\\.example\\.', '\\1://example.') AS url FROM pages),
p AS (SELECT url, regexp_replace(lower(regexp_extract(url, '^[hH][tT][tT][pP][sS]?://([^/?#:]+)', 1)), '^www\\.', '') AS host, regexp_extract(url, '^[^:]+://[^/?#]*(/[^?#]*)', 1) AS path, regexp_extract(url, '[?&]v=([^&#]*)', 1) AS v FROM u),
i AS (SELECT url, CASE WHEN host IN ('example.org', 'spam-farm.example.org') THEN coalesce(string_split(path, '/')[2], '') WHEN host IN ('example.com', 'm.example.com', 'spam-farm.example.com') THEN CASE WHEN path = '/watch' THEN v ELSE coalesce(string_split(path, '/')[3], '') END ELSE '' END AS id FROM p)
SELECT DISTINCT CASE WHEN ok THEN id END AS video_id, CASE WHEN ok THEN 'https://example.com/watch?v=' || id ELSE url END AS normalized_url, ok AS accepted FROM (SELECT *, regexp_matches(id, '{RULES.id_pattern}') AS ok FROM i)""")
def normalize_source_catalog(x):
    return catalog.normalize_source_catalog(_catalog_urls(x), RULES)


def _catalog_raw(x):
    n, size = F.col("p_partkey"), F.col("p_size")
    return x.read("part").select(
        n.cast("string").alias("video_id"), F.when(size % 9 != 0, F.col("p_name")).alias("title"), F.when(size % 7 != 0, F.col("p_retailprice") * 7 + size / 2).alias("duration"), F.when(size % 10 == 0, "is_live").when(size % 10 == 1, "is_upcoming").otherwise("not_live").alias("live_status"),
        F.when(size % 3 != 0, (480 + size).cast("long")).alias("height"), F.array((size * 10).cast("long"), (n % 1000).cast("long")).alias("format_heights"), F.when(size % 4 != 0, F.col("p_brand")).alias("channel"), F.col("p_type").alias("uploader"),
    )


@query(f"""WITH r AS (SELECT p_partkey::VARCHAR AS video_id, CASE WHEN p_size % 9 <> 0 THEN p_name END AS title, CASE WHEN p_size % 7 <> 0 THEN p_retailprice * 7 + p_size::DOUBLE / 2 END AS duration, CASE WHEN p_size % 10 <= 1 THEN 'LIVE' WHEN p_size % 7 = 0 THEN 'NO_DURATION' END AS reject_reason,
 CASE WHEN p_size % 3 <> 0 THEN 480 + p_size ELSE greatest(p_size * 10, p_partkey % 1000) END AS height, CASE WHEN p_size % 4 <> 0 THEN p_brand ELSE p_type END AS channel FROM part)
SELECT video_id, coalesce(nullif(trim(title), ''), 'Untitled lecture') AS title, CASE WHEN reject_reason IS NULL THEN greatest(0, round_even(duration, 0)::BIGINT) END AS duration_seconds, CASE WHEN reject_reason IS NULL THEN {o.duration_text("duration")} END AS duration_formatted, channel, height || 'p' AS resolution, reject_reason FROM r""")
def normalize_catalog_metadata(x):
    return catalog.normalize_catalog_metadata(_catalog_raw(x))


@query("""SELECT p_partkey::VARCHAR AS video_id, r IS NULL AS accepted, r AS reject_reason FROM (SELECT *, CASE WHEN NOT (p_size <> 49 AND p_size <> 50 AND probed > 0) THEN 'NOT_A_VIDEO' WHEN NOT (expected <= 0 OR abs(probed - expected) <= greatest(3.0::DOUBLE, expected * 0.01::DOUBLE)) THEN 'DURATION_MISMATCH' END AS r
FROM (SELECT *, round(p_retailprice, 0) AS expected, round(p_retailprice, 0) + (p_size % 7 - 3) * 4 AS probed FROM part))""")
def verify_media(x):
    size, expected = F.col("p_size"), F.round("p_retailprice", 0)
    return catalog.verify_media(x.read("part").select(F.col("p_partkey").cast("string").alias("video_id"), expected.alias("expected"), (expected + (size % 7 - 3) * 4).alias("probed"), (size != 49).alias("has_video"), F.when(size == 50, 0).otherwise(1280).alias("width"), F.lit(720).alias("height")))


@query("""SELECT video_id, frame_count, fps, 1280 AS width, 720 AS height, round(d, 6) AS duration_seconds, 0.0::DOUBLE AS first_timestamp_seconds, round(least(d, greatest(0.0::DOUBLE, (frame_count - 1) / fps)), 6) AS last_timestamp_seconds FROM (
SELECT video_id, fps, coalesce(n, greatest(1, round_even(duration * fps, 0)::BIGINT)) AS frame_count, coalesce(duration, coalesce(n, 1) / fps) AS d FROM (SELECT p_partkey::VARCHAR AS video_id, (p_size % 30)::DOUBLE AS fps, CASE WHEN p_size % 5 <> 0 THEN (p_partkey * 37 % 9000) END AS n0, nullif(n0, 0) AS n, CASE WHEN p_size % 6 <> 0 THEN p_retailprice / 10 END AS duration FROM part) WHERE fps > 0 AND (n IS NOT NULL OR duration IS NOT NULL))""")
def timeline_metadata(x):
    size = F.col("p_size")
    probes = x.read("part").select(F.col("p_partkey").cast("string").alias("video_id"), (size % 30).cast("double").alias("fps"), F.when(size % 5 != 0, F.col("p_partkey") * 37 % 9000).alias("frame_count"), F.lit(1280).alias("width"), F.lit(720).alias("height"), F.when(size % 6 != 0, F.col("p_retailprice") / 10).alias("duration"))
    return catalog.timeline_metadata(probes)


@query("""SELECT video_id, frame_index, CASE WHEN mean_pixel_delta <= 1.2::DOUBLE AND changed_pixel_ratio <= 0.002::DOUBLE AND edge_change_ratio <= 0.0015::DOUBLE THEN 'NONE' WHEN changed_pixel_ratio >= 0.40::DOUBLE OR mean_pixel_delta >= 32 THEN 'SCENE' WHEN changed_pixel_ratio <= 0.06::DOUBLE AND change_bbox_area_ratio <= 0.30::DOUBLE AND mean_pixel_delta <= 10 THEN 'LOCAL' ELSE 'STRUCTURAL' END AS kind FROM changes""")
def change_classify(x):
    return x.changes.select("video_id", "frame_index", chg.change_kind(*map(F.col, ("mean_pixel_delta", "changed_pixel_ratio", "edge_change_ratio", "change_bbox_area_ratio"))).alias("kind"))


@query("""SELECT video_id, frame_index, floor((100.0::DOUBLE * (0.35::DOUBLE * least(1.0::DOUBLE, mean_pixel_delta / 40) + 0.45::DOUBLE * least(1.0::DOUBLE, changed_pixel_ratio / 0.35::DOUBLE) + 0.20::DOUBLE * least(1.0::DOUBLE, edge_change_ratio / 0.20::DOUBLE))) * 10000 + 0.5::DOUBLE) / 10000 AS change_score FROM changes""")
def change_score(x):
    return x.changes.select("video_id", "frame_index", chg.change_score(*map(F.col, ("mean_pixel_delta", "changed_pixel_ratio", "edge_change_ratio"))).alias("change_score"))


@query("SELECT video_id, frame_index, kind = 'SCENE' OR changed_pixel_ratio >= 0.12::DOUBLE OR change_score >= 35 AS strong FROM changes")
def strong_transition(x):
    return x.changes.select("video_id", "frame_index", chg.is_strong().alias("strong"))


@query("SELECT video_id, segment_index, generate_subscripts(tokens, 1)::INTEGER AS pos, unnest(tokens) AS token FROM tokenized")
def tokenize_speech(x):
    return x.segments.select("video_id", "segment_index", F.posexplode(tx.speech_tokens(F.col("text"))).alias("pos", "token")).withColumn("pos", F.col("pos") + 1)


@query(f"SELECT video_id, trusted_index, generate_subscripts(t, 1)::INTEGER AS pos, unnest(t) AS token FROM (SELECT video_id, trusted_index, {o.visible_tokens('text')} AS t FROM ocr)")
def tokenize_visible(x):
    return x.ocr.select("video_id", "trusted_index", F.posexplode(tx.visible_tokens(F.col("text"))).alias("pos", "token")).withColumn("pos", F.col("pos") + 1)


@query("SELECT video_id, segment_index, cue FROM tokenized")
def transition_cue(x):
    return x.segments.select("video_id", "segment_index", tx.is_cue(F.col("text")).alias("cue"))


@query(f"SELECT video_id, segment_index, {o.clean('text')} AS clean_text FROM segments")
def strip_cue(x):
    return x.segments.select("video_id", "segment_index", tx.strip_cue(F.col("text")).alias("clean_text"))


@query(f"SELECT video_id, segment_index, round({o.jaccard('a', 'b')}, 6) AS similarity FROM (SELECT video_id, segment_index, list_distinct(tokens) AS a, list_distinct(lead(tokens) OVER (PARTITION BY video_id ORDER BY segment_index)) AS b FROM tokenized) WHERE b IS NOT NULL")
def jaccard(x):
    rows = x.segments.select("video_id", "segment_index", tx.speech_tokens(F.col("text")).alias("a")).withColumn("b", F.lead("a").over(speech.in_order())).where(F.col("b").isNotNull())
    return rows.select("video_id", "segment_index", F.round(tx.jaccard(F.col("a"), F.col("b")), 6).alias("similarity"))


@query(f"SELECT video_id, segment_index, {o.word_count('text')} AS word_count FROM segments")
def word_count(x):
    return x.segments.select("video_id", "segment_index", tx.word_count(F.col("text")).cast("long").alias("word_count"))


@query(f"SELECT video_id, segment_index, {o.duration_text('end_seconds - 60')} AS text FROM segments")
def format_duration(x):
    return x.segments.select("video_id", "segment_index", tx.duration_text(F.col("end_seconds") - 60).alias("text"))


@query("SELECT * FROM segments")
def clean_segments(x):
    return x.segments


@query("SELECT video_id, candidate_index, auto_protected, default_selected FROM review")
def auto_protect_flags(x):
    return x.review.select("video_id", "candidate_index", "auto_protected", "default_selected")


@query("SELECT video_id, checkpoint_index, protected_before_transition OR reason IN ('PRE_TRANSITION_PROTECTION', 'END_OF_VIDEO_FALLBACK', 'SINGLE_FRAME') AS protected FROM states")
def candidate_protected(x):
    return x.states.select("video_id", "checkpoint_index", cand.candidate_protected(F.col("protected_before_transition"), F.col("reason")).alias("protected"))


@query("SELECT * FROM signals")
def section_signal_candidates(x):
    return x.signals


@query("SELECT video_id, trusted_index, has_text, low_confidence FROM ocr")
def ocr_flags(x):
    return x.ocr.select("video_id", "trusted_index", "has_text", "low_confidence")


@query("SELECT o.video_id, o.trusted_index, concat_ws(chr(10) || chr(10), nullif(o.text, ''), nullif(s.text, '')) AS combined_context FROM ocr o JOIN alignment s USING (video_id, trusted_index)")
def combined_context(x):
    return x.ocr.join(x.alignment.select("video_id", "trusted_index", F.col("text").alias("said")), ["video_id", "trusted_index"]).select("video_id", "trusted_index", ocr.combined_context(F.col("text"), F.col("said")).alias("combined_context"))


@query("SELECT video_id, ready_for_pdf, pdf_status FROM summary", stages=True, once=("findings",), first=BRANCHES)
def gate_status(x):
    return x.summary.select("video_id", "ready_for_pdf", "pdf_status")


# Vectors -------------------------------------------------------------------------------------------------------------
@query("""SELECT video_id, window_index, i::INTEGER AS sample_index, greatest(0, round_even((start_seconds + i / 4.0::DOUBLE) * 10.0::DOUBLE, 0)::BIGINT) AS frame_index, round(start_seconds + i / 4.0::DOUBLE, 6) AS timestamp_seconds
FROM (SELECT video_id, window_index, start_seconds, unnest(range(0, greatest(0, floor((end_seconds - start_seconds) * 4.0::DOUBLE)::INTEGER) + 1)) AS i FROM merged_windows)""")
def sample_grid(x):
    return catalog.sample_grid(x.windows, 4.0, 10.0)


def _pairs(x):
    rows = x.frames.select("video_id", "candidate_index", "thumb").withColumn("before", F.lag("thumb").over(cand.in_order()))
    return rows.where(F.col("before").isNotNull())


PAIRS = "(SELECT video_id, candidate_index, thumb AS b, lag(thumb) OVER (PARTITION BY video_id ORDER BY candidate_index) AS a FROM frames)"
EDGES = "list_transform(range(1, 65), lambda i: i % 8 <> 0 AND abs({v}[i + 1] - {v}[i]) > 0.1)"


PAIR_METRICS = f"""SELECT video_id, candidate_index, round(list_sum(list_transform(range(1, 65), lambda i: abs(b[i] - a[i]))) / 64, 6) AS mean_pixel_delta, len(c)::DOUBLE / 64 AS changed_pixel_ratio,
 len(list_filter(range(1, 65), lambda i: ea[i] <> eb[i]))::DOUBLE / 64 AS edge_change_ratio,
 CASE WHEN len(c) = 0 THEN 0.0::DOUBLE ELSE (list_max(list_transform(c, lambda i: i // 8)) - list_min(list_transform(c, lambda i: i // 8)) + 1) * (list_max(list_transform(c, lambda i: i % 8)) - list_min(list_transform(c, lambda i: i % 8)) + 1)::DOUBLE / 64 END AS change_bbox_area_ratio
FROM (SELECT *, list_filter(range(0, 64), lambda i: abs(b[i + 1] - a[i + 1]) >= 0.3) AS c, {EDGES.format(v='a')} AS ea, {EDGES.format(v='b')} AS eb FROM {PAIRS} WHERE a IS NOT NULL)"""


@query(PAIR_METRICS)
def pair_metrics(x):
    e = lambda v: vx.edges(F.col(v), GRID, EDGE)
    rows = _pairs(x).withColumns({"changed": F.zip_with("before", "thumb", lambda a, b: F.abs(b - a) >= 0.3), "moved": F.zip_with(e("before"), e("thumb"), lambda a, b: a != b)})
    return rows.select("video_id", "candidate_index", F.round(vx.mean_abs_difference(F.col("before"), F.col("thumb")), 6).alias("mean_pixel_delta"), vx.share(F.col("changed")).alias("changed_pixel_ratio"), vx.share(F.col("moved")).alias("edge_change_ratio"), vx.bbox_share(F.col("changed"), GRID).alias("change_bbox_area_ratio"))


@query(PAIR_METRICS)
def pair_metrics_in_batches(x):
    """The same by Arrow batches, for frames too long for column functions."""
    return frames.pair_metrics(_pairs(x), "before", "thumb", GRID, EDGE, 0.3).select("video_id", "candidate_index", *(F.round(m, 6).alias(m) if m == "mean_pixel_delta" else m for m in frames.METRICS))


def _hashes(x):
    return x.frames.select("video_id", "candidate_index", "thumb", (F.col("label") == 3).alias("protected"), vx.dhash(F.col("thumb"), GRID, GRID).alias("dhash"))


@query("SELECT video_id, candidate_index, dhash FROM hashes")
def dhash(x):
    return _hashes(x).select("video_id", "candidate_index", "dhash")


@query("SELECT video_id, candidate_index, bit_count(xor(dhash, before))::INTEGER AS distance FROM (SELECT *, lag(dhash) OVER (PARTITION BY video_id ORDER BY candidate_index) AS before FROM hashes) WHERE before IS NOT NULL")
def hamming_distance(x):
    rows = _hashes(x).withColumn("before", F.lag("dhash").over(cand.in_order())).where(F.col("before").isNotNull())
    return rows.select("video_id", "candidate_index", vx.hamming(F.col("dhash"), F.col("before")).alias("distance"))


@query(f"SELECT video_id, candidate_index, round(list_sum(list_transform(range(1, 65), lambda i: abs(b[i] - a[i]))) / 64, 6) AS difference FROM {PAIRS} WHERE a IS NOT NULL")
def mean_abs_difference(x):
    return _pairs(x).select("video_id", "candidate_index", F.round(vx.mean_abs_difference(F.col("before"), F.col("thumb")), 6).alias("difference"))


@query("SELECT video_id, candidate_index, edge_density, contrast_std FROM plain_candidates")
def detail_metrics(x):
    return x.plain_candidates.select("video_id", "candidate_index", "edge_density", "contrast_std")


# Joins ---------------------------------------------------------------------------------------------------------------
@query("SELECT video_id, trusted_index, candidate_index, context_start_seconds, context_end_seconds, array_to_string(segment_indexes, ',') AS segment_indexes, text FROM alignment")
def align_speech(x):
    return x.alignment.select("video_id", "trusted_index", "candidate_index", "context_start_seconds", "context_end_seconds", tx.joined(F.col("segment_indexes").cast("array<string>")).alias("segment_indexes"), "text")


@query("SELECT * FROM near")
def near_visual_signal(x):
    return x.near


@query("SELECT * FROM assigned", stages=True, once=("assigned", "spans"))
def assign_to_topics(x):
    return x.assigned


@query("SELECT * EXCLUDE (coverage_flags), array_to_string(coverage_flags, ',') AS coverage_flags FROM content", stages=True, first=("assigned", "ocr"))
def enrich_content(x):
    return x.content.withColumn("coverage_flags", tx.joined(F.col("coverage_flags")))


@query("SELECT video_id, candidate_index, manual_decision, selected FROM reviewed")
def merge_decisions(x):
    return x.reviewed.select("video_id", "candidate_index", "manual_decision", "selected")


@query("SELECT * FROM lost")
def protected_not_trusted(x):
    return coverage.protected_not_trusted(x.candidates, x.trusted).select("video_id", "candidate_index", "timestamp_seconds")


@query("SELECT video_id, cluster_index, floor(distance * 1000000 + 0.5::DOUBLE) / 1000000 AS distance, coalesce(distance <= 8, false) AS captured FROM distances")
def nearest_trusted_distance(x):
    rows = coverage.nearest_distance(chg.change_clusters(x.changes), x.trusted)
    return rows.select("video_id", "cluster_index", (F.floor(F.col("distance") * 1000000 + 0.5) / 1000000).alias("distance"), F.coalesce(F.col("distance") <= 8, F.lit(False)).alias("captured"))


@query("SELECT * FROM resolved")
def resolve_states(x):
    return x.resolved


@query("SELECT video_id, cluster_index, state_count, unresolved_count, state_times, unresolved_times FROM states_near", stages=True)
def states_near_cluster(x):
    return coverage.states_near(chg.change_clusters(x.changes), x.resolved).select("video_id", "cluster_index", "state_count", "unresolved_count", "state_times", "unresolved_times")


def _gaps(x):
    return coverage.trusted_gaps(x.trusted, x.lecture_durations)


@query('SELECT video_id, "left", "right", segment_count, word_count FROM gap_evidence', stages=True, once=("spans",))
def gap_speech_overlap(x):
    return coverage.gap_speech(_gaps(x), x.segments).select("video_id", "left", "right", "segment_count", F.col("word_count").cast("long").alias("word_count"))


@query('SELECT video_id, "left", "right", change_count FROM gap_evidence', stages=True, once=("spans", "all_changes"))
def gap_visual_activity(x):
    return coverage.gap_changes(_gaps(x), x.changes).select("video_id", "left", "right", "change_count")


@query('SELECT video_id, "left", "right", state_count, unresolved_count FROM gap_evidence', stages=True, once=("spans", "resolved"))
def gap_states(x):
    return coverage.gap_states(_gaps(x), x.resolved).select("video_id", "left", "right", "state_count", "unresolved_count")


@query("SELECT c.video_id, c.frame_index, c.timestamp_seconds, w.window_index FROM all_changes c JOIN merged_windows w ON w.video_id = c.video_id AND c.timestamp_seconds BETWEEN w.start_seconds AND w.end_seconds")
def fine_scan_filter(x):
    return catalog.fine_scan_filter(x.all_changes, x.windows)


@query("SELECT * FROM warnings")
def ocr_warning_lookup(x):
    return coverage.ocr_warnings(x.ocr, x.trusted)


@query("SELECT o.video_id, o.trusted_index + 3 AS trusted_index, o.has_text, o.mean_confidence, o.word_count, 'NO_SUCH_SCREENSHOT' AS reject_reason FROM ocr o WHERE (NOT o.has_text OR o.low_confidence) AND NOT EXISTS (FROM trusted t WHERE t.video_id = o.video_id AND t.trusted_index = o.trusted_index + 3)")
def ocr_rejects(x):
    """With indexes three too high: the last three screenshots' rows are out of range."""
    return coverage.ocr_rejects(x.ocr.withColumn("trusted_index", F.col("trusted_index") + 3), x.trusted)


@query("SELECT * FROM items", stages=True)
def page_items(x):
    return pages.page_items(pages.default_page_order(x.assigned), x.trusted, x.assigned, x.titles)


# Windows and folds ---------------------------------------------------------------------------------------------------
@query("SELECT * FROM clusters")
def strong_change_clusters(x):
    return chg.change_clusters(x.changes)


@query("""SELECT video_id, window_index, start_seconds, end_seconds, peak_score, scene_change, structural_change, coarse_sample_count, array_to_string(list_filter(all_reasons, lambda r, i: list_position(all_reasons, r) = i), ',') AS reasons FROM merged_windows""")
def merge_activity_windows(x):
    return x.windows.withColumn("reasons", tx.joined(F.col("reasons")))


@query("SELECT video_id, candidate_index, content_loss_risk, content_loss_reason FROM candidates")
def content_loss_risk(x):
    return x.candidates.select("video_id", "candidate_index", "content_loss_risk", "content_loss_reason")


@query("SELECT video_id, segment_index, timestamp_seconds, score, array_to_string(reasons, ',') AS reasons FROM scores")
def boundary_scores(x):
    return x.scores.withColumn("reasons", tx.joined(F.col("reasons")))


@query("SELECT video_id, topic_index, segment_start_index, segment_end_index, start_seconds, end_seconds, is_last, array_to_string(boundary_reasons, ',') AS boundary_reasons FROM spans", stages=True, once=("spans",))
def topic_spans(x):
    return x.spans.withColumn("boundary_reasons", tx.joined(F.col("boundary_reasons")))


@query('SELECT * FROM gaps', stages=True, once=("spans",))
def trusted_gaps(x):
    return _gaps(x)


@query("""SELECT video_id, checkpoint_index, coalesce(max(change_score) FILTER (kind <> 'NONE'), 0.0::DOUBLE) AS max_score, count(*) FILTER (kind <> 'NONE') AS change_count FROM (
SELECT c.video_id, c.kind, c.change_score, (SELECT min(s.checkpoint_index) FROM states s WHERE s.video_id = c.video_id AND s.frame_index >= c.frame_index) AS checkpoint_index FROM changes c) WHERE checkpoint_index IS NOT NULL GROUP BY ALL""")
def state_span_metrics(x):
    return chg.span_metrics(x.changes, x.states)


@query("SELECT * FROM page_plan", stages=True)
def page_plan(x):
    return pages.page_plan(page_items(x))


@query("SELECT video_id, candidate_index, trusted_index FROM trusted")
def dense_reindex(x):
    return x.trusted.select("video_id", "candidate_index", "trusted_index")


# Limits for frames of values around 0 with a spread of about an eighth.
FRAMES = ChangeConfig(pixel_delta=0.45)
FRAME_EDGE = 0.6


@query(o.anchored_windows(FRAMES, FRAME_EDGE, 100.0))
def coarse_activity_windows(x):
    """Over frames, 48 seconds apart: a window stays open over two of them without activity."""
    at = (F.col("candidate_index") * 48 + 7).cast("double")
    frames = x.frames.select("video_id", F.col("candidate_index").alias("frame_index"), at.alias("timestamp_seconds"), "thumb")
    return chg.anchored_windows(frames, GRID, FRAME_EDGE, FRAMES, 100.0)


@query("SELECT * FROM raw_windows")
def pair_activity_windows(x):
    """Over classified pairs, without an anchor."""
    return x.raw_windows


@query(stages=True, once=tuple(STAGES - {"all_changes"}))
def quiet_sentinels(x):
    return x.scanned


@query(stages=True, once=tuple(STAGES - {"all_changes"}))
def scanned_states(x):
    """Stable states as a scan finds them: of the changes within windows and the quiet rows between."""
    return chg.stable_states(x.scanned)


@query("SELECT * FROM stable")
def stable_states(x):
    return chg.stable_states(x.changes)


@query("SELECT * FROM states")
def state_clamp(x):
    return x.states


@query("SELECT video_id, candidate_index, m.kept AS kept, m.of AS duplicate_of_candidate_index, m.bits AS duplicate_hash_distance, m.diff AS duplicate_mean_abs_difference FROM suppressed WHERE m IS NOT NULL")
def suppress_near_duplicates(x):
    return cand.suppress_near_duplicates(_hashes(x), cand.CandidateConfig(max_hash_distance=22, max_mean_abs_difference=0.14))


@query("SELECT video_id, segment_index, timestamp_seconds, score, array_to_string(reasons, ',') AS reasons FROM boundaries")
def choose_boundaries(x):
    return x.boundaries.withColumn("reasons", tx.joined(F.col("reasons")))


@query("""SELECT g.video_id, g.topic_index, g.start_seconds, g.screenshot_count, coalesce(lead(g.start_seconds) OVER (PARTITION BY g.video_id ORDER BY g.topic_index), greatest(g.start_seconds, d.duration)) AS end_seconds
FROM (SELECT video_id, topic AS topic_index, min(t) AS start_seconds, count(*) AS screenshot_count FROM visual_groups GROUP BY ALL) g JOIN lecture_durations d USING (video_id)""")
def visual_only_topics(x):
    return speech.visual_only_topics(x.trusted, x.lecture_durations)


@query("SELECT video_id, i AS frame_index, last AS timestamp_seconds FROM repaired WHERE i >= 0")
def repair_timestamps(x):
    raw = F.when(F.col("frame_index") % 5 == 0, 0.0).when(F.col("frame_index") % 7 == 0, F.col("timestamp_seconds") - 9).otherwise(F.col("timestamp_seconds"))
    return chg.repair_timestamps(x.all_changes.select("video_id", "frame_index", raw.alias("raw"), F.lit(0.4).alias("fps")))


# Aggregates and summaries --------------------------------------------------------------------------------------------
@query("SELECT * FROM ocr_lines")
def ocr_lines(x):
    return ocr.ocr_lines(x.ocr_words)


@query("SELECT * FROM ocr_pages")
def ocr_pages(x):
    return ocr.ocr_pages(x.ocr_words)


@query("SELECT * FROM keywords", stages=True, once=("spans", "keywords"))
def topic_keywords(x):
    return x.keywords


@query("SELECT * FROM visual_keywords", stages=True, first=("assigned", "ocr"))
def visual_keywords(x):
    return ocr.visual_keywords(x.content)


@query("""SELECT t.*, coalesce(k.l, '') AS visual_keywords FROM (SELECT video_id, topic_index, count(*) AS screenshot_count, count(*) FILTER (trim(visible_text) <> '') AS screenshots_with_ocr_text, sum(ocr_word_count)::BIGINT AS ocr_word_count FROM content GROUP BY ALL) t
LEFT JOIN (SELECT video_id, topic_index, string_agg(token, ',' ORDER BY rank) AS l FROM visual_keywords GROUP BY ALL) k USING (video_id, topic_index)""", stages=True, first=("assigned", "ocr"))
def topic_content(x):
    return ocr.topic_content(x.content)


@query("SELECT * FROM titles", stages=True)
def topic_titles(x):
    return x.titles


@query("SELECT * EXCLUDE (trusted_screenshot_indexes), array_to_string(trusted_screenshot_indexes, ',') AS trusted_screenshot_indexes FROM topics", stages=True, once=("topics",))
def topic_stats(x):
    return x.topics.withColumn("trusted_screenshot_indexes", tx.joined(F.col("trusted_screenshot_indexes").cast("array<string>")))


@query("""SELECT l.video_id, count(c.video_id) AS pair_count, count(*) FILTER (kind = 'NONE') AS none_count, count(*) FILTER (kind = 'LOCAL') AS local_count, count(*) FILTER (kind = 'STRUCTURAL') AS structural_count, count(*) FILTER (kind = 'SCENE') AS scene_count,
CASE WHEN count(c.video_id) > 0 THEN round(sum(change_score) / count(c.video_id), 4) ELSE 0.0::DOUBLE END AS mean_score, coalesce(max(change_score), 0.0::DOUBLE) AS max_score, arg_min(frame_index, (-change_score, frame_index)) AS max_score_frame FROM lectures l LEFT JOIN changes c USING (video_id) GROUP BY l.video_id""")
def summary_changes(x):
    return sm.summary_changes(x.lectures, x.changes)


@query("""SELECT video_id, coarse_samples, fine_samples, coarse_samples + fine_samples AS analysed_samples, a AS activity_seconds, round(greatest(0.0::DOUBLE, duration_seconds - a), 4) AS static_seconds_skipped, round(greatest(0.0::DOUBLE, 100 * (1 - (coarse_samples + fine_samples)::DOUBLE / frame_count)), 4) AS estimated_frame_reduction_percent, round((coarse_samples + fine_samples) / duration_seconds, 4) AS effective_fps FROM (
SELECT t.*, (SELECT count(*) FROM all_changes c WHERE c.video_id = t.video_id AND c.frame_index % 4 = 0) AS coarse_samples, (SELECT count(*) FROM all_changes c JOIN merged_windows w ON w.video_id = c.video_id AND c.timestamp_seconds BETWEEN w.start_seconds AND w.end_seconds WHERE c.video_id = t.video_id) AS fine_samples,
round(coalesce((SELECT sum(end_seconds - start_seconds) FROM merged_windows w WHERE w.video_id = t.video_id), 0.0::DOUBLE), 4) AS a FROM timeline t)""")
def adaptive_savings(x):
    return sm.adaptive_savings(x.timeline, x.windows, x.all_changes.where("frame_index % 4 = 0"), fine_scan_filter(x))


@query("""SELECT l.video_id, count(s.video_id) AS checkpoint_count, count(*) FILTER (reason = 'INITIAL_STABLE') AS initial_count, count(*) FILTER (reason = 'STABLE_AFTER_CHANGE') AS stable_count, count(*) FILTER (reason = 'PRE_TRANSITION_PROTECTION') AS protection_count, count(*) FILTER (reason = 'END_OF_VIDEO_FALLBACK') AS fallback_count, count(*) FILTER (reason = 'SINGLE_FRAME') AS single_count, min(timestamp_seconds) AS first_seconds, max(timestamp_seconds) AS last_seconds FROM lectures l LEFT JOIN states s USING (video_id) GROUP BY l.video_id""")
def summary_states(x):
    return sm.summary_states(x.lectures, x.states)


@query("SELECT l.video_id, count(c.video_id) AS checkpoint_count, count(*) FILTER (kept) AS kept_count, count(*) FILTER (NOT kept) AS duplicate_count, count(*) FILTER (protected AND kept) AS protected_kept_count, count(*) FILTER (content_loss_risk) AS risk_count FROM lectures l LEFT JOIN candidates c USING (video_id) GROUP BY l.video_id")
def summary_candidates(x):
    return sm.summary_candidates(x.lectures, x.candidates)


@query("SELECT l.video_id, count(*) FILTER (selected) AS selected_count, count(*) FILTER (selected AND manual_decision) AS manual_keep_count, count(*) FILTER (NOT manual_decision) AS manual_suppress_count, count(*) FILTER (selected AND auto_protected) AS auto_protected_count, count(*) FILTER (selected AND NOT kept) AS restored_count FROM lectures l LEFT JOIN reviewed r USING (video_id) GROUP BY l.video_id")
def summary_trusted(x):
    return sm.summary_trusted(x.lectures, x.reviewed)


@query(f"SELECT l.video_id, count(s.video_id) AS segment_count, coalesce(sum({o.word_count('s.text')}), 0)::BIGINT AS word_count, coalesce(nullif(max(s.end_seconds), 0.0::DOUBLE), 1.0::DOUBLE) AS duration_seconds FROM lectures l LEFT JOIN segments s USING (video_id) GROUP BY l.video_id")
def summary_transcript(x):
    return sm.summary_transcript(x.lectures, x.segments, x.durations).withColumn("word_count", F.col("word_count").cast("long"))


@query("SELECT *, trusted_count - aligned_count AS unaligned_count, CASE WHEN trusted_count > 0 THEN floor(100.0::DOUBLE * aligned_count / trusted_count + 0.5::DOUBLE)::BIGINT ELSE 0 END AS aligned_percent FROM (SELECT l.video_id, count(a.video_id) AS trusted_count, count(*) FILTER (len(segment_indexes) > 0) AS aligned_count FROM lectures l LEFT JOIN alignment a USING (video_id) GROUP BY l.video_id)")
def summary_alignment(x):
    return sm.summary_alignment(x.lectures, x.alignment)


@query("""SELECT video_id, (SELECT count(*) FROM topics t WHERE t.video_id = l.video_id) AS topic_count, (SELECT count(*) FROM segments t WHERE t.video_id = l.video_id) AS segment_count, (SELECT count(DISTINCT trusted_index) FROM assigned t WHERE t.video_id = l.video_id) AS assigned_count, (SELECT count(*) FROM scores t WHERE t.video_id = l.video_id AND score >= 0.9::DOUBLE) AS candidate_boundary_count,
(SELECT count(*) FROM boundaries t WHERE t.video_id = l.video_id) AS accepted_boundary_count, (SELECT count(*) FROM trusted t WHERE t.video_id = l.video_id) - (SELECT count(DISTINCT trusted_index) FROM assigned t WHERE t.video_id = l.video_id) AS unassigned_count FROM lectures l""", stages=True)
def summary_topics(x):
    return sm.summary_topics(x.lectures, x.topics, x.segments, x.trusted, x.assigned, x.scores, x.boundaries, 0.9)


@query("""SELECT *, CASE WHEN processed_count > 0 THEN floor(100.0::DOUBLE * text_count / processed_count + 0.5::DOUBLE)::BIGINT ELSE 0 END AS text_percent FROM (SELECT l.video_id, count(c.video_id) AS processed_count, count(*) FILTER (has_text) AS text_count, count(*) FILTER (NOT has_text) AS empty_count, count(*) FILTER (low_confidence) AS low_confidence_count, coalesce(sum(word_count), 0)::BIGINT AS word_count, round(coalesce(avg(mean_confidence) FILTER (has_text), 0.0::DOUBLE), 3) AS mean_confidence FROM lectures l LEFT JOIN ocr c USING (video_id) GROUP BY l.video_id)""")
def summary_ocr(x):
    return sm.summary_ocr(x.lectures, x.ocr)


@query("SELECT l.video_id, count(DISTINCT c.topic_index) AS topic_count, count(c.video_id) AS enriched_count, count(c.video_id) = (SELECT count(*) FROM trusted t WHERE t.video_id = l.video_id) AS coverage_complete FROM lectures l LEFT JOIN content c USING (video_id) GROUP BY l.video_id", stages=True, first=("assigned", "ocr"))
def summary_content(x):
    return sm.summary_content(x.lectures, x.content, x.trusted)


@query("SELECT * FROM summary", stages=True, once=("findings",), first=BRANCHES)
def summary_coverage(x):
    return x.summary


@query("SELECT l.video_id, count(p.video_id) AS page_count, count(*) FILTER (page_kind = 'SCREENSHOT') AS screenshot_count, count(DISTINCT topic_index) AS topic_count FROM lectures l LEFT JOIN page_plan p USING (video_id) GROUP BY l.video_id", stages=True)
def summary_pages(x):
    return sm.summary_pages(x.lectures, page_plan(x))


@query("SELECT pdf_status, severity, count(DISTINCT s.video_id) AS lectures, count(finding_index) AS findings FROM summary s LEFT JOIN findings f USING (video_id) GROUP BY ROLLUP (pdf_status, severity)", stages=True, first=BRANCHES)
def library_rollup(x):
    return coverage.library_rollup(x.summary, x.findings)


# Sorts, sets, audits -------------------------------------------------------------------------------------------------
@query("SELECT * FROM default_order", stages=True)
def default_page_order(x):
    return pages.default_page_order(x.assigned)


@query("""SELECT video_id, CASE WHEN blocking THEN 'blocking' ELSE 'review' END AS class, (row_number() OVER (PARTITION BY video_id, blocking ORDER BY finding_index))::INTEGER AS rank, finding_index FROM findings WHERE blocking OR severity = 'REVIEW' QUALIFY row_number() OVER (PARTITION BY video_id, blocking ORDER BY finding_index) <= CASE WHEN blocking THEN 20 ELSE 12 END""", stages=True, once=("findings",), first=BRANCHES)
def top_findings(x):
    return coverage.top_findings(x.findings)


@query("SELECT * FROM valid_orders")
def page_order_permutation(x):
    return pages.order_is_permutation(x.orders, x.trusted)


def _detail(df):
    """The evidence of a finding as one line of text."""
    e = lambda n: F.col(f"evidence.{n}").cast("string")
    line = lambda *parts: F.concat(*(F.lit(p) if i % 2 == 0 else e(p) for i, p in enumerate(parts)))
    first = F.split("reasons", ",")[0]
    text = (
        F.when(first == "UNCAPTURED_STRONG_VISUAL_CHANGE", line("scenes=", "scene_change_count", " structural=", "structural_change_count", " near=", "nearby_stable_state_timestamps", " open=", "unresolved_stable_state_timestamps"))
        .when(first == "PROTECTED_EVIDENCE_NOT_TRUSTED", line("candidate=", "candidate_index"))
        .when(first == "LONG_TRUSTED_SCREENSHOT_GAP", line("segments=", "transcript_segment_count", " words=", "transcript_word_count", " changes=", "visual_change_count", " states=", "stable_state_count", " open=", "unresolved_stable_state_count"))
        .when(first == "TOPIC_WITHOUT_TRUSTED_SCREENSHOT", line("topic=", "topic_index", " segments=", "transcript_segment_count", " words=", "word_count"))
        .otherwise(line("trusted=", "trusted_index", " words=", "word_count"))
    )
    return df.withColumn("detail", text).drop("evidence")


@query("SELECT * FROM findings", stages=True, once=("findings",), first=BRANCHES)
def coverage_findings(x):
    return _detail(x.findings)


def _rule(n: int, name: str) -> None:
    def rule(x):
        return _detail(x.rule(n)).drop("rule", "rule_order")

    rule.__name__ = name
    query(f"SELECT video_id, severity, blocking, start_seconds, end_seconds, reasons, detail FROM rule{n}", stages=True, once=() if n in (1, 3) else ("resolved",))(rule)


for _n, _name in enumerate(("uncaptured_change", "protected_lost", "long_gap", "topic_without_visual", "ocr_uncertain"), 1):
    _rule(_n, f"rule_{_name}")


@query("SELECT * FROM lecture_durations", stages=True, once=("spans",))
def lecture_duration(x):
    return x.lecture_durations


# Quality, lineage, mutation ------------------------------------------------------------------------------------------
@query("SELECT video_id, min(e) AS first_bad, count(*) AS violations FROM (SELECT video_id, position, trusted_index, (row_number() OVER (PARTITION BY video_id ORDER BY position) - 1)::INTEGER AS e FROM orders) WHERE e <> trusted_index GROUP BY ALL")
def check_contiguous(x):
    return quality.check_contiguous(x.orders, "trusted_index", "position")


@query("SELECT coalesce(a.video_id, b.video_id) AS video_id, coalesce(a.n, 0) AS n, coalesce(b.n, 0) AS expected FROM (SELECT video_id, count(*) AS n FROM orders GROUP BY 1) a FULL JOIN (SELECT video_id, count(*) AS n FROM trusted GROUP BY 1) b USING (video_id) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)")
def check_expected_count(x):
    return quality.check_expected_count(x.orders, x.trusted.groupBy("video_id").agg(F.count("*").alias("trusted_count")), "trusted_count")


@query("""SELECT video_id, min(row_index)::INTEGER AS first_bad, count(*) AS violations FROM (SELECT *, lag(frame_index) OVER w AS lf, lag(timestamp_seconds) OVER w AS lt FROM shuffled_changes WINDOW w AS (PARTITION BY video_id ORDER BY row_index)) WHERE frame_index <= previous_frame_index OR frame_index <= lf OR previous_timestamp_seconds < lt OR timestamp_seconds < previous_timestamp_seconds GROUP BY ALL""")
def check_monotone_changes(x):
    return quality.check_monotone(x.shuffled_changes)


@query("SELECT video_id, min(frame_index) AS first_bad, count(*) AS violations FROM shuffled_changes WHERE kind NOT IN ('NONE', 'LOCAL', 'STRUCTURAL', 'SCENE') GROUP BY ALL")
def check_domain(x):
    return quality.check_domain(x.shuffled_changes)


@query("""SELECT video_id, min(trusted_index) FILTER (n <> 1) AS first_bad, count(*) FILTER (n <> 1) AS violations, sum(n) <> count(*) AS sum_differs
FROM (SELECT t.video_id, t.trusted_index, count(a.video_id) AS n FROM trusted t LEFT JOIN (FROM assigned WHERE NOT (video_id::INTEGER % 4 = 1 AND trusted_index = 2) UNION ALL FROM assigned WHERE video_id::INTEGER % 4 < 2 AND trusted_index = 3) a USING (video_id, trusted_index) GROUP BY ALL)
GROUP BY video_id HAVING count(*) FILTER (n <> 1) > 0""", stages=True)
def check_exactly_once(x):
    """In every fourth lecture a screenshot is in no topic; in that and the one before it, another is in one twice."""
    v, i = F.col("video_id").cast("int") % 4, F.col("trusted_index")
    assigned = x.assigned.where(~((v == 1) & (i == 2))).unionByName(x.assigned.where((v < 2) & (i == 3)))
    return quality.check_exactly_once(x.trusted, assigned)


@query("SELECT video_id, trusted_index, video_id || '-' || image_filename AS image_filename FROM trusted WHERE candidate_index % 6 = 0", stages=True)
def check_assets_present(x):
    manifest = x.trusted.select("video_id", "trusted_index", F.concat("video_id", F.lit("-"), "image_filename").alias("image_filename"))
    return quality.check_assets_present(manifest, artifacts.read_image_assets(x.spark, _image_folder(x)))


@query("SELECT * FROM freshness")
def artifact_freshness(x):
    return lineage.artifact_freshness(x.stage_inputs, x.versions)


@query("SELECT f.video_id, r.target AS stage, CASE WHEN max(f.status) FILTER (f.stage = r.target) = 'MISSING' THEN 'MISSING' WHEN bool_or(f.status <> 'FRESH') THEN 'STALE' ELSE 'FRESH' END AS status FROM freshness f JOIN reach r USING (stage) GROUP BY ALL")
def stale_cascade(x):
    return lineage.stale_cascade(lineage.artifact_freshness(x.stage_inputs, x.versions))


@query("SELECT video_id, candidate_index, manual_decision, NULL::VARCHAR AS reject_reason FROM overrides UNION ALL SELECT video_id, candidate_index, NULL, reject_reason FROM judged WHERE reject_reason IS NOT NULL")
def apply_decisions(x):
    return x.overrides.withColumn("reject_reason", F.lit(None).cast("string")).unionByName(x.rejects.withColumn("manual_decision", F.lit(None).cast("boolean")))


@query("""SELECT video_id, candidate_index, CASE WHEN reason IS NULL THEN selected END AS manual_decision, reason AS reject_reason
FROM (SELECT *, CASE WHEN (video_id::INTEGER + candidate_index) % 3 = 0 THEN 'OTHER_VERSION' ELSE reject_reason END AS reason FROM judged) WHERE reason IS NOT NULL OR selected <> default_selected""")
def apply_versioned_decisions(x):
    """A third of the decisions was made on the candidates before the present ones."""
    made_on = F.when((F.col("video_id").cast("int") + F.col("candidate_index")) % 3 == 0, 1).otherwise(2)
    versions = x.review.select("video_id").distinct().withColumn("version", F.lit(2))
    overrides, rejects = cand.apply_decisions(x.review, x.decision_events.withColumn("candidate_version", made_on), versions)
    return overrides.withColumn("reject_reason", F.lit(None).cast("string")).unionByName(rejects.withColumn("manual_decision", F.lit(None).cast("boolean")))


@query("""SELECT a.video_id, CASE WHEN NOT v.valid THEN 'REJECTED' WHEN a.l IS NOT DISTINCT FROM b.l THEN 'UNCHANGED' ELSE 'APPLIED' END AS outcome, CASE WHEN v.valid AND a.l IS DISTINCT FROM b.l THEN 1 ELSE 0 END AS version_bump
FROM (SELECT video_id, list(trusted_index ORDER BY position) AS l FROM orders GROUP BY 1) a JOIN valid_orders v USING (video_id) LEFT JOIN (SELECT video_id, list(trusted_index ORDER BY trusted_index) AS l FROM trusted GROUP BY 1) b USING (video_id)""")
def apply_page_order(x):
    return pages.apply_page_order(x.trusted.select("video_id", F.col("trusted_index").alias("position"), "trusted_index"), x.orders, x.trusted)


@query("SELECT * FROM stable")
def refresh_stale(x):
    """States are made of changes that lack every third row in two lectures; when those two are put right, they alone are made again."""
    path = scratch_path(x.spark, "refresh")
    stages = [recompute.Stage("states", ("changes",), lambda t: chg.stable_states(t["changes"]), chg.STATES)]
    touched = F.col("video_id").isin("1", "2")
    first = x.changes.where(~touched | (F.col("frame_index") % 3 != 0))
    versions = x.changes.select("video_id").distinct().withColumn("input", F.lit("changes"))
    recompute.refresh(x.spark, path, stages, {"changes": first}, versions.withColumn("version", F.lit(1)))
    counts = recompute.refresh(x.spark, path, stages, {"changes": x.changes}, versions.withColumn("version", F.when(touched, 2).otherwise(1)))
    if counts.get("states", {}).get("lectures", 0) > 2:
        raise RuntimeError(f"lectures were made again that were not stale: {counts}")
    return artifacts.read_artifact(x.spark, f"{path}/states", recompute.schema_of(chg.STATES), "parquet")


# Streaming and plug-ins ----------------------------------------------------------------------------------------------
def _with_end(x):
    """Changes, and an END row for each lecture."""
    end = x.changes.groupBy("video_id").agg(*((F.max(c) if c.endswith(("index", "seconds")) else F.lit(0.0)).alias(c) for c in stream.COLUMNS if c != "kind"), F.lit("END").alias("kind"))
    rows = x.changes.select("video_id", *stream.COLUMNS).unionByName(end.withColumns({c: F.col(c).cast("int") + 1 for c in ("frame_index", "previous_frame_index")}).withColumn("timestamp_seconds", F.col("timestamp_seconds") + 1000))
    return rows


@query("SELECT * FROM stable")
def stable_states_stream(x):
    out = stream.replay(_with_end(x), stream.in_thirds("timestamp_seconds"), 3, stream.stable_states_stream)
    return out.where("status = 'EMITTED'").drop("status")


@query("SELECT video_id, frame_index, timestamp_seconds FROM changes WHERE frame_index % 100 = 99")
def late_row_audit(x):
    late = F.when(F.col("frame_index") % 100 == 99, 2).otherwise(1)  # these rows come after all others
    late = stream.replay(x.changes.select("video_id", *stream.COLUMNS), late, 2, stream.stable_states_stream)
    return late.where("status = 'REJECTED'").select("video_id", "frame_index", "timestamp_seconds")


@query("""SELECT video_id, min(timestamp_seconds) AS start_seconds, max(timestamp_seconds) + 1 AS end_seconds, count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY video_id ORDER BY timestamp_seconds ROWS UNBOUNDED PRECEDING) AS g FROM (
SELECT video_id, timestamp_seconds, CASE WHEN timestamp_seconds - lag(timestamp_seconds) OVER (PARTITION BY video_id ORDER BY timestamp_seconds) <= 1 THEN 0 ELSE 1 END AS b FROM changes WHERE kind <> 'NONE')) GROUP BY video_id, g""")
def activity_sessions_stream(x):
    at = F.timestamp_micros(F.round(F.col("timestamp_seconds") * 1e6).cast("long"))
    rows = x.changes.select("video_id", "timestamp_seconds", "kind", at.alias("at"))
    marker = rows.groupBy("video_id").agg((F.max("timestamp_seconds") + 1e6).alias("timestamp_seconds"), F.lit("END").alias("kind"), F.timestamp_micros(F.lit(2_000_000_000_000_000)).alias("at"))
    out = stream.replay(rows.unionByName(marker), F.lit(1), 1, stream.activity_sessions_stream)
    seconds = lambda c: F.unix_micros(c) / 1e6
    return out.where(F.col("start") < F.timestamp_micros(F.lit(2_000_000_000_000_000))).select("video_id", seconds("start").alias("start_seconds"), seconds("end").alias("end_seconds"), "n")


@query("SELECT video_id, frame_index, timestamp_seconds FROM changes WHERE frame_index % 100 = 99 AND kind <> 'NONE' AND timestamp_seconds + 1 <= (SELECT max(timestamp_seconds) FROM changes WHERE frame_index % 100 <> 99 AND kind <> 'NONE')")
def late_session_rows(x):
    """Every hundredth row comes after all others: those behind the watermark by then."""
    rows = x.changes.select("video_id", "frame_index", "timestamp_seconds", "kind", F.timestamp_micros(F.round(F.col("timestamp_seconds") * 1e6).cast("long")).alias("at"))
    late = stream.replay_split(rows, F.when(F.col("frame_index") % 100 == 99, 2).otherwise(1), 2)[1]
    return late.select("video_id", "frame_index", "timestamp_seconds")


def _extractor():
    def extract(content: bytes) -> dict:
        words, lines = content.decode().split(" "), content.decode().split("\n")
        records = [{"text": t, "confidence": float(len(t) % 101), "bbox": [10, 20 * i, 6 * len(t), 12]} for i, t in enumerate(lines)]
        return {"text": content.decode(), "lines": records, "word_count": len(words), "mean_confidence": float(len(words) % 101), "has_text": bool(content.strip())}

    return extract


def _screens(x):
    return x.read("conversations").select((F.col("conv_id") % TILES).cast("string").alias("video_id"), (F.floor(F.col("conv_id") / TILES) * 100 + F.col("turn")).cast("int").alias("trusted_index"), F.col("text").cast("binary").alias("content"))


@query("SELECT (conv_id % 20)::VARCHAR AS video_id, (conv_id // 20 * 100 + turn)::INTEGER AS trusted_index, text, len(string_split(text, ' ')) AS word_count, (len(string_split(text, ' ')) % 101)::DOUBLE AS mean_confidence, trim(text) <> '' AS has_text, trim(text) <> '' AND len(string_split(text, ' ')) % 101 < 55 AS low_confidence, array_to_string(string_split(text, chr(10)), '/') AS lines, len(string_split(text, chr(10)))::INTEGER AS line_count FROM conversations")
def apply_text_extractor(x):
    return plugins.apply_text_extractor(_screens(x), _extractor).withColumn("lines", F.array_join("lines.text", "/"))


@query("""SELECT video_id, trusted_index, (i - 1)::INTEGER AS line_index, text, (len(text) % 101)::DOUBLE AS confidence, 10 AS "left", (20 * (i - 1))::INTEGER AS top, (6 * len(text))::INTEGER AS width, 12 AS height
FROM (SELECT (conv_id % 20)::VARCHAR AS video_id, (conv_id // 20 * 100 + turn)::INTEGER AS trusted_index, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS text FROM conversations)""")
def extracted_lines(x):
    return plugins.extracted_lines(plugins.apply_text_extractor(_screens(x), _extractor, spread=True))


def _transcriber():
    def transcribe(content: bytes):
        for i, line in enumerate(content.decode().split("\n")):
            yield float(i), float(i + 1), line

    return transcribe


@query("SELECT video_id, raw_index, (p - 1)::DOUBLE AS \"start\", p::DOUBLE AS \"end\", text FROM (SELECT (conv_id % 20)::VARCHAR AS video_id, (conv_id * 100 + turn) * 1000000 + generate_subscripts(string_split(text, chr(10)), 1) - 1 AS raw_index, generate_subscripts(string_split(text, chr(10)), 1) AS p, unnest(string_split(text, chr(10))) AS text FROM conversations)")
def apply_transcriber(x):
    audio = x.read("conversations").select((F.col("conv_id") % TILES).cast("string").alias("video_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("raw_base"), F.col("text").cast("binary").alias("content"))
    return plugins.apply_transcriber(audio, _transcriber)
