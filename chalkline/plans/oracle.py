"""The stage tables as DuckDB SQL: every query's SQL is put together from these."""

from __future__ import annotations

import re

from chalkline.config import ChangeConfig
from chalkline.functions import text as tx

SPEECH = ", ".join(f"'{w}'" for w in tx.SPEECH_STOPWORDS)
VISIBLE = ", ".join(f"'{w}'" for w in tx.VISIBLE_STOPWORDS)
CUE = tx.CUE.replace("'", "''").replace(r"\b", "(?:[^A-Za-z0-9_À-ÿ]|$)")
# Strips one cue without the character after it.
STRIP = tx.CUE.replace("'", "''").replace(r"\b", "([^A-Za-z0-9_À-ÿ]|$)")


def speech_tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '{tx.SPEECH_TOKEN}'), lambda y: y NOT IN ({SPEECH}))"


def visible_tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '{tx.VISIBLE_TOKEN}'), lambda y: y NOT IN ({VISIBLE}))"


def word_count(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({x}, '\\s+'), lambda y: y <> ''))"


def jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct({a} || {b})) END"


def duration_text(x: str) -> str:
    s = f"greatest(0, coalesce(round_even({x}, 0)::BIGINT, 0))"
    return f"CASE WHEN {s} // 3600 > 0 THEN ({s} // 3600)::VARCHAR || ':' || lpad(({s} // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad(({s} % 60)::VARCHAR, 2, '0') ELSE ({s} // 60 % 60)::VARCHAR || ':' || lpad(({s} % 60)::VARCHAR, 2, '0') END"


def clean(x: str) -> str:
    return f"regexp_replace(trim(regexp_replace({x}, '{STRIP}', '\\1'), ' ,.-:'), '\\s+', ' ', 'g')"


# name -> (SQL, recursive)
TABLES: dict[str, str] = {
    "all_changes": """SELECT video_id, lag(frame_index) OVER w AS previous_frame_index, frame_index, lag(timestamp_seconds) OVER w AS previous_timestamp_seconds, timestamp_seconds, kind,
 CASE WHEN kind = 'NONE' THEN 0.0::DOUBLE ELSE least(100.0::DOUBLE, value / 2) END AS change_score, value / 500 AS changed_pixel_ratio, value / 10 AS mean_pixel_delta, value / 1000 AS edge_change_ratio, least(1.0::DOUBLE, value / 250) AS change_bbox_area_ratio
 FROM (SELECT (user_id % 20)::VARCHAR AS video_id, ((epoch_us(ts) - 1704067200000000) // 2000)::DOUBLE / 1000000.0::DOUBLE AS timestamp_seconds, value::DOUBLE AS value,
  CASE WHEN event_type IN ('view', 'signup') THEN 'NONE' WHEN event_type = 'click' THEN 'LOCAL' WHEN event_type = 'purchase' THEN 'STRUCTURAL' ELSE 'SCENE' END AS kind,
  (row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) - 1)::INTEGER AS frame_index FROM events) WINDOW w AS (PARTITION BY video_id ORDER BY frame_index)""",
    "changes": "SELECT * FROM all_changes WHERE previous_frame_index IS NOT NULL",
    "lectures": "SELECT video_id FROM all_changes UNION SELECT video_id FROM segments UNION SELECT video_id FROM frames",
    "timeline": "SELECT video_id, count(*) AS frame_count, max(timestamp_seconds) AS duration_seconds, max(timestamp_seconds) AS last_timestamp_seconds FROM all_changes GROUP BY video_id",
    "raw_segments": """SELECT video_id, raw_index, start_ms::DOUBLE / 1000 AS "start", (start_ms + ms)::DOUBLE / 1000 AS "end", text FROM (SELECT video_id, ms, (row_number() OVER w - 1)::INTEGER AS raw_index,
 coalesce(sum(ms + pause) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + pause AS start_ms, CASE WHEN slot % 5 = 0 THEN 'Next, ' || text ELSE text END AS text
 FROM (SELECT regexp_extract(source, '(\\d+)', 1) AS video_id, doc_id, doc_id // 20 AS slot, coalesce(n_chars, 0) * 5 AS ms, (doc_id // 20) % 7 * 3000 AS pause, text FROM documents) WINDOW w AS (PARTITION BY video_id ORDER BY doc_id))""",
    "segments": """SELECT video_id, (row_number() OVER (PARTITION BY video_id ORDER BY raw_index) - 1)::INTEGER AS segment_index, start_seconds, end_seconds, text FROM (
 SELECT video_id, raw_index, round(greatest(0.0::DOUBLE, "start"), 6) AS start_seconds, round(greatest(0.0::DOUBLE, "start", "end"), 6) AS end_seconds, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text FROM raw_segments) WHERE text <> ''""",
    "frames": "SELECT (vec_id % 20)::VARCHAR AS video_id, (vec_id // 20)::INTEGER AS candidate_index, embedding::DOUBLE[] AS thumb, label FROM embeddings",
    "plain_candidates": """SELECT video_id, candidate_index, candidate_index * 10 AS frame_index, (candidate_index * 48 + 7)::DOUBLE AS timestamp_seconds,
 ['INITIAL_STABLE', 'STABLE_AFTER_CHANGE', 'STABLE_AFTER_CHANGE', 'PRE_TRANSITION_PROTECTION', 'END_OF_VIDEO_FALLBACK'][label % 5 + 1] AS reason, ['NONE', 'LOCAL', 'STRUCTURAL', 'SCENE'][label % 4 + 1] AS source_change_kind,
 label = 3 AS protected, candidate_index % 4 <> 1 AS kept, 'frame-' || candidate_index || '.png' AS image_filename,
 round(len(list_filter(range(1, len(thumb) + 1), lambda i: i % 8 <> 0 AND abs(thumb[i + 1] - thumb[i]) > 0.1))::DOUBLE / len(thumb) * (1 + candidate_index % 3) / 3, 6) AS edge_density,
 round(sqrt(list_sum(list_transform(thumb, lambda x: (x - list_sum(thumb) / len(thumb)) * (x - list_sum(thumb) / len(thumb)))) / len(thumb)) * (1 + candidate_index % 3) / 3, 6) AS contrast_std FROM frames""",
    "candidates": """SELECT * EXCLUDE (nk, ne, nc), content_loss_reason IS NOT NULL AS content_loss_risk FROM (SELECT *, CASE WHEN nk = 'SCENE' THEN 'SCENE_REPLACEMENT'
 WHEN edge_density >= 0.003::DOUBLE AND ne <= 0.60::DOUBLE * edge_density AND nc <= greatest(0.01::DOUBLE, 0.85::DOUBLE * contrast_std) THEN 'DETAIL_DROP' END AS content_loss_reason FROM (
 SELECT *, lead(source_change_kind) OVER w AS nk, lead(edge_density) OVER w AS ne, lead(contrast_std) OVER w AS nc FROM plain_candidates WINDOW w AS (PARTITION BY video_id ORDER BY candidate_index)))""",
    "review": "SELECT *, protected OR content_loss_risk AS auto_protected, kept OR protected OR content_loss_risk AS default_selected FROM candidates",
    "decision_events": """SELECT * FROM (SELECT (doc_id % 20)::VARCHAR AS video_id, (doc_id // 20)::INTEGER AS candidate_index, CASE WHEN quality = 0 OR (doc_id // 20) % 5 = 0 THEN false WHEN toxic = 1 THEN true END AS selected, (doc_id // 20) % 2 = 0 AS force, doc_id AS updated_at FROM labels) WHERE selected IS NOT NULL""",
    "judged": """SELECT e.*, r.default_selected, CASE WHEN r.default_selected IS NULL THEN 'UNKNOWN_CANDIDATE' WHEN r.auto_protected AND NOT e.selected AND NOT coalesce(e.force, false) THEN 'PROTECTED' END AS reject_reason
 FROM (SELECT * FROM decision_events QUALIFY row_number() OVER (PARTITION BY video_id, candidate_index ORDER BY updated_at DESC, selected DESC) = 1) e LEFT JOIN review r USING (video_id, candidate_index)""",
    "overrides": "SELECT video_id, candidate_index, selected AS manual_decision FROM judged WHERE reject_reason IS NULL AND selected <> default_selected",
    "reviewed": "SELECT r.*, o.manual_decision, coalesce(o.manual_decision, r.default_selected) AS selected FROM review r LEFT JOIN overrides o USING (video_id, candidate_index)",
    "trusted": "SELECT video_id, (row_number() OVER (PARTITION BY video_id ORDER BY candidate_index) - 1)::INTEGER AS trusted_index, candidate_index, frame_index, timestamp_seconds, reason, auto_protected, content_loss_risk, manual_decision, image_filename FROM reviewed WHERE selected",
    "ordered": "SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY timestamp_seconds, frame_index) AS i, row_number() OVER (PARTITION BY video_id ORDER BY timestamp_seconds DESC, frame_index DESC) AS back FROM changes",
    # The state machine, one row a step; m is what the step emits.
    "machine": """SELECT video_id, 0::BIGINT AS i, true AS pending, false AS had, NULL::DOUBLE AS quiet, NULL::DOUBLE AS last_t, -1 AS last_f, 0.0::DOUBLE AS score, 0 AS n, 'NONE' AS kind, 0 AS emitted,
 NULL::STRUCT(i INTEGER, f INTEGER, t DOUBLE, reason VARCHAR, quiet DOUBLE, kind VARCHAR, score DOUBLE, n INTEGER, protected BOOLEAN) AS m, false AS last FROM (SELECT DISTINCT video_id FROM changes)
 UNION ALL
 SELECT video_id, i, CASE WHEN none AND e THEN false WHEN none THEN pending ELSE true END, CASE WHEN none AND e THEN false WHEN none THEN had ELSE true END, CASE WHEN none THEN q ELSE NULL END,
  CASE WHEN e THEN et ELSE last_t END, CASE WHEN e THEN ef ELSE last_f END, CASE WHEN none AND e THEN 0.0 WHEN none THEN score WHEN e THEN c_score ELSE greatest(score, c_score) END, CASE WHEN none AND e THEN 0 WHEN none THEN n WHEN e THEN 1 ELSE n + 1 END,
  CASE WHEN none AND e THEN 'NONE' WHEN none THEN kind ELSE c_kind END, CASE WHEN e THEN emitted + 1 ELSE emitted END,
  CASE WHEN e THEN {'i': emitted, 'f': ef, 't': et, 'reason': CASE WHEN NOT none THEN 'PRE_TRANSITION_PROTECTION' WHEN had OR emitted > 0 THEN 'STABLE_AFTER_CHANGE' ELSE 'INITIAL_STABLE' END, 'quiet': round(et - q, 6), 'kind': kind, 'score': score, 'n': n, 'protected': NOT none} END, back = 1
 FROM (SELECT *, CASE WHEN none THEN pending AND t - q >= 1.25::DOUBLE AND ef > last_f AND (last_t IS NULL OR et - last_t >= 0.5::DOUBLE)
   ELSE (c_kind = 'SCENE' OR ratio >= 0.12::DOUBLE OR c_score >= 35.0::DOUBLE) AND pending AND quiet IS NOT NULL AND pt - quiet >= 0.45::DOUBLE AND ef > last_f AND (last_t IS NULL OR et - last_t >= 0.5::DOUBLE) END AS e
  FROM (SELECT s.video_id, s.pending, s.had, s.quiet, s.last_t, s.last_f, s.score, s.n, s.kind, s.emitted, c.i, c.back, c.kind AS c_kind, c.kind = 'NONE' AS none, c.change_score AS c_score, c.changed_pixel_ratio AS ratio, c.previous_timestamp_seconds AS pt, c.timestamp_seconds AS t,
    CASE WHEN c.kind = 'NONE' THEN coalesce(s.quiet, c.previous_timestamp_seconds) ELSE s.quiet END AS q, CASE WHEN c.kind = 'NONE' THEN c.frame_index ELSE c.previous_frame_index END AS ef, CASE WHEN c.kind = 'NONE' THEN c.timestamp_seconds ELSE c.previous_timestamp_seconds END AS et
    FROM machine s JOIN ordered c ON c.video_id = s.video_id AND c.i = s.i + 1))""",
    "stable": """SELECT video_id, m.i AS checkpoint_index, m.f AS frame_index, m.t AS timestamp_seconds, m.reason AS reason, m.quiet AS stability_seconds, m.kind AS source_change_kind, m.score AS max_change_score_since_previous, m.n AS activity_pair_count_since_previous, m.protected AS protected_before_transition FROM machine WHERE m IS NOT NULL
 UNION ALL SELECT s.video_id, s.emitted, c.frame_index, c.timestamp_seconds, 'END_OF_VIDEO_FALLBACK', CASE WHEN s.quiet IS NULL THEN 0.0::DOUBLE ELSE round(c.timestamp_seconds - s.quiet, 6) END, s.kind, s.score, s.n, true
 FROM machine s JOIN ordered c ON c.video_id = s.video_id AND c.i = s.i WHERE s.last AND s.pending AND c.frame_index > s.last_f AND (s.last_t IS NULL OR c.timestamp_seconds - s.last_t >= 0.5::DOUBLE)""",
    "states": """SELECT video_id, (row_number() OVER (PARTITION BY video_id ORDER BY checkpoint_index) - 1)::INTEGER AS checkpoint_index, frame_index, timestamp_seconds, reason, source_change_kind, protected_before_transition FROM (
 SELECT s.video_id, s.checkpoint_index, least(s.frame_index, t.frame_count - 1)::INTEGER AS frame_index, least(s.timestamp_seconds, t.duration_seconds) AS timestamp_seconds, s.reason, s.source_change_kind, s.protected_before_transition,
 max(least(s.frame_index, t.frame_count - 1)) OVER (PARTITION BY s.video_id ORDER BY s.checkpoint_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM stable s JOIN timeline t USING (video_id)) WHERE before IS NULL OR frame_index > before
 UNION ALL SELECT video_id, 0, (frame_count - 1)::INTEGER, last_timestamp_seconds, 'END_OF_VIDEO_FALLBACK', 'NONE', true FROM timeline WHERE video_id NOT IN (SELECT video_id FROM stable)""",
    "durations": "SELECT video_id, max(end_seconds) AS duration FROM segments GROUP BY video_id",
    "signals": "SELECT video_id, candidate_index, coalesce(nullif(source_change_kind, ''), reason) AS signal FROM candidates WHERE source_change_kind = 'SCENE' OR reason IN ('PRE_TRANSITION_PROTECTION', 'END_OF_VIDEO_FALLBACK')",
    "near": "SELECT s.video_id, s.segment_index FROM segments s SEMI JOIN (SELECT t.video_id, t.timestamp_seconds FROM trusted t JOIN signals USING (video_id, candidate_index)) v ON s.video_id = v.video_id AND abs(v.timestamp_seconds - s.start_seconds) <= 6",
    "tokenized": f"SELECT video_id, segment_index, start_seconds, end_seconds, text, {speech_tokens('text')} AS tokens, regexp_matches(text, '{CUE}') AS cue FROM segments",
    "scored": """SELECT video_id, segment_index, start_seconds AS timestamp_seconds, gap, cue, v IS NOT NULL AS visual, CASE WHEN len(l) >= 5 AND len(r) >= 5 THEN 1 - (""" + jaccard("l", "r") + """) END AS novelty FROM (
 SELECT t.video_id, t.segment_index, t.start_seconds, t.cue, n.video_id AS v, t.start_seconds - lag(t.end_seconds) OVER w AS gap, list_distinct(flatten(list(t.tokens) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))) AS l, list_distinct(flatten(list(t.tokens) OVER (w ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))) AS r
 FROM tokenized t LEFT JOIN near n USING (video_id, segment_index) WINDOW w AS (PARTITION BY t.video_id ORDER BY t.segment_index)) WHERE segment_index >= 1""",
    "scores": """SELECT video_id, segment_index, timestamp_seconds, round(CASE WHEN gap >= 15 THEN 0.9::DOUBLE WHEN gap >= 8 THEN 0.55::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN cue THEN 0.65::DOUBLE ELSE 0.0::DOUBLE END + coalesce(0.55::DOUBLE * novelty, 0.0::DOUBLE) + CASE WHEN visual THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END, 6) AS score,
 list_filter([CASE WHEN gap >= 15 THEN 'LONG_SPEECH_GAP' WHEN gap >= 8 THEN 'SPEECH_GAP' END, CASE WHEN cue THEN 'TRANSITION_PHRASE' END, CASE WHEN novelty >= 0.72::DOUBLE THEN 'VOCABULARY_SHIFT' END, CASE WHEN visual THEN 'VISUAL_SECTION_CHANGE' END], lambda x: x IS NOT NULL) AS reasons FROM scored""",
    "score_lists": "SELECT s.video_id, list({'i': s.segment_index, 't': s.timestamp_seconds, 's': s.score, 'r': s.reasons} ORDER BY s.segment_index) AS c, any_value(f.start_seconds) AS first FROM scores s JOIN segments f ON f.video_id = s.video_id AND f.segment_index = 0 GROUP BY s.video_id",
    # One step a segment; taken is the boundary of the step.  Picks: the strongest ready one (latest of equals), else the best at hand (earliest of equals).
    "steps": """SELECT video_id, 0 AS n, first AS start, 0 AS last, 0 AS pend, NULL::STRUCT(i INTEGER, t DOUBLE, s DOUBLE, r VARCHAR[]) AS taken FROM score_lists
 UNION ALL SELECT video_id, n, coalesce(strong.t, far.t, start), coalesce(strong.i, far.i, last), CASE WHEN strong IS NOT NULL THEN strong.i WHEN far IS NOT NULL THEN cur.i ELSE pend END,
  CASE WHEN strong IS NOT NULL THEN strong WHEN far IS NOT NULL THEN {'i': far.i, 't': far.t, 's': far.s, 'r': CASE WHEN len(far.r) = 0 THEN ['MAX_SECTION_DURATION'] ELSE far.r END} END
 FROM (SELECT *, list_filter(c[1:n], lambda x: x.i > pend AND x.s >= 0.9::DOUBLE AND x.t - start >= 45) AS ready, CASE WHEN cur.t - start >= 45 AND len(ready) > 0 THEN list_reduce(ready, lambda a, b: CASE WHEN b.s > a.s OR b.s = a.s AND b.t > a.t THEN b ELSE a END) END AS strong_,
   strong_ AS strong, list_filter(c[1:n], lambda x: x.i > last AND x.t - start >= 45) AS pool, CASE WHEN strong_ IS NULL AND cur.t - start >= 300 AND len(pool) > 0 THEN list_reduce(pool, lambda a, b: CASE WHEN b.s > a.s THEN b ELSE a END) END AS far
  FROM (SELECT s.video_id, s.n + 1 AS n, s.start, s.last, s.pend, l.c, l.c[s.n + 1] AS cur FROM steps s JOIN score_lists l USING (video_id) WHERE s.n < len(l.c)))""",
    "boundaries": "SELECT video_id, taken.i AS segment_index, taken.t AS timestamp_seconds, taken.s AS score, taken.r AS reasons FROM steps WHERE taken IS NOT NULL",
    "starts": """SELECT *, (row_number() OVER w - 1)::INTEGER AS topic_index, lead(segment_start_index) OVER w AS next_index FROM (SELECT DISTINCT video_id, 0 AS segment_start_index, ['LECTURE_START'] AS boundary_reasons FROM segments UNION ALL SELECT video_id, segment_index, reasons FROM boundaries) WINDOW w AS (PARTITION BY video_id ORDER BY segment_start_index)""",
    "spans": """SELECT video_id, topic_index, segment_start_index, segment_end_index, CASE WHEN topic_index = 0 THEN least(s, earliest) ELSE s END AS start_seconds, CASE WHEN lead(s) OVER w IS NOT NULL THEN greatest(e, lead(s) OVER w) ELSE greatest(e, coalesce(duration, 0.0::DOUBLE)) END AS end_seconds, lead(s) OVER w IS NULL AS is_last, boundary_reasons FROM (
 SELECT a.video_id, a.topic_index, a.segment_start_index, any_value(a.boundary_reasons) AS boundary_reasons, max(g.segment_index) AS segment_end_index, arg_min(g.start_seconds, g.segment_index) AS s, arg_max(g.end_seconds, g.segment_index) AS e
 FROM starts a JOIN segments g ON g.video_id = a.video_id AND g.segment_index >= a.segment_start_index AND (a.next_index IS NULL OR g.segment_index < a.next_index) GROUP BY ALL) x
 LEFT JOIN (SELECT video_id, min(timestamp_seconds) AS earliest FROM trusted GROUP BY 1) USING (video_id) LEFT JOIN durations USING (video_id) WINDOW w AS (PARTITION BY video_id ORDER BY topic_index)""",
    "assigned": "SELECT t.video_id, s.topic_index, t.trusted_index, t.candidate_index, t.timestamp_seconds FROM trusted t JOIN spans s ON s.video_id = t.video_id AND t.timestamp_seconds >= s.start_seconds AND (s.is_last OR t.timestamp_seconds < s.end_seconds)",
    "in_topics": "SELECT g.*, s.topic_index FROM segments g JOIN spans s ON s.video_id = g.video_id AND g.segment_index BETWEEN s.segment_start_index AND s.segment_end_index",
    "topic_tokens": f"SELECT video_id, topic_index, segment_index AS row, unnest({speech_tokens('text')}) AS token, generate_subscripts({speech_tokens('text')}, 1) AS pos FROM in_topics",
    "keywords": "SELECT * FROM (SELECT video_id, topic_index, (row_number() OVER (PARTITION BY video_id, topic_index ORDER BY n DESC, first))::INTEGER AS rank, token, n FROM (SELECT video_id, topic_index, token, count(*) AS n, min((row, pos)) AS first FROM topic_tokens GROUP BY ALL)) WHERE rank <= 5",
    "keyword_lists": "SELECT video_id, topic_index, list(token ORDER BY rank) AS keywords FROM keywords GROUP BY ALL",
    "clean_texts": f"SELECT video_id, topic_index, segment_index, {clean('text')} AS clean FROM in_topics",
    "titles": f"""SELECT s.video_id, s.topic_index, CASE WHEN b.clean IS NOT NULL THEN upper(b.nine[1]) || b.nine[2:] WHEN len(k.keywords) > 0 THEN array_to_string(list_transform(k.keywords[1:3], lambda w: array_to_string(list_transform(regexp_extract_all(replace(w, '-', ' '), '[a-z]+|[^a-z]+'), lambda p: upper(p[1]) || p[2:]), '')), ' · ') ELSE 'Lecture Section ' || (s.topic_index + 1) END AS title
 FROM spans s LEFT JOIN (SELECT video_id, topic_index, clean, trim(array_to_string(string_split(clean, ' ')[1:9], ' '), ' ,.-:') AS nine FROM (SELECT c.video_id, c.topic_index, arg_max(c.clean, (coalesce(len(list_filter({speech_tokens('c.clean')}, lambda w: list_contains(q.keywords, w))), 0), -c.segment_index)) AS clean
  FROM clean_texts c LEFT JOIN keyword_lists q USING (video_id, topic_index) WHERE {word_count('c.clean')} BETWEEN 3 AND 12 GROUP BY ALL)) b USING (video_id, topic_index) LEFT JOIN keyword_lists k USING (video_id, topic_index)""",
    "topics": f"""SELECT s.video_id, s.topic_index, s.start_seconds, s.end_seconds, round(s.end_seconds - s.start_seconds, 6) AS duration_seconds, coalesce(g.n, 0) AS segment_count, coalesce(g.w, 0)::BIGINT AS word_count, coalesce(a.n, 0) AS screenshot_count, coalesce(a.l, []::INTEGER[]) AS trusted_screenshot_indexes FROM spans s
 LEFT JOIN (SELECT video_id, topic_index, count(*) AS n, sum({word_count('text')}) AS w FROM in_topics GROUP BY ALL) g USING (video_id, topic_index) LEFT JOIN (SELECT video_id, topic_index, count(*) AS n, list(trusted_index ORDER BY trusted_index) AS l FROM assigned GROUP BY ALL) a USING (video_id, topic_index)""",
    "alignment": """SELECT video_id, trusted_index, candidate_index, timestamp_seconds, lo AS context_start_seconds, hi AS context_end_seconds, coalesce(list(segment_index ORDER BY segment_index) FILTER (segment_index IS NOT NULL), []::INTEGER[]) AS segment_indexes, coalesce(string_agg(text, ' ' ORDER BY segment_index) FILTER (trim(text) <> ''), '') AS text FROM (
 SELECT t.video_id, t.trusted_index, t.candidate_index, t.timestamp_seconds, t.lo, t.hi, s.segment_index, s.text FROM (SELECT *, greatest(0.0::DOUBLE, timestamp_seconds - 6) AS lo, timestamp_seconds + 8 AS hi FROM trusted) t LEFT JOIN segments s ON s.video_id = t.video_id AND s.end_seconds >= t.lo AND s.start_seconds <= t.hi) GROUP BY ALL""",
    "ocr_lines_in": "SELECT (conv_id % 20)::VARCHAR AS video_id, (conv_id // 20)::INTEGER AS trusted_index, conv_id, turn, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM conversations",
    "ocr_words": """SELECT video_id, trusted_index, 1 AS page, turn::INTEGER AS block, 0 AS par, line::INTEGER AS line, turn * 1000000 + line * 10000 + word AS pos, (10 * word)::INTEGER AS "left", (20 * line + 400 * turn)::INTEGER AS top, (6 * length(text))::INTEGER AS width, 12 AS height,
 least(100, (7 * length(text) + 13 * word) % 101 - 1 + 15 * (conv_id % 3))::DOUBLE AS conf, text FROM (SELECT video_id, trusted_index, conv_id, turn, line, unnest(string_split(t, ' ')) AS text, generate_subscripts(string_split(t, ' '), 1) - 1 AS word FROM ocr_lines_in) WHERE trim(text) <> ''""",
    "ocr_lines": """SELECT video_id, trusted_index, page, block, par, line, min(pos) AS first_pos, string_agg(text, ' ' ORDER BY pos) AS text, coalesce(round(avg(conf) FILTER (conf >= 0), 3), 0.0::DOUBLE) AS confidence, min("left") AS "left", min(top) AS top, max("left" + width) - min("left") AS width, max(top + height) - min(top) AS height, count(*) AS words,
 (row_number() OVER (PARTITION BY video_id, trusted_index ORDER BY min(pos)) - 1)::INTEGER AS line_index FROM ocr_words GROUP BY video_id, trusted_index, page, block, par, line""",
    "ocr_pages": """SELECT l.*, w.word_count, w.mean_confidence, trim(l.text) <> '' AS has_text FROM (SELECT video_id, trusted_index, string_agg(text, chr(10) ORDER BY line_index) AS text, count(*) AS line_count FROM ocr_lines GROUP BY ALL) l
 JOIN (SELECT video_id, trusted_index, count(*) AS word_count, coalesce(round(avg(conf) FILTER (conf >= 0), 3), 0.0::DOUBLE) AS mean_confidence FROM ocr_words GROUP BY ALL) w USING (video_id, trusted_index)""",
    "ocr": """SELECT t.video_id, t.trusted_index, t.candidate_index, t.timestamp_seconds, coalesce(p.text, '') AS text, coalesce(p.line_count, 0) AS line_count, coalesce(p.word_count, 0) AS word_count, coalesce(p.mean_confidence, 0.0::DOUBLE) AS mean_confidence, coalesce(p.has_text, false) AS has_text, coalesce(p.has_text AND p.mean_confidence < 55, false) AS low_confidence FROM trusted t LEFT JOIN ocr_pages p USING (video_id, trusted_index)""",
    "content": """SELECT o.video_id, o.trusted_index, o.candidate_index, a.topic_index, x.title AS topic_title, o.text AS visible_text, s.text AS nearby_speech, concat_ws(chr(10) || chr(10), nullif(o.text, ''), nullif(s.text, '')) AS combined_context, o.mean_confidence AS ocr_mean_confidence, o.word_count AS ocr_word_count,
 list_filter([CASE WHEN NOT o.has_text THEN 'OCR_NO_TEXT' END, CASE WHEN o.has_text AND o.low_confidence THEN 'OCR_LOW_CONFIDENCE' END, CASE WHEN trim(s.text) = '' THEN 'NO_NEARBY_SPEECH' END], lambda x: x IS NOT NULL) AS coverage_flags
 FROM ocr o JOIN alignment s USING (video_id, trusted_index) JOIN (SELECT video_id, trusted_index, min(topic_index) AS topic_index FROM assigned GROUP BY ALL HAVING count(*) = 1) a USING (video_id, trusted_index) JOIN titles x USING (video_id, topic_index)""",
    "visual_tokens": f"SELECT video_id, topic_index, trusted_index AS row, unnest({visible_tokens('visible_text')}) AS token, generate_subscripts({visible_tokens('visible_text')}, 1) AS pos FROM content",
    "visual_keywords": "SELECT * FROM (SELECT video_id, topic_index, (row_number() OVER (PARTITION BY video_id, topic_index ORDER BY n DESC, first))::INTEGER AS rank, token, n FROM (SELECT video_id, topic_index, token, count(*) AS n, min((row, pos)) AS first FROM visual_tokens GROUP BY ALL)) WHERE rank <= 8",
    "resolved": """SELECT video_id, checkpoint_index, timestamp_seconds, CASE WHEN n IS NULL THEN 'UNRESOLVED' WHEN n.t OR n.selected THEN 'TRUSTED' WHEN NOT n.kept THEN 'AUTO_DISMISSED_DUPLICATE' WHEN n.manual = false THEN 'MANUALLY_DISMISSED' ELSE 'UNRESOLVED' END AS resolution FROM (
 SELECT s.video_id, s.checkpoint_index, s.timestamp_seconds, arg_min({'t': t.video_id IS NOT NULL, 'selected': r.selected, 'kept': r.kept, 'manual': r.manual_decision}, (abs(r.timestamp_seconds - s.timestamp_seconds), r.candidate_index)) FILTER (r.video_id IS NOT NULL) AS n
 FROM states s LEFT JOIN reviewed r ON r.video_id = s.video_id AND abs(r.timestamp_seconds - s.timestamp_seconds) <= 0.75::DOUBLE LEFT JOIN trusted t ON t.video_id = r.video_id AND t.candidate_index = r.candidate_index GROUP BY ALL)""",
    "clusters": """SELECT video_id, cluster_index, arg_min(previous_timestamp_seconds, (timestamp_seconds, frame_index)) AS start_seconds, max(timestamp_seconds) AS end_seconds, max(change_score) AS peak_score, count(*) FILTER (kind = 'SCENE') AS scene_count, count(*) FILTER (kind = 'STRUCTURAL') AS structural_count, (arg_min(previous_timestamp_seconds, (timestamp_seconds, frame_index)) + max(timestamp_seconds)) / 2 AS midpoint FROM (
 SELECT *, (sum(b) OVER w - 1)::INTEGER AS cluster_index FROM (SELECT *, CASE WHEN timestamp_seconds - lag(timestamp_seconds) OVER w <= 4 THEN 0 ELSE 1 END AS b FROM changes WHERE kind = 'SCENE' OR kind = 'STRUCTURAL' AND change_score >= 30 WINDOW w AS (PARTITION BY video_id ORDER BY timestamp_seconds, frame_index)) WINDOW w AS (PARTITION BY video_id ORDER BY timestamp_seconds, frame_index ROWS UNBOUNDED PRECEDING)) GROUP BY ALL""",
    "distances": "SELECT c.*, (SELECT min(abs(c.midpoint - t.timestamp_seconds)) FROM trusted t WHERE t.video_id = c.video_id) AS distance FROM clusters c",
    "near_states": """SELECT c.video_id, c.cluster_index, count(r.timestamp_seconds) AS state_count, count(*) FILTER (r.resolution = 'UNRESOLVED') AS unresolved_count, list(round(r.timestamp_seconds, 4) ORDER BY r.timestamp_seconds) FILTER (r.timestamp_seconds IS NOT NULL) AS all_times, list(round(r.timestamp_seconds, 4) ORDER BY r.timestamp_seconds) FILTER (r.resolution = 'UNRESOLVED') AS open_times
 FROM clusters c LEFT JOIN resolved r ON r.video_id = c.video_id AND r.timestamp_seconds >= c.start_seconds - 8 AND r.timestamp_seconds <= c.end_seconds + 8 GROUP BY ALL""",
    "states_near": "SELECT c.*, n.state_count, n.unresolved_count, coalesce(array_to_string(n.all_times[1:8], ','), '') AS state_times, coalesce(array_to_string(n.open_times[1:8], ','), '') AS unresolved_times FROM clusters c JOIN near_states n USING (video_id, cluster_index)",
    "lecture_durations": "SELECT video_id, greatest(0.0::DOUBLE, max(t)) AS duration FROM (SELECT video_id, end_seconds AS t FROM spans UNION ALL SELECT video_id, end_seconds FROM segments UNION ALL SELECT video_id, timestamp_seconds FROM trusted) GROUP BY video_id",
    "gaps": """SELECT video_id, l AS "left", r AS "right" FROM (SELECT video_id, lag(t) OVER (PARTITION BY video_id ORDER BY k, t) AS l, t AS r FROM (SELECT video_id, 0.0::DOUBLE AS t, 0 AS k FROM lecture_durations UNION ALL SELECT video_id, timestamp_seconds, 1 FROM trusted UNION ALL SELECT video_id, duration, 2 FROM lecture_durations WHERE duration > 0)) WHERE r - l >= 45""",
    "gap_evidence": f"""SELECT g.video_id, g."left", g."right", (SELECT count(*) FROM segments s WHERE s.video_id = g.video_id AND s.end_seconds >= g."left" AND s.start_seconds <= g."right") AS segment_count,
 (SELECT coalesce(sum({word_count('s.text')}), 0) FROM segments s WHERE s.video_id = g.video_id AND s.end_seconds >= g."left" AND s.start_seconds <= g."right")::BIGINT AS word_count,
 (SELECT count(*) FROM changes c WHERE c.video_id = g.video_id AND c.kind <> 'NONE' AND c.timestamp_seconds BETWEEN g."left" AND g."right") AS change_count,
 (SELECT count(*) FROM resolved r WHERE r.video_id = g.video_id AND r.timestamp_seconds > g."left" AND r.timestamp_seconds < g."right") AS state_count,
 (SELECT count(*) FROM resolved r WHERE r.video_id = g.video_id AND r.timestamp_seconds > g."left" AND r.timestamp_seconds < g."right" AND r.resolution = 'UNRESOLVED') AS unresolved_count FROM gaps g""",
    "rule1": """SELECT s.video_id, 1 AS rule, s.cluster_index AS o, CASE WHEN s.scene_count > 0 AND s.unresolved_count > 0 THEN 'HIGH' ELSE 'REVIEW' END AS severity, s.scene_count > 0 AND s.unresolved_count > 0 AS blocking, s.start_seconds, s.end_seconds, CASE WHEN s.unresolved_count > 0 THEN 'UNCAPTURED_STRONG_VISUAL_CHANGE,STABLE_STATE_NOT_IN_TRUSTED_SET' ELSE 'UNCAPTURED_STRONG_VISUAL_CHANGE' END AS reasons,
 'scenes=' || s.scene_count || ' structural=' || s.structural_count || ' near=' || s.state_times || ' open=' || s.unresolved_times AS detail FROM states_near s JOIN distances d USING (video_id, cluster_index) WHERE (d.distance IS NULL OR d.distance > 8) AND NOT (s.state_count > 0 AND s.unresolved_count = 0 AND s.scene_count = 0)""",
    "lost": "SELECT c.video_id, c.candidate_index, c.timestamp_seconds FROM candidates c ANTI JOIN trusted t ON t.video_id = c.video_id AND t.candidate_index = c.candidate_index WHERE c.protected OR c.content_loss_risk",
    "rule2": "SELECT video_id, 2 AS rule, candidate_index AS o, 'HIGH' AS severity, true AS blocking, timestamp_seconds AS start_seconds, timestamp_seconds AS end_seconds, 'PROTECTED_EVIDENCE_NOT_TRUSTED' AS reasons, 'candidate=' || candidate_index AS detail FROM lost",
    "rule3": """SELECT video_id, 3 AS rule, row_number() OVER (PARTITION BY video_id ORDER BY "left", "right") AS o, 'REVIEW' AS severity, false AS blocking, "left" AS start_seconds, "right" AS end_seconds, CASE WHEN word_count >= 90 THEN 'LONG_TRUSTED_SCREENSHOT_GAP,SPEECH_DENSE_GAP,UNUSED_STABLE_STATE_IN_GAP' ELSE 'LONG_TRUSTED_SCREENSHOT_GAP,UNUSED_STABLE_STATE_IN_GAP' END AS reasons,
 'segments=' || segment_count || ' words=' || word_count || ' changes=' || change_count || ' states=' || state_count || ' open=' || unresolved_count AS detail FROM gap_evidence WHERE ("right" - "left" >= 75 OR word_count >= 90 OR change_count >= 30) AND unresolved_count > 0""",
    "rule4": "SELECT video_id, 4 AS rule, topic_index AS o, 'HIGH' AS severity, true AS blocking, start_seconds, end_seconds, 'TOPIC_WITHOUT_TRUSTED_SCREENSHOT' AS reasons, 'topic=' || topic_index || ' segments=' || segment_count || ' words=' || word_count AS detail FROM topics WHERE screenshot_count <= 0",
    "warnings": "SELECT o.video_id, o.trusted_index, o.has_text, o.mean_confidence, o.word_count, t.timestamp_seconds FROM ocr o JOIN trusted t USING (video_id, trusted_index) WHERE NOT o.has_text OR o.low_confidence",
    "rule5": "SELECT video_id, 5 AS rule, trusted_index AS o, 'WARNING' AS severity, false AS blocking, timestamp_seconds AS start_seconds, timestamp_seconds AS end_seconds, CASE WHEN NOT has_text THEN 'OCR_NO_TEXT' ELSE 'OCR_LOW_CONFIDENCE' END AS reasons, 'trusted=' || trusted_index || ' words=' || word_count AS detail FROM warnings",
    "findings": """SELECT video_id, (row_number() OVER (PARTITION BY video_id ORDER BY rule, o) - 1)::INTEGER AS finding_index, severity, blocking, round(greatest(0.0::DOUBLE, start_seconds), 6) AS start_seconds, round(greatest(start_seconds, end_seconds), 6) AS end_seconds, reasons, detail FROM (SELECT * FROM rule1 UNION ALL SELECT * FROM rule2 UNION ALL SELECT * FROM rule3 UNION ALL SELECT * FROM rule4 UNION ALL SELECT * FROM rule5)""",
    "summary": """SELECT *, blocking_count = 0 AS ready_for_pdf, CASE WHEN blocking_count > 0 THEN 'BLOCKED' WHEN review_count > 0 THEN 'REVIEW' ELSE 'READY' END AS pdf_status FROM (SELECT l.video_id, count(f.video_id) AS finding_count, count(*) FILTER (severity = 'HIGH') AS high_count, count(*) FILTER (severity = 'MEDIUM') AS medium_count, count(*) FILTER (severity = 'REVIEW') AS review_count, count(*) FILTER (severity = 'WARNING') AS warning_count, count(*) FILTER (blocking) AS blocking_count FROM lectures l LEFT JOIN findings f USING (video_id) GROUP BY l.video_id)""",
    "orders": """SELECT video_id, trusted_index AS position, (CASE WHEN k = 1 THEN n - 1 - trusted_index WHEN k = 2 AND trusted_index = 1 THEN 0 ELSE trusted_index END)::INTEGER AS trusted_index FROM (SELECT video_id, trusted_index, count(*) OVER (PARTITION BY video_id) AS n, video_id::INTEGER % 4 AS k FROM trusted) WHERE NOT (k = 3 AND trusted_index = 0)""",
    "valid_orders": """SELECT coalesce(a.video_id, b.video_id) AS video_id, coalesce(a.l, []::INTEGER[]) = coalesce(b.l, []::INTEGER[]) AS valid FROM (SELECT video_id, list(trusted_index ORDER BY trusted_index) AS l FROM orders GROUP BY 1) a FULL JOIN (SELECT video_id, list(trusted_index ORDER BY trusted_index) AS l FROM trusted GROUP BY 1) b USING (video_id)""",
    "default_order": "SELECT video_id, (row_number() OVER (PARTITION BY video_id ORDER BY topic_index, trusted_index) - 1)::INTEGER AS position, trusted_index FROM assigned",
    "items": """SELECT o.video_id, o.position, o.trusted_index, t.candidate_index, t.timestamp_seconds, t.image_filename, a.topic_index, x.title AS topic_title FROM default_order o JOIN trusted t USING (video_id, trusted_index) LEFT JOIN (SELECT video_id, trusted_index, min(topic_index) AS topic_index FROM assigned GROUP BY ALL) a USING (video_id, trusted_index) LEFT JOIN titles x ON x.video_id = a.video_id AND x.topic_index = a.topic_index""",
    "pages_made": """SELECT *, unnest(list_filter([CASE WHEN first THEN 'COVER' END, CASE WHEN first OR before IS DISTINCT FROM topic_index THEN 'DIVIDER' END, 'SCREENSHOT'], lambda x: x IS NOT NULL)) AS page_kind FROM (SELECT *, lag(position) OVER w IS NULL AS first, lag(topic_index) OVER w AS before FROM items WINDOW w AS (PARTITION BY video_id ORDER BY position))""",
    "page_plan": """SELECT video_id, (row_number() OVER (PARTITION BY video_id ORDER BY position, CASE page_kind WHEN 'COVER' THEN 0 WHEN 'DIVIDER' THEN 1 ELSE 2 END))::INTEGER AS page_no, page_kind, CASE WHEN page_kind = 'SCREENSHOT' THEN trusted_index END AS trusted_index, CASE WHEN page_kind <> 'COVER' THEN topic_index END AS topic_index FROM pages_made""",
    # Activity windows of pairs, one row a step; m is the window that the step closes.
    "window_walk": """SELECT video_id, 0::BIGINT AS i, 0 AS run, NULL::DOUBLE AS s, NULL::DOUBLE AS l, 0.0::DOUBLE AS peak, false AS scene, false AS structural, 0 AS n, NULL::STRUCT(s DOUBLE, l DOUBLE, peak DOUBLE, scene BOOLEAN, structural BOOLEAN, n INTEGER) AS m, false AS last FROM (SELECT DISTINCT video_id FROM changes)
 UNION ALL SELECT video_id, i, runs, CASE WHEN hot THEN coalesce(s, pt) WHEN NOT shut THEN s END, CASE WHEN hot THEN t WHEN NOT shut THEN l END, CASE WHEN hot THEN greatest(peak, c_score) WHEN shut THEN 0.0::DOUBLE ELSE peak END,
  CASE WHEN hot THEN scene OR c_kind = 'SCENE' ELSE scene AND NOT shut END, CASE WHEN hot THEN structural OR c_kind = 'STRUCTURAL' ELSE structural AND NOT shut END, CASE WHEN hot THEN n + 1 WHEN shut THEN 0 ELSE n END,
  CASE WHEN shut THEN {'s': s, 'l': l, 'peak': peak, 'scene': scene, 'structural': structural, 'n': n} END, back = 1
 FROM (SELECT *, NOT hot AND s IS NOT NULL AND coalesce(t - l >= 1, false) AS shut FROM (SELECT *, c_kind IN ('STRUCTURAL', 'SCENE') OR c_kind = 'LOCAL' AND runs >= 2 AS hot FROM (
  SELECT w.*  EXCLUDE (i, m, last), c.i, c.back, c.kind AS c_kind, c.change_score AS c_score, c.previous_timestamp_seconds AS pt, c.timestamp_seconds AS t, CASE c.kind WHEN 'LOCAL' THEN w.run + 1 WHEN 'NONE' THEN 0 ELSE w.run END AS runs
  FROM window_walk w JOIN ordered c ON c.video_id = w.video_id AND c.i = w.i + 1)))""",
    "raw_windows": """SELECT video_id, (row_number() OVER (PARTITION BY video_id ORDER BY w.s) - 1)::INTEGER AS window_index, w.s AS start_seconds, w.l AS end_seconds, round(w.peak, 4) AS peak_score, w.scene AS scene_change, w.structural AS structural_change, w.n::BIGINT AS coarse_sample_count,
 CASE WHEN w.scene THEN 'SCENE_TRANSITION' WHEN w.structural THEN 'STRUCTURAL_ACTIVITY' ELSE 'PERSISTENT_LOCAL_CHANGE' END AS reason FROM (SELECT video_id, m AS w FROM window_walk WHERE m IS NOT NULL
 UNION ALL SELECT video_id, {'s': s, 'l': l, 'peak': peak, 'scene': scene, 'structural': structural, 'n': n} FROM window_walk WHERE last AND s IS NOT NULL)""",
    "padded": "SELECT s.*, greatest(0.0::DOUBLE, start_seconds - 1) AS lo, least(t.duration_seconds, end_seconds + 2) AS hi FROM raw_windows s JOIN timeline t USING (video_id)",
    "merged_windows": """SELECT video_id, (island - 1)::INTEGER AS window_index, min(lo) AS start_seconds, max(hi) AS end_seconds, max(peak_score) AS peak_score, bool_or(scene_change) AS scene_change, bool_or(structural_change) AS structural_change, sum(coarse_sample_count)::BIGINT AS coarse_sample_count, list(reason ORDER BY lo, hi, window_index) AS all_reasons FROM (
 SELECT *, sum(b) OVER (PARTITION BY video_id ORDER BY lo, hi, window_index ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN lo - max(hi) OVER (PARTITION BY video_id ORDER BY lo, hi, window_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 2 THEN 0 ELSE 1 END AS b FROM padded)) GROUP BY video_id, island""",
    # Near-duplicate suppression: recent holds the last five kept frames, newest first.
    "suppressed": """SELECT video_id, -1 AS candidate_index, []::STRUCT(i INTEGER, h BIGINT, v DOUBLE[])[] AS recent, NULL::STRUCT(kept BOOLEAN, "of" INTEGER, bits INTEGER, diff DOUBLE) AS m, 0::BIGINT AS step FROM (SELECT DISTINCT video_id FROM hashes)
 UNION ALL SELECT video_id, candidate_index, CASE WHEN keep THEN list_prepend({'i': candidate_index, 'h': dhash, 'v': thumb}, recent[1:4]) ELSE recent END,
  {'kept': keep, 'of': CASE WHEN NOT keep THEN hit.i END, 'bits': CASE WHEN hit IS NOT NULL THEN bit_count(xor(dhash, hit.h))::INTEGER END, 'diff': CASE WHEN hit IS NOT NULL THEN round(list_sum(list_transform(range(1, 65), lambda k: abs(thumb[k] - hit.v[k]))) / 64, 6) END}, step
 FROM (SELECT *, protected OR hit IS NULL AS keep FROM (SELECT h.video_id, h.candidate_index, h.dhash, h.thumb, h.protected, s.recent, h.step,
   list_filter(s.recent, lambda r: bit_count(xor(h.dhash, r.h)) <= 22 AND list_sum(list_transform(range(1, 65), lambda k: abs(h.thumb[k] - r.v[k]))) / 64 <= 0.14::DOUBLE)[1] AS hit
  FROM suppressed s JOIN (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY candidate_index) AS step FROM hashes) h ON h.video_id = s.video_id AND h.step = s.step + 1))""",
    "visual_groups": """SELECT video_id, trusted_index, timestamp_seconds AS t, 0 AS topic, timestamp_seconds AS since FROM trusted WHERE trusted_index = 0
 UNION ALL SELECT video_id, trusted_index, t, CASE WHEN fresh THEN topic + 1 ELSE topic END, CASE WHEN fresh THEN t ELSE since END FROM (
  SELECT c.video_id, c.trusted_index, c.timestamp_seconds AS t, g.topic, g.since, c.timestamp_seconds - g.t >= 90 AND c.timestamp_seconds - g.since >= 45 OR c.timestamp_seconds - g.since >= 300 AS fresh
  FROM visual_groups g JOIN trusted c ON c.video_id = g.video_id AND c.trusted_index = g.trusted_index + 1)""",
    "raw_times": "SELECT video_id, frame_index, CASE WHEN frame_index % 5 = 0 THEN 0.0::DOUBLE WHEN frame_index % 7 = 0 THEN timestamp_seconds - 9 ELSE timestamp_seconds END AS raw FROM all_changes",
    "repaired": """SELECT video_id, -1 AS i, 0.0::DOUBLE AS last FROM (SELECT DISTINCT video_id FROM all_changes)
 UNION ALL SELECT r.video_id, r.frame_index, greatest(p.last, CASE WHEN r.raw > 0 AND r.raw >= p.last THEN r.raw ELSE r.frame_index / 0.4::DOUBLE END) FROM repaired p JOIN raw_times r ON r.video_id = p.video_id AND r.frame_index = p.i + 1""",
    "dag": "SELECT * FROM (VALUES (0, 'raw', 'source'), (1, 'source', 'timeline'), (2, 'timeline', 'changes'), (3, 'changes', 'states'), (4, 'states', 'candidates'), (5, 'candidates', 'trusted'), (6, 'source', 'transcript'), (7, 'transcript', 'topics'), (7, 'trusted', 'topics'), (8, 'trusted', 'ocr'), (8, 'topics', 'ocr'), (9, 'changes', 'coverage'), (9, 'states', 'coverage'), (9, 'candidates', 'coverage'), (9, 'trusted', 'coverage'), (9, 'transcript', 'coverage'), (9, 'topics', 'coverage'), (9, 'ocr', 'coverage'), (10, 'trusted', 'order'), (11, 'trusted', 'pages'), (11, 'topics', 'pages'), (11, 'order', 'pages')) AS t(number, input, stage)",
    "stage_inputs": "SELECT video_id, stage, input, CASE WHEN (video_id::INTEGER + number) % 7 = 3 THEN NULL WHEN (video_id::INTEGER * 3 + number) % 11 = 5 THEN 0 ELSE 1 END AS recorded_version FROM lectures, dag",
    "freshness": "SELECT video_id, stage, CASE WHEN count(recorded_version) = 0 THEN 'MISSING' WHEN bool_and(recorded_version IS NOT DISTINCT FROM 1) THEN 'FRESH' ELSE 'STALE' END AS status FROM stage_inputs GROUP BY ALL",
    "reach": "SELECT stage AS target, stage FROM dag UNION SELECT r.target, d.input FROM reach r JOIN dag d ON d.stage = r.stage WHERE d.input <> 'raw'",
    "shuffled_changes": """SELECT * EXCLUDE (kind), CASE WHEN video_id::INTEGER % 3 = 0 AND frame_index = 10 THEN 11 WHEN video_id::INTEGER % 3 = 0 AND frame_index = 11 THEN 10 ELSE frame_index END AS row_index, CASE WHEN video_id::INTEGER % 5 = 0 AND frame_index % 50 = 7 THEN 'BLUR' ELSE kind END AS kind FROM changes""",
    "hashes": "SELECT video_id, candidate_index, thumb, label = 3 AS protected, list_reduce(list_transform(list_filter(range(0, 64), lambda i: i % 8 <> 7), lambda i: CASE WHEN thumb[i + 2] > thumb[i + 1] THEN 1 ELSE 0 END::BIGINT), lambda a, b: a * 2 + b) AS dhash FROM frames",
}


def frame_difference(a: str, b: str, c: ChangeConfig, edge: float) -> str:
    """{kind, score} of the change between two frames of 8 x 8 values."""
    changed = f"list_filter(range(0, 64), lambda i: abs({b}[i + 1] - {a}[i + 1]) >= {c.pixel_delta})"
    mean = f"list_sum(list_transform(range(1, 65), lambda i: abs({b}[i] - {a}[i]))) / 64"
    moved = f"len(list_filter(range(1, 65), lambda i: i % 8 <> 0 AND (abs({a}[i + 1] - {a}[i]) > {edge}) <> (abs({b}[i + 1] - {b}[i]) > {edge})))::DOUBLE / 64"
    side = lambda f, part: f"list_{f}(list_transform(ch, lambda i: {part}))"
    box = f"CASE WHEN len(ch) = 0 THEN 0.0::DOUBLE ELSE ({side('max', 'i // 8')} - {side('min', 'i // 8')} + 1) * ({side('max', 'i % 8')} - {side('min', 'i % 8')} + 1)::DOUBLE / 64 END"
    kind = (
        f"CASE WHEN mean <= {c.quiet_mean} AND len(ch) / 64.0::DOUBLE <= {c.quiet_ratio} AND moved <= {c.quiet_edge} THEN 'NONE' WHEN len(ch) / 64.0::DOUBLE >= {c.scene_ratio} OR mean >= {c.scene_mean} THEN 'SCENE'"
        f" WHEN len(ch) / 64.0::DOUBLE <= {c.local_ratio} AND {box} <= {c.local_bbox} AND mean <= {c.local_mean} THEN 'LOCAL' ELSE 'STRUCTURAL' END"
    )
    score = "floor(100.0::DOUBLE * (0.35::DOUBLE * least(1.0::DOUBLE, mean / 40) + 0.45::DOUBLE * least(1.0::DOUBLE, len(ch) / 64.0::DOUBLE / 0.35::DOUBLE) + 0.20::DOUBLE * least(1.0::DOUBLE, moved / 0.20::DOUBLE)) * 10000 + 0.5::DOUBLE) / 10000"
    return f"(SELECT {{'kind': {kind}, 'score': {score}}} FROM (SELECT {changed} AS ch, {mean} AS mean, {moved} AS moved))"


def anchored_windows(c: ChangeConfig, edge: float, quiet: float) -> str:
    """Activity windows of frames with an anchor: one row a step, m is the window that the step closes."""
    return f"""WITH RECURSIVE f AS (SELECT (vec_id % 20)::VARCHAR AS video_id, (vec_id // 20 * 48 + 7)::DOUBLE AS t, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY vec_id % 20 ORDER BY vec_id // 20) AS i, row_number() OVER (PARTITION BY vec_id % 20 ORDER BY vec_id // 20 DESC) = 1 AS last FROM embeddings),
walk AS (SELECT video_id, i, t, v, v AS anchor, 0 AS run, NULL::DOUBLE AS s, NULL::DOUBLE AS l, 0.0::DOUBLE AS peak, false AS scene, false AS structural, 0 AS n, NULL::STRUCT(s DOUBLE, l DOUBLE, peak DOUBLE, scene BOOLEAN, structural BOOLEAN, n INTEGER) AS m, last FROM f WHERE i = 1
 UNION ALL SELECT video_id, i, t, v, CASE WHEN shut OR NOT hot AND s IS NULL AND p.kind = 'NONE' THEN v ELSE anchor END, runs, CASE WHEN hot THEN coalesce(s, pt) WHEN NOT shut THEN s END, CASE WHEN hot THEN t WHEN NOT shut THEN l END,
  CASE WHEN hot THEN greatest(peak, p.score, a.score) WHEN shut THEN 0.0::DOUBLE ELSE peak END, CASE WHEN hot THEN scene OR 'SCENE' IN (p.kind, a.kind) ELSE scene AND NOT shut END, CASE WHEN hot THEN structural OR 'STRUCTURAL' IN (p.kind, a.kind) ELSE structural AND NOT shut END, CASE WHEN hot THEN n + 1 WHEN shut THEN 0 ELSE n END,
  CASE WHEN shut THEN {{'s': s, 'l': l, 'peak': peak, 'scene': scene, 'structural': structural, 'n': n}} END, last
 FROM (SELECT *, NOT hot AND s IS NOT NULL AND coalesce(t - l >= {quiet}, false) AS shut FROM (SELECT *, p.kind IN ('STRUCTURAL', 'SCENE') OR a.kind IN ('STRUCTURAL', 'SCENE') OR p.kind = 'LOCAL' AND (runs >= 2 OR a.kind <> 'NONE') AS hot FROM (
  SELECT *, CASE p.kind WHEN 'LOCAL' THEN run + 1 WHEN 'NONE' THEN 0 ELSE run END AS runs FROM (SELECT *, {frame_difference('before', 'v', c, edge)} AS p, {frame_difference('anchor', 'v', c, edge)} AS a FROM (
   SELECT f.video_id, f.i, f.t, f.v, f.last, w.v AS before, w.anchor, w.t AS pt, w.run, w.s, w.l, w.peak, w.scene, w.structural, w.n FROM walk w JOIN f ON f.video_id = w.video_id AND f.i = w.i + 1)))))),
closed AS (SELECT video_id, m AS w FROM walk WHERE m IS NOT NULL UNION ALL SELECT video_id, {{'s': s, 'l': l, 'peak': peak, 'scene': scene, 'structural': structural, 'n': n}} FROM walk WHERE last AND s IS NOT NULL)
SELECT video_id, (row_number() OVER (PARTITION BY video_id ORDER BY w.s) - 1)::INTEGER AS window_index, w.s AS start_seconds, w.l AS end_seconds, round(w.peak, 4) AS peak_score, w.scene AS scene_change, w.structural AS structural_change, w.n::BIGINT AS coarse_sample_count,
 CASE WHEN w.scene THEN 'SCENE_TRANSITION' WHEN w.structural THEN 'STRUCTURAL_ACTIVITY' ELSE 'PERSISTENT_LOCAL_CHANGE' END AS reason FROM closed"""


def with_tables(body: str) -> str:
    """``body`` behind the tables that it names, in order of need."""
    order: list[str] = []

    def need(sql: str, own: str = "") -> None:
        for name in TABLES:
            if name != own and name not in order and re.search(rf"(?<![\w.]){name}(?![\w(])", re.sub(r"'[^']*'", "", sql)):
                need(TABLES[name], name)
                if name not in order:
                    order.append(name)

    need(body)
    return ("WITH RECURSIVE " + ",\n".join(f"{n} AS ({TABLES[n]})" for n in order) + "\n" if order else "") + body
