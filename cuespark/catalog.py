"""Queries over the driver's tables, by name, and the SQL that each must agree with."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuespark.functions.text import keywords, script_form
from cuespark.functions.timecode import format_srt, stable_id
from cuespark.operators import activity, audio, chunking, closure, matching, readability, recovery, review, stages, timeline
from cuespark.operators import tracks as track_files
from cuespark.plans.views import CUES, FILES, FRAMES, IVALS, LINES, TRACKS, cues, doc_lines, files, frames, intervals, table, tracks
from cuespark.sources import documents

#: name: (query, SQL)
QUERIES: dict = {}


def _query(sql: str | None):
    """Registers a query with its SQL, or with None where SQL cannot express it."""

    def add(f):
        QUERIES[f.__name__] = (f, sql and "WITH " + sql)
        return f

    return add


_CODES = lambda rules: "list_filter([" + ", ".join(f"CASE WHEN {test} THEN '{code}' END" for code, test in rules) + "], lambda x: x IS NOT NULL)"
_READ = r"length(regexp_replace({}, '[\s\pZ.,!?;:\"''()\[\]{{}}\-…、。！？「」『』（）]', '', 'g'))"


@_query(CUES + """, s AS (SELECT *, lag(idx, 1, 0) OVER w AS li, lag(end_ms) OVER w AS le FROM cues WINDOW w AS (PARTITION BY file ORDER BY pos))
SELECT file, pos, idx, unnest(""" + _CODES([("index_not_continuous", "idx <> li + 1"), ("invalid_time_range", "start_ms >= end_ms"), ("time_overlap", "start_ms < le"), ("empty_subtitle", "trim(content) = ''"), ("index_position_mismatch", "idx <> pos")]) + ") AS code FROM s")
def structural_issues(spark, d):
    return timeline.structural_issues(cues(spark, d))


_KINDS = """, s AS (SELECT *, lag(start_ms) OVER w AS ls, lag(end_ms) OVER w AS le FROM cues WINDOW w AS (PARTITION BY file ORDER BY pos)),
k AS (SELECT *, coalesce(le - start_ms, 0) AS o FROM s),
kinds AS (SELECT file, pos, idx, start_ms, end_ms, greatest(o, 0)::BIGINT AS overlap_ms, CASE WHEN start_ms >= end_ms OR coalesce(ls >= le, false) THEN 'invalid' WHEN o <= 0 THEN 'ok' WHEN o <= 120 AND start_ms - ls >= 1500 THEN 'minor' WHEN o <= 120 THEN 'too_short' WHEN o <= 500 THEN 'moderate' ELSE 'severe' END AS kind FROM k)"""


@_query(CUES + _KINDS + " SELECT file, pos, idx, overlap_ms, kind FROM kinds")
def overlap_classes(spark, d):
    return timeline.overlap_classes(cues(spark, d), least_ms=1500)


@_query(CUES + _KINDS + " SELECT file, pos, idx, start_ms, CASE WHEN lead(kind) OVER w = 'minor' THEN lead(start_ms) OVER w ELSE end_ms END AS end_ms FROM kinds WINDOW w AS (PARTITION BY file ORDER BY pos)")
def overlap_clip(spark, d):
    return timeline.overlap_clip(cues(spark, d), least_ms=1500)


@_query(CUES + """, r AS (SELECT file, start_ms, greatest(0, coalesce(max(end_ms) OVER (PARTITION BY file ORDER BY start_ms, end_ms, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS g FROM cues)
SELECT file, g AS gap_start, start_ms AS gap_end FROM r WHERE start_ms - g >= 300""")
def gap_windows(spark, d):
    return timeline.gap_windows(cues(spark, d), 300)


@_query(CUES + """, r AS (SELECT *, max(end_ms) OVER (PARTITION BY file ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM cues),
i AS (SELECT *, sum(CASE WHEN m IS NULL OR start_ms > m + 250 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS island FROM r)
SELECT file, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n FROM i GROUP BY file, island""")
def merged_windows(spark, d):
    return timeline.merged_windows(cues(spark, d))


@_query(IVALS + """, a AS (SELECT file, frame, start_ms, end_ms FROM ivals WHERE kind IN (SELECT min(event_type) FROM events)), b AS (SELECT * FROM ivals WHERE kind NOT IN (SELECT min(event_type) FROM events))
SELECT a.file, a.frame, count(b.frame) AS n FROM a LEFT JOIN b ON a.file = b.file AND b.start_ms < a.end_ms AND b.end_ms > a.start_ms GROUP BY ALL""")
def interval_coverage(spark, d):
    rows = intervals(spark, d)
    first = rows.agg(F.min("kind").alias("first"))
    frames = rows.join(F.broadcast(first), F.col("kind") == F.col("first"), "left_semi").select("file", "frame", "start_ms", "end_ms")
    return timeline.interval_coverage(frames, rows.join(F.broadcast(first), F.col("kind") == F.col("first"), "left_anti"))


@_query(CUES + """, t AS (SELECT file, CASE WHEN file % 7 <> 0 THEN max(end_ms) END AS d FROM cues GROUP BY file)
SELECT file, k::BIGINT AS segment, (k * 9000)::BIGINT AS start_ms, CASE WHEN d > 0 THEN least(k * 9000 + 10000, d) END::BIGINT AS end_ms, CASE WHEN k > 0 THEN 1000 ELSE 0 END::BIGINT AS overlap_before_ms,
CASE WHEN coalesce(k * 9000 + 10000 >= d, false) THEN 0 ELSE 1000 END::BIGINT AS overlap_after_ms, CASE WHEN d > 0 THEN 'planned' ELSE 'planned_unknown_duration' END AS status
FROM (SELECT file, d, unnest(range(0, greatest(1, ceil((coalesce(d, 0) - 1000) / 9000.0)::BIGINT))) AS k FROM t)""")
def segments(spark, d):
    lengths = cues(spark, d).groupBy("file").agg(F.max("end_ms").alias("duration_ms"))
    return timeline.segments(lengths.withColumn("duration_ms", F.expr("if(file % 7 <> 0, duration_ms, null)")), 10_000, 1_000)


@_query(CUES + ", c AS (SELECT *, " + _READ.format("content") + " AS chars, string_split(content, chr(10)) AS l FROM cues) SELECT file, pos, idx, unnest(" + _CODES([
    ("too_many_chars", "chars > 250"), ("high_cps", "chars / greatest(0.001, (end_ms - start_ms) / 1000) > 100"), ("too_many_lines", "len(l) > 2"), ("line_too_long", "len(list_filter(l, lambda x: " + _READ.format("x") + " > 200)) > 0"),
    ("dense_repeated_sound", "len(list_filter(range(1, length(content) + 1), lambda i: length(substr(regexp_replace(content, '\\s', '', 'g'), i, 6)) = 6 AND len(list_distinct(string_split(substr(regexp_replace(content, '\\s', '', 'g'), i, 6), ''))) = 1)) > 0"),
]) + ") AS code FROM c")
def readability_warnings(spark, d):
    return readability.warnings(cues(spark, d), 250, 100.0, 2, 200)


@_query(CUES + """, c AS (SELECT *, CASE WHEN length(content) <= 200 THEN 1 ELSE 0 END AS short, lead(start_ms) OVER (PARTITION BY file ORDER BY pos) - end_ms AS gap FROM cues),
w AS (SELECT *, min(short) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS s, count(*) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS n FROM c)
SELECT file, pos, idx FROM w WHERE s = 1 AND n = 2 AND gap <= 600""")
def short_runs(spark, d):
    return readability.short_runs(cues(spark, d), 2, 200, 600)


RULES = [("article", r"\bthe\b"), ("number", r"\d+"), ("licence", r"licen[cs]ed? under [a-z]+"), ("mail", r"[a-z.]+@[a-z.]+")]


@_query(LINES + ", m AS (" + " UNION ALL ".join(f"SELECT file, pos, '{n}' AS rule, unnest(regexp_extract_all(content, '(?i){p}')) AS matched FROM lines" for n, p in RULES) + ") SELECT file, pos, rule, matched FROM m")
def risk_findings(spark, d):
    return readability.rule_findings(doc_lines(spark, d), RULES)


TERMS = ["the", "tion", "the", "qu", "sch"]


@_query(CUES + " SELECT file, pos, (" + " + ".join(f"contains(content, '{t}')::INT" for t in TERMS) + " + (length(content) > 140)::INT)::BIGINT AS score FROM cues")
def risk_score(spark, d):
    return readability.risk_score(cues(spark, d), TERMS)


@_query(CUES + " SELECT file, pos, ((pos - 1) // 3)::BIGINT AS chunk FROM cues")
def chunks_fixed(spark, d):
    return chunking.fixed(cues(spark, d), 3)


@_query("RECURSIVE " + CUES + """, r AS (SELECT file, pos, length(content) AS ch, contains(content, 'tion')::INT AS rk, regexp_matches(content, '[。！？….!?][ \n]*$') AND length(trim(content, ' ' || chr(10))) >= 18 AS e FROM cues),
f AS (SELECT file, pos, 0::BIGINT AS chunk, 1 AS n, ch, rk, e FROM r WHERE pos = 1
UNION ALL SELECT file, pos, CASE WHEN cut THEN chunk + 1 ELSE chunk END, CASE WHEN cut THEN 1 ELSE n + 1 END, CASE WHEN cut THEN xch ELSE ch + xch END, CASE WHEN cut THEN xrk ELSE rk + xrk END, xe FROM (
 SELECT r.file, r.pos, f.chunk, f.n, f.ch, f.rk, r.ch AS xch, r.rk AS xrk, r.e AS xe, (f.n >= 4 OR (f.n >= 2 AND f.ch >= 1500) OR (f.n >= 2 AND f.rk >= 3) OR (f.n >= 3 AND f.ch >= 700)) OR (f.n >= 2 AND f.ch >= 700 AND f.e) AS cut FROM f JOIN r ON r.file = f.file AND r.pos = f.pos + 1))
SELECT file, pos, chunk FROM f""")
def chunks_dynamic(spark, d):
    rows = cues(spark, d).select("file", "pos", "content", F.length("content").cast("long").alias("chars"), F.col("content").contains("tion").cast("long").alias("risk"))
    return chunking.dynamic(rows, size=3, least=2, most=4, target=700, hard=1500, risk_limit=3).drop("reason")


@_query(CUES + " SELECT file, pos, coalesce(string_agg(pos::VARCHAR, ',') OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS before, coalesce(string_agg(pos::VARCHAR, ',') OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '') AS after FROM cues")
def halo(spark, d):
    return chunking.halo(cues(spark, d))


@_query(CUES + """, n AS (SELECT file, pos, max(CASE WHEN length(content) > 400 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM cues),
i AS (SELECT file, pos, pos - row_number() OVER (PARTITION BY file ORDER BY pos) AS island FROM n WHERE near = 1)
SELECT file, pos, island::BIGINT AS island, ((row_number() OVER (PARTITION BY file, island ORDER BY pos) - 1) // 3)::BIGINT AS part FROM i""")
def deep_groups(spark, d):
    return chunking.dilated_groups(cues(spark, d).select("file", "pos", (F.length("content") > 400).alias("flag")), 1, 3)


_SIDES = ", r AS (SELECT file + (file % 6 = 0)::INT * 1000000 AS file, pos + (pos % 11 = 0)::INT * 1000 AS pos, idx + (pos % 7 = 0)::INT AS idx, start_ms, end_ms + (pos % 5 = 0)::INT AS end_ms FROM cues)"


def _right(rows: DataFrame) -> DataFrame:
    """A second version: every sixth file has another name, every eleventh cue another place, and some other indexes and ends."""
    moved = lambda e, kind="int": F.expr(e).cast(kind)
    return rows.select((F.col("file") + moved("file % 6 = 0") * 1_000_000).alias("file"), (F.col("pos") + moved("pos % 11 = 0") * 1000).alias("pos"), (F.col("idx") + moved("pos % 7 = 0")).alias("idx"), "start_ms", (F.col("end_ms") + moved("pos % 5 = 0")).alias("end_ms"), "content")


@_query(CUES + _SIDES + """ SELECT * FROM (SELECT file, pos, CASE WHEN r.idx IS NULL THEN 'missing_right' WHEN cues.idx IS NULL THEN 'missing_left' WHEN cues.idx <> r.idx THEN 'index_mismatch' WHEN cues.start_ms <> r.start_ms OR cues.end_ms <> r.end_ms THEN 'timeline_mismatch' END AS code FROM cues FULL JOIN r USING (file, pos)) WHERE code IS NOT NULL""")
def pair_mismatch(spark, d):
    rows = cues(spark, d)
    return review.pair_mismatch(rows, _right(rows))


@_query(CUES + _SIDES + " SELECT DISTINCT file FROM cues WHERE file NOT IN (SELECT file FROM r)")
def missing_pairs(spark, d):
    rows = cues(spark, d)
    return review.missing_pairs(rows, _right(rows))


@_query(CUES + ", i AS (SELECT file, idx FROM cues) SELECT i.file, i.idx, o.o AS \"offset\", c.content FROM i, (SELECT unnest([-2, -1, 1, 2]) AS o) o JOIN cues c ON c.file = i.file AND c.idx = i.idx + o.o")
def neighbor_context(spark, d):
    rows = cues(spark, d)
    return review.neighbour_context(rows.select("file", "idx"), rows)


@_query(CUES + """, u AS (SELECT file, idx + (file % 4 = 0 AND idx = 3)::INT * 100 AS idx, CASE WHEN file % 5 = 0 AND idx = 2 THEN 'other' ELSE content END AS cur, CASE WHEN idx % 3 = 0 THEN content ELSE 'new' END AS rep FROM cues),
s AS (SELECT u.file, u.idx, CASE WHEN c.content IS NULL THEN 'not_found' WHEN trim(rep) = '' THEN 'empty' WHEN trim(cur) <> '' AND trim(cur) <> trim(c.content) THEN 'stale' WHEN trim(rep) = trim(c.content) THEN 'already_correct' ELSE 'applied' END AS status FROM u LEFT JOIN cues c ON c.file = u.file AND c.idx = u.idx)
SELECT file, idx, CASE WHEN status = 'applied' AND bool_or(status IN ('not_found', 'empty', 'stale')) OVER (PARTITION BY file) THEN 'not_applied' ELSE status END AS status FROM s""")
def apply_result(spark, d):
    rows = cues(spark, d).select("file", "idx", "content")
    updates = rows.select("file", F.expr("idx + if(file % 4 = 0 AND idx = 3, 100, 0)").alias("idx"), F.expr("if(file % 5 = 0 AND idx = 2, 'other', content)").alias("current"), F.expr("if(idx % 3 = 0, content, 'new')").alias("replacement"))
    return review.apply_updates(rows, updates)


@_query("held AS (SELECT doc_id AS id, lang AS v FROM documents), new AS (SELECT doc_id + (doc_id % 3 = 0)::INT * 1000000 AS id, source AS v FROM documents) SELECT * FROM held UNION ALL SELECT * FROM new WHERE id NOT IN (SELECT id FROM held)")
def queue_upsert(spark, d):
    docs = table(spark, d, "documents")
    return review.upsert_absent(docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("v")), docs.select(F.expr("doc_id + if(doc_id % 3 = 0, 1000000, 0)").alias("id"), F.col("source").alias("v")), "id")


@_query("w AS (SELECT doc_id, sha256(coalesce(text, '')) AS signature FROM documents), c AS (SELECT sha256(coalesce(text, '') || CASE WHEN doc_id % 2 = 0 THEN '' ELSE ' edited' END) AS signature, doc_id % 10 <> 0 AS ok FROM documents) SELECT doc_id, signature FROM w WHERE signature NOT IN (SELECT signature FROM c WHERE ok)")
def cache_misses(spark, d):
    docs = table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    held = docs.select(F.sha2(F.concat("text", F.expr("if(doc_id % 2 = 0, '', ' edited')")), 256).alias("signature"), F.when(F.col("doc_id") % 10 == 0, "failed").otherwise("ok").alias("status"))
    return review.cache_misses(docs.select("doc_id", F.sha2("text", 256).alias("signature")), held)


@_query(CUES + " SELECT 'qc-' || substr(sha256(file::VARCHAR || chr(31) || idx::VARCHAR || chr(31) || content), 1, 16) AS issue_id, file, idx, CASE WHEN regexp_matches(lower(content), 'licen') THEN 'terminology' WHEN regexp_matches(lower(content), 'sch') THEN 'formatting' ELSE 'semantic' END AS category FROM cues")
def review_items(spark, d):
    rows = cues(spark, d)
    low = F.lower("content")
    return rows.select(stable_id(F.col("file").cast("string"), F.col("idx").cast("string"), F.col("content")).alias("issue_id"), "file", "idx", F.when(low.rlike("licen"), "terminology").when(low.rlike("sch"), "formatting").otherwise("semantic").alias("category"))


@_query(CUES + " SELECT file, pos, " + " || ".join(f"({{}})".format(x) for x in ("lpad((start_ms // 3600000)::VARCHAR, 2, '0')", "':'", "lpad((start_ms // 60000 % 60)::VARCHAR, 2, '0')", "':'", "lpad((start_ms // 1000 % 60)::VARCHAR, 2, '0')", "','", "lpad((start_ms % 1000)::VARCHAR, 3, '0')")) + " AS line FROM cues")
def srt_lines(spark, d):
    return cues(spark, d).select("file", "pos", format_srt(F.col("start_ms")).alias("line"))


@_query(TRACKS + " SELECT directory, count(*) AS files, coalesce(sum(duration_s), 0.0)::DOUBLE AS seconds, count(*) FILTER (duration_s IS NULL) AS unknown, md5(string_agg(path, ',' ORDER BY path)) AS paths FROM tracks GROUP BY directory")
def folder_rollup(spark, d):
    return audio.rollup(tracks(spark, d)).withColumn("paths", F.md5(F.array_join("paths", ",")))


@_query(TRACKS + ", r AS (SELECT *, list_position(['mp3', 'wav', 'flac', 'ogg'], extension) AS k FROM tracks) SELECT track_key, arg_min(path, (warnings, k, path)) AS path, count(*) AS variants FROM r GROUP BY track_key")
def best_variant(spark, d):
    return audio.best_variant(tracks(spark, d))


@_query(TRACKS + ", t AS (SELECT * FROM tracks WHERE duration_s IS NOT NULL) SELECT a.track_key, a.path, count(b.path) AS matches FROM t a LEFT JOIN t b ON a.track_key = b.track_key AND a.path <> b.path AND b.duration_s >= a.duration_s * (1 - 0.02::DOUBLE) AND b.duration_s <= a.duration_s / (1 - 0.02::DOUBLE) GROUP BY ALL")
def variant_match(spark, d):
    return audio.variant_match(tracks(spark, d).where("duration_s IS NOT NULL"))


@_query(IVALS + ", r AS (SELECT file, level, row_number() OVER (PARTITION BY file ORDER BY level) AS k, count(*) OVER (PARTITION BY file) AS n FROM ivals) SELECT file, level AS floor FROM r WHERE k = round_even((n - 1) * 0.2::DOUBLE, 0) + 1")
def noise_floor(spark, d):
    return audio.noise_floor(intervals(spark, d))


@_query(IVALS + """, k AS (SELECT *, lag(pos) OVER w AS lp, lag(end_ms) OVER w AS le FROM ivals WHERE level >= 20 WINDOW w AS (PARTITION BY file ORDER BY pos)),
i AS (SELECT *, sum(CASE WHEN coalesce(pos <> lp + 1 OR start_ms - le > 86400000, true) THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM k)
SELECT file, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS frames FROM i GROUP BY file, run HAVING max(end_ms) - min(start_ms) >= 1000""")
def activity_islands(spark, d):
    return audio.islands(intervals(spark, d).withColumn("candidate", F.col("level") >= 20), 86_400_000, 1000)


@_query("p AS (SELECT page_id, coalesce(html, '') AS h FROM pages) SELECT page_id, regexp_extract(h, '<title>([^<]*)</title>', 1) AS title, regexp_extract(h, '<html lang=\"([^\"]*)\"', 1) AS lang, regexp_extract(h, '<meta charset=\"([^\"]*)\"', 1) AS charset FROM p")
def page_meta(spark, d):
    h = F.coalesce("html", F.lit(""))
    return table(spark, d, "pages").select("page_id", F.regexp_extract(h, "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract(h, '<html lang="([^"]*)"', 1).alias("lang"), F.regexp_extract(h, '<meta charset="([^"]*)"', 1).alias("charset"))


_GAPS = CUES + """, t AS (SELECT file, max(end_ms) + 2000 AS d FROM cues GROUP BY file),
r AS (SELECT file, greatest(0, coalesce(max(end_ms) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS a, start_ms AS b FROM cues UNION ALL SELECT file, d - 2000, d FROM t),
gaps AS (SELECT file, a AS start_ms, b AS end_ms, 'main_asr_gap' AS reason FROM r WHERE b - a >= 300)"""


def _lengths(rows: DataFrame) -> DataFrame:
    return rows.groupBy("file").agg((F.max("end_ms") + 2000).alias("duration_ms"))


@_query(_GAPS + " SELECT * FROM gaps")
def uncovered_windows(spark, d):
    rows = cues(spark, d)
    return recovery.uncovered(rows, _lengths(rows), 300)


@_query(_GAPS + " SELECT file, greatest(0, start_ms - 200)::BIGINT AS start_ms, least(d, end_ms + 200)::BIGINT AS end_ms, reason FROM gaps JOIN t USING (file) WHERE least(d, end_ms + 200) - greatest(0, start_ms - 200) >= 800")
def padded_windows(spark, d):
    rows = cues(spark, d)
    return recovery.padded(recovery.uncovered(rows, _lengths(rows), 300), _lengths(rows), 200, 800)


@_query(CUES + """, x AS (SELECT file, start_ms, end_ms, CASE WHEN idx % 3 = 0 THEN 'third' ELSE 'other' END AS reason FROM cues),
r AS (SELECT *, max(end_ms) OVER (PARTITION BY file ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM x),
i AS (SELECT *, sum(CASE WHEN m IS NULL OR start_ms > m + 250 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS island FROM r),
k AS (SELECT file, island, reason, min(start_ms) AS s, max(end_ms) AS e FROM i GROUP BY ALL)
SELECT file, min(s) AS start_ms, max(e) AS end_ms, string_agg(reason, '+' ORDER BY s) AS reason FROM k GROUP BY file, island""")
def merged_reasons(spark, d):
    return recovery.merged(cues(spark, d).select("file", "start_ms", "end_ms", F.when(F.col("idx") % 3 == 0, "third").otherwise("other").alias("reason")))


_SCORED = FRAMES + """, l AS (SELECT *, CASE WHEN left_rms <= 0 THEN -120.0::DOUBLE ELSE 20 * log10(least(left_rms, 32767) / 32767.0::DOUBLE) END AS left_db, CASE WHEN right_rms <= 0 THEN -120.0::DOUBLE ELSE 20 * log10(least(right_rms, 32767) / 32767.0::DOUBLE) END AS right_db FROM frames),
k AS (SELECT *, greatest(left_db, right_db) AS level, row_number() OVER (PARTITION BY file ORDER BY greatest(left_db, right_db)) AS k, count(*) OVER (PARTITION BY file) AS n FROM l),
h AS (SELECT *, greatest(max(CASE WHEN k = round_even((n - 1) * 0.2::DOUBLE, 0) + 1 THEN level END) OVER (PARTITION BY file) + 10, -48) AS threshold FROM k),
c AS (SELECT *, regexp_replace(content, '[\\s\\pZ]+', '', 'g') AS t, (end_ms - start_ms) / 1000 AS s FROM cues),
v AS (SELECT *, length(t) = 0 OR (s >= 2.5 AND length(t) <= 4) OR (s >= 4 AND length(t) / s <= 1) AS weak FROM c),
m AS (SELECT f.file, f.pos, bool_and(weak) AS weak FROM frames f JOIN v ON f.file = v.file AND v.start_ms / 1000 < f.end_s AND v.end_ms / 1000 > f.start_s GROUP BY ALL),
z AS (SELECT h.*, CASE WHEN weak IS NULL THEN 'none' WHEN weak THEN 'weak' ELSE 'strong' END AS state, level >= threshold AS active, abs(left_db - right_db) >= 6 AS sided FROM h LEFT JOIN m ON h.file = m.file AND h.pos = m.pos)"""


@_query(_SCORED + """ SELECT file, pos, state, active, CASE WHEN NOT sided THEN 'balanced' WHEN left_db > right_db THEN 'left' ELSE 'right' END AS side,
round(active::INT * 1.0 + CASE state WHEN 'none' THEN 1.25 WHEN 'weak' THEN 0.9 ELSE -0.5 END + CASE WHEN sided THEN 0.75 WHEN active THEN 0.3 ELSE 0 END + CASE WHEN level >= threshold + 8 THEN 0.4 ELSE 0 END, 2)::DOUBLE AS score FROM z""")
def activity_scores(spark, d):
    seen = activity.coverage(frames(spark, d), cues(spark, d))
    return activity.scored(seen).select("file", "pos", "state", "active", "side", F.round("score", 2).alias("score"))


@_query(_SCORED + """, q AS (SELECT * FROM z WHERE active AND (state <> 'strong' OR abs(left_db - right_db) >= 5)),
b AS (SELECT *, sum(CASE WHEN pos = lp + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY file ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(pos) OVER (PARTITION BY file ORDER BY pos) AS lp FROM q))
SELECT file, min(start_s)::DOUBLE AS start_s, max(end_s)::DOUBLE AS end_s, count(*) AS frames, round(avg((state = 'none')::INT), 6) AS gap_ratio,
CASE WHEN avg((sided AND left_db > right_db)::INT) >= 0.4 AND avg((sided AND left_db > right_db)::INT) > avg((sided AND left_db <= right_db)::INT) THEN 'left' WHEN avg((sided AND left_db <= right_db)::INT) >= 0.4 AND avg((sided AND left_db <= right_db)::INT) > avg((sided AND left_db > right_db)::INT) THEN 'right' ELSE 'balanced' END AS side
FROM b GROUP BY file, run HAVING max(end_s) - min(start_s) >= 1""")
def activity_candidates(spark, d):
    seen = activity.scored(activity.coverage(frames(spark, d), cues(spark, d)))
    return activity.candidates(seen).select("file", "start_s", "end_s", "frames", F.round("gap_ratio", 6).alias("gap_ratio"), "side")


_REVIEWS = """e AS (SELECT doc_id + (doc_id % 3 = 0)::INT * 1000000 AS issue_id, source AS file, doc_id AS idx, CASE WHEN doc_id % 4 = 0 THEN 'formatting' ELSE 'semantic' END AS category FROM documents),
r AS (SELECT doc_id AS issue_id, CASE WHEN toxic = 1 THEN 'defer' WHEN quality = 1 THEN 'accept' ELSE 'reject' END AS decision, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'seen' END AS reason, CASE WHEN doc_id % 7 = 0 THEN 'insufficient' ELSE 'script_confirmed' END AS level, CASE WHEN doc_id % 11 = 0 THEN 'looks right' ELSE 'ASR line' END AS evidence FROM labels)"""


@_query(_REVIEWS + """, j AS (SELECT issue_id, e.issue_id AS ei, r.issue_id AS ri, category, decision, reason, level, evidence, decision = 'accept' AND category = 'semantic' AND evidence = 'looks right' AS put_off, reason = '' OR (decision = 'accept' AND level = 'insufficient') OR decision = 'defer' AS failed FROM e FULL JOIN r USING (issue_id))
SELECT issue_id, CASE WHEN ri IS NULL THEN 'unresolved' WHEN ei IS NULL THEN 'unknown' WHEN put_off OR decision = 'defer' THEN 'deferred' WHEN decision = 'accept' AND NOT failed THEN 'ready_to_apply' WHEN decision = 'reject' AND NOT failed THEN 'rejected' ELSE 'invalid' END AS status,
ri IS NOT NULL AND ei IS NOT NULL AND decision = 'accept' AND NOT put_off AND NOT failed AS apply_allowed FROM j""")
def closure_report(spark, d):
    return _closed(spark, d).select("issue_id", "status", "apply_allowed")


def _reviewed(spark: SparkSession, d: str) -> DataFrame:
    n, none = F.col("doc_id"), F.lit(None).cast("string")
    word = F.when(F.col("toxic") == 1, "defer").when(F.col("quality") == 1, "accept").otherwise("reject")
    return table(spark, d, "labels").select(
        n.alias("issue_id"), F.lit(1).alias("ord"), none.alias("file"), F.lit(None).cast("long").alias("idx"), word.alias("decision"), F.when(n % 5 == 0, "").otherwise("seen").alias("decision_reason"), F.when(n % 7 == 0, "insufficient").otherwise("script_confirmed").alias("evidence_level"),
        F.when(n % 11 == 0, "looks right").otherwise("ASR line").alias("evidence_summary"), F.lit("new").alias("replacement"), none.alias("corrected"), none.alias("suggest"), F.lit("old").alias("current"), none.alias("review_method"), F.lit(True).alias("review_required"),
    )


def _closed(spark: SparkSession, d: str) -> DataFrame:
    """Every third expected issue has an id that no review has."""
    n = F.col("doc_id")
    e = table(spark, d, "documents").select(F.expr("doc_id + if(doc_id % 3 = 0, 1000000, 0)").alias("issue_id"), F.col("source").alias("file"), n.alias("idx"), F.when(n % 4 == 0, "formatting").otherwise("semantic").alias("category"), F.lit("high").alias("severity"))
    return closure.items(e, _reviewed(spark, d))


@_query(FILES + """, b AS (SELECT track_key, min({n: w, r: k, p: path, e: extension, d: duration_s}) AS m, bool_or(extension = 'mp3') AS mp3 FROM files WHERE without GROUP BY track_key),
c AS (SELECT b.track_key, string_agg(f.path, ',' ORDER BY f.path) AS others FROM b JOIN files f ON b.track_key = f.track_key AND NOT f.without AND greatest(m.d, f.duration_s) > 0 AND abs(m.d - f.duration_s) / greatest(m.d, f.duration_s) <= 0.02::DOUBLE GROUP BY ALL)
SELECT b.track_key, m.p AS path, coalesce(others, '') AS others, others IS NULL OR m.n > 0 AS requires_review FROM b LEFT JOIN c ON b.track_key = c.track_key""")
def selected_sources(spark, d):
    chosen = track_files.select_sources(track_files.described(files(spark, d)))
    return chosen.select("track_key", "path", F.array_join("counterparts", ",").alias("others"), "requires_review")


@_query(FILES + " SELECT directory, CASE WHEN without THEN 'no_se' ELSE 'unknown' END AS category, count(*) AS files FROM files GROUP BY ALL")
def category_hist(spark, d):
    return track_files.described(files(spark, d)).groupBy("directory", "category").agg(F.count("*").alias("files"))


@_query("k AS (SELECT doc_id, trim(lang) AS k1, trim(source) AS k2 FROM documents) SELECT doc_id, array_to_string(list_filter([k1, CASE WHEN 'x' <> k1 THEN 'x' END, CASE WHEN 'y' <> k1 THEN 'y' END, CASE WHEN k2 NOT IN (k1, 'x', 'y') THEN k2 END], lambda x: x IS NOT NULL), ';') AS words FROM k")
def keyword_split(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(keywords(F.concat_ws(",", "lang", F.lit("x / y"), "source", F.lit(" x"), "lang")), ";").alias("words"))


@_query(CUES + r""" SELECT file, pos, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(content, '︙', '…'), '[\s\pZ]+', '', 'g'), '[0-9０-９]', '', 'g'), '[-‐‑–—―ー−]+', 'ー', 'g'), '[、。,.!?！？♡❤♪『』「」()\[\]（）…・:：;；"''“”]', '', 'g') AS form FROM cues""")
def script_forms(spark, d):
    return cues(spark, d).select("file", "pos", script_form(F.col("content")).alias("form"))


@_query("f AS (SELECT doc_id AS file, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l FROM documents WHERE coalesce(text, '') <> '') SELECT file, generate_subscripts(l, 1)::BIGINT AS line, md5(unnest(l)) AS content FROM f")
def document_lines(spark, d):
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("file"), F.col("text").alias("value"))
    return documents.lines(texts).select("file", "line", F.md5("content").alias("content"))


def _quote(request: str) -> str:
    """A model for tests: every target between marks."""
    return json.dumps([{"i": x["i"], "zh": f"> {x['text']} <", "flags": ["long_line", "none"]} for x in json.loads(request)["target_items"]])


@_query(CUES + " SELECT file, idx AS i, md5('> ' || content || ' <') AS text, 'long_line' AS flags FROM cues")
def model_stage(spark, d):
    rows = cues(spark, d).select("file", "pos", F.floor((F.col("pos") - 1) / 12).alias("chunk"), F.struct(F.col("idx").alias("i"), F.col("content").alias("text")).alias("item"))
    told = stages.translations(stages.ask(stages.requests(rows), _quote))
    return told.select("file", "i", F.md5("text").alias("text"), F.array_join("flags", ",").alias("flags"))


@_query("x AS (SELECT doc_id AS setting, CASE WHEN doc_id % 2 = 0 THEN lang END AS a, CASE WHEN doc_id % 3 = 0 THEN source END AS b FROM documents) SELECT setting, coalesce(a, b, 'default') AS value, CASE WHEN a IS NOT NULL THEN 0 WHEN b IS NOT NULL THEN 1 ELSE 2 END AS layer FROM x")
def config_overlay(spark, d):
    docs = table(spark, d, "documents")
    key = F.col("doc_id").alias("setting")
    first, second = docs.select(key, F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("value")), docs.select(key, F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("value"))
    return stages.overlay([first, second, docs.select(key, F.lit("default").alias("value"))])


@_query("h AS (SELECT page_id, regexp_extract(coalesce(html, ''), '<title>([^<]*)</title>', 1) AS t FROM pages) SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '[\\s\\pZ]+', ' ', 'g')) AS title, '' AS description, '' AS image, '' AS maker, '' AS published, '' AS keywords FROM h")
def page_metadata(spark, d):
    return documents.page_metadata(table(spark, d, "pages"), strict=True).select("page_id", "title", "description", "image", "maker", "published", F.array_join("keywords", ";").alias("keywords"))


def _scripts(spark: SparkSession, d: str) -> DataFrame:
    """Ten passages in a row are the script of a work, at every size of the table, so that no script grows with it."""
    return table(spark, d, "benchmark").select(F.floor(F.col("item_id") / 10).alias("work"), F.col("item_id").alias("track"), F.coalesce("text", F.lit("")).alias("text"))


def _pages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Passages, and the sentences of a work's passages as its pages."""
    scripts = _scripts(spark, d)
    sentences = scripts.select("work", "track", F.posexplode(F.split("text", r"(?<=[.!?])\s+")).alias("k", "text")).select("work", F.struct("track", "k").alias("page"), "text")
    return scripts, matching.clean_pages(sentences)


@_query(None)
def page_windows(spark, d):
    return matching.best_page_window(*_pages(spark, d))


@_query(None)
def unscripted_cues(spark, d):
    items = _scripts(spark, d)
    scripts = items.groupBy("work").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("track", "text"))), lambda x: x["text"]), "\n").alias("text"))
    works = items.agg(F.max("work")).first()[0] + 1
    return matching.unscripted(cues(spark, d).withColumn("work", F.col("file") % works), scripts).select("work", "file", "idx", F.round("ratio", 6).alias("ratio"))


from cuespark import catalog_details  # noqa: E402, F401 - registers its queries


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cues break each structural rule."""
    return structural_issues(spark, sf_dir).groupBy("code").agg(F.count("*").alias("n"))


def queries() -> dict:
    return {name: q for name, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
