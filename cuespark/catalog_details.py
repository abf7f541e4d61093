"""Further queries and their SQL: texts, files, reports, model stages and state."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuespark.catalog import _GAPS, _REVIEWS, _SCORED, _SIDES, _closed, _lengths, _query, _reviewed, _right
from cuespark.functions.text import flexible_ms, folder_tags, listed, simplified, slug, window_ms, work_id
from cuespark.functions.timecode import format_srt, parse_srt
from cuespark.operators import activity, chunking, closure, matching, readability, recovery, reports, review, rules, stages, timeline
from cuespark.operators import tracks as track_files
from cuespark.plans.folders import scratch
from cuespark.plans.views import CUES, FILES, FRAMES, LINES, cues, doc_lines, files, frames, table
from cuespark.sources import audio_files, containers, cue_files, cue_source, documents, json_files
from cuespark.sources.reports import review_queue_markdown, table_markdown
from cuespark.streaming.resume import pending

if_ = F.expr
_NL = "chr(10)"


def _stamp(x: str, mark: str = ",") -> str:
    part = lambda e: f"lpad(({e})::VARCHAR, 2, '0')"
    return f"{part(f'{x} // 3600000')} || ':' || {part(f'{x} // 60000 % 60')} || ':' || {part(f'{x} // 1000 % 60')} || '{mark}' || lpad(({x} % 1000)::VARCHAR, 3, '0')"


def _timed(spark: SparkSession, d: str) -> DataFrame:
    """Cues with short texts of one line or two."""
    return cues(spark, d).withColumn("content", F.concat(F.substring(F.md5("content"), 1, 12), if_("if(pos % 3 = 0, '\\ntwo', '')")))


TIMED = CUES + f""", timed AS (SELECT file, pos, idx, start_ms, end_ms, substr(md5(content), 1, 12) || CASE WHEN pos % 3 = 0 THEN {_NL} || 'two' ELSE '' END AS content FROM cues)"""
_BLOCK = f"idx || {_NL} || {_stamp('start_ms')} || ' --> ' || {_stamp('end_ms')} || {_NL} || content"
_BLOCK_VTT = f"{_stamp('start_ms', '.')} || ' --> ' || {_stamp('end_ms', '.')} || {_NL} || content"


# --- sources and sinks


@_query(TIMED + f" SELECT file, md5(string_agg({_BLOCK}, {_NL} || {_NL} ORDER BY pos) || {_NL}) AS value FROM timed GROUP BY file")
def srt_texts(spark, d):
    return cue_files.to_texts(_timed(spark, d)).select("file", F.md5("value").alias("value"))


@_query(TIMED + f" SELECT file, md5('WEBVTT' || {_NL} || {_NL} || string_agg({_BLOCK_VTT}, {_NL} || {_NL} ORDER BY pos) || {_NL}) AS value FROM timed GROUP BY file")
def vtt_texts(spark, d):
    return cue_files.to_texts(_timed(spark, d), "vtt").select("file", F.md5("value").alias("value"))


@_query(TIMED + """ SELECT file, pos, idx, start_ms, end_ms, content, NULL::VARCHAR AS error FROM timed WHERE file % 5 <> 0 UNION ALL SELECT DISTINCT file, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR, 'parse_error' FROM timed WHERE file % 5 = 0""")
def srt_scan(spark, d):
    """Every fifth file is broken, every other one has other ends of lines, and most have lines of white space between cues."""
    spaced = if_(r"replace(value, '\n\n', element_at(array('\n\n', '\n　\n', '\n\u000c\n  \n'), int(file % 3) + 1))")
    value = if_(r"if(file % 5 = 0, replace(spaced, ' --> ', ' -> '), if(file % 2 = 1, replace(spaced, '\n', '\r\n'), spaced))")
    return cue_files.parse_srt_files(cue_files.to_texts(_timed(spark, d)).withColumn("spaced", spaced).withColumn("value", value))


@_query(TIMED + """ SELECT file % 3 || '/' || file AS file, pos, idx, start_ms, end_ms, content FROM timed WHERE file % 3 <> 0
UNION ALL SELECT '0/' || file, pos, pos, start_ms, end_ms, content FROM timed WHERE file % 3 = 0""")
def written_files(spark, d):
    """All cues written as files in folders, some of another kind, listed with their folders and read again."""
    cue_source.register(spark)
    rows = _timed(spark, d).withColumn("name", F.concat((F.col("file") % 3).cast("string"), F.lit("/"), F.col("file").cast("string")))
    folder = scratch(spark, "cues")
    back = None
    for kind, some in (("srt", "file % 3 <> 0"), ("vtt", "file % 3 = 0")):
        cue_source.written(rows.where(some).drop("file").withColumnRenamed("name", "file")).write.format(kind).mode("append").save(folder)
        read = spark.read.format(kind).option("recursive", True).load(folder)
        back = read if back is None else back.unionByName(read)
    return back.drop("error")


@_query(TIMED + f""", v AS (SELECT *, CASE WHEN pos % 5 = 0 THEN 'name' || {_NL} ELSE '' END || content AS told FROM timed)
SELECT file, row_number() OVER w AS pos, row_number() OVER w AS idx, start_ms, end_ms, told AS content, NULL::VARCHAR AS error FROM v WHERE pos % 4 <> 0 WINDOW w AS (PARTITION BY file ORDER BY pos)
UNION ALL SELECT file, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, told, 'bad_cue' FROM v WHERE pos % 4 = 0""")
def vtt_scan(spark, d):
    timing = F.concat(format_srt(F.col("start_ms"), "."), F.lit(" --> "), format_srt(F.col("end_ms"), "."), F.lit(" align:start"))
    block = F.concat_ws("\n", if_("if(pos % 5 = 0, 'name', null)"), F.when(F.col("pos") % 4 == 0, "xx --> yy").otherwise(timing), "content")
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("pos", block.alias("block")))), lambda x: x["block"])
    texts = _timed(spark, d).groupBy("file").agg(F.concat(F.lit("WEBVTT\n\n"), F.array_join(blocks, "\n\n"), F.lit("\n")).alias("value"))
    return cue_files.parse_vtt_files(texts)


@_query(TIMED + f""", texts AS (SELECT file, string_agg({_BLOCK}, {_NL} || {_NL} ORDER BY pos) AS v FROM timed GROUP BY file),
plain AS (SELECT file || CASE WHEN file % 4 = 1 THEN '.srt' ELSE '.txt' END AS file, string_split(CASE WHEN file % 4 = 1 THEN replace(v, ' --> ', ' -> ') ELSE v END, {_NL}) AS l FROM texts WHERE file % 4 IN (1, 3)),
vtt AS (SELECT file, pos, content, 3 + coalesce(sum(2 + len(string_split(content, {_NL}))) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM timed WHERE file % 4 = 2)
SELECT file || '.srt' AS file, NULL::BIGINT AS line, idx, content FROM timed WHERE file % 4 = 0
UNION ALL SELECT file, generate_subscripts(l, 1)::BIGINT, NULL::BIGINT, unnest(l) FROM plain
UNION ALL SELECT file || '.vtt', line::BIGINT, pos, content FROM vtt UNION ALL SELECT DISTINCT file || '.vtt', 1, NULL, 'WEBVTT' FROM vtt""")
def rule_texts(spark, d):
    """A quarter of the files each: SRT, broken SRT, VTT, plain text."""
    rows = _timed(spark, d)
    srt = cue_files.to_texts(rows).where("file % 4 <> 2").select(if_("file || if(file % 4 = 3, '.txt', '.srt')").alias("file"), if_("if(file % 4 = 1, replace(value, ' --> ', ' -> '), value)").alias("value"))
    vtt = cue_files.to_texts(rows.where("file % 4 = 2"), "vtt").select(if_("file || '.vtt'").alias("file"), "value")
    return documents.rule_texts(srt.unionByName(vtt)).select("file", "line", "idx", "content")


_WIDE = ("abcdefghijklmnopqrstuvwxyzéèàçüöäñóíáú", "ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺÉÈÀÇÜÖÄÑÓÍÁÚ")
_WIDE_LOW = "ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚéèàçüöäñóíáú"


@_query(LINES + f""", told AS MATERIALIZED (SELECT *, lower(content) AS low FROM (SELECT file, pos AS line, CASE WHEN pos % 2 = 0 THEN translate(content, '{_WIDE[0]}', '{_WIDE[1]}') ELSE content END AS content FROM lines)),
words AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[{_WIDE[0]}]{{5,}}')) AS w FROM benchmark),
rules AS MATERIALIZED (SELECT w AS rule, w AS plain, translate(w, '{_WIDE[0]}', '{_WIDE_LOW}') AS wide, 'says ' || w AS problem FROM words)
SELECT file, line, rule, unnest(regexp_extract_all(content, '(?i)' || plain || '|' || wide || '[ａ-ｚ]*')) AS matched, problem, 'drop' AS suggestion, 'benchmark' AS rules
FROM told JOIN rules ON contains(low, plain) OR contains(low, wide)""")
def rule_scan(spark, d):
    """Words of the benchmark as a rule table against all lines, every other one in capitals and full width."""
    plain, wide = _WIDE
    words = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(f"[{plain}]{{5,}}"), F.lit(0))).alias("name")).distinct()
    wide_low = F.translate("name", plain, _WIDE_LOW)
    rule = F.struct("name", F.concat("name", F.lit("|"), wide_low, F.lit("[ａ-ｚ]*")).alias("pattern"), F.concat(F.lit("says "), "name").alias("problem"), F.lit("drop").alias("suggestion"))
    tables = words.agg(F.array_sort(F.collect_list(rule)).alias("patterns")).select(F.lit("benchmark").alias("file"), F.to_json(F.struct(F.lit(1).alias("version"), "patterns")).alias("value"))
    texts = doc_lines(spark, d).select("file", F.col("pos").alias("line"), F.when(F.col("pos") % 2 == 0, F.translate("content", plain, wide)).otherwise(F.col("content")).alias("content"))
    return rules.findings(texts, json_files.rules(tables))


_PROBLEMS = ["漏译了", "幻觉 here", "术语不对", "人称", "标点", "过长", "错译", "nothing"]
_CLASSES = ["omission", "hallucination", "terminology", "role_tone", "formatting", "readability", "semantic", "semantic"]


@_query(CUES + f""", p AS (SELECT file || '.srt' AS file, idx, pos, CASE WHEN pos % 9 = 0 THEN '' ELSE {_PROBLEMS}[(pos % 8 + 1)::INT] END AS problem, CASE WHEN pos % 9 = 0 THEN '' ELSE 's' || pos % 2 END AS suggest, {_CLASSES}[(pos % 8 + 1)::INT] AS category FROM cues)
SELECT 'qc-' || substr(sha256(file || chr(31) || idx || chr(31) || problem || chr(31) || suggest), 1, 16) AS issue_id, file, idx, problem, suggest, category, CASE category WHEN 'formatting' THEN 'low' WHEN 'readability' THEN 'medium' ELSE 'high' END AS severity FROM p WHERE problem <> '' AND pos % 10 <> 0""")
def report_items(spark, d):
    """Reports of files with repeated, blank and misnumbered issues, and a value that is no list."""
    problem = F.when(F.col("pos") % 9 == 0, "").otherwise(F.array(*map(F.lit, _PROBLEMS))[(F.col("pos") % 8).cast("int")])
    issue = F.struct("pos", if_("if(pos % 10 = 0, 'x', string(idx))").alias("i"), problem.alias("problem"), if_("if(pos % 9 = 0, ' ', ' s' || pos % 2)").alias("suggest"))
    lists = cues(spark, d).groupBy("file").agg(F.collect_list(issue).alias("l"))
    return documents.review_items(lists.select(F.concat(F.lit('{"qc_pass": "deep", "'), F.col("file").cast("string"), F.lit('.srt": '), F.to_json(F.concat("l", "l")), F.lit("}")).alias("value")))


@_query(CUES + " SELECT file, pos FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY pos) AS k FROM cues WHERE file IN (SELECT DISTINCT file FROM cues ORDER BY file LIMIT 6)) WHERE k <= 3 AND trim(content) <> ''")
def sampled_cues(spark, d):
    return documents.sample_cues(cues(spark, d)).select("file", "pos")


@_query(r"""t AS (SELECT doc_id // 50 AS work, doc_id, list_filter(list_transform(string_split(coalesce(text, '') || chr(10) || '- ' || doc_id || ' -' || chr(10) || ' 1 2 ', chr(10)), lambda x: regexp_replace(x, '^[\s\pZ]+|[\s\pZ]+$', '', 'g')), lambda x: x <> '' AND NOT regexp_matches(x, '^-\s*\d+\s*-$') AND NOT regexp_matches(x, '^[\d\s]+$')) AS l FROM documents)
SELECT work, row_number() OVER (PARTITION BY work ORDER BY doc_id) AS page, md5(array_to_string(l, chr(10))) AS text FROM t WHERE len(l) > 0""")
def cleaned_pages(spark, d):
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\n- "), F.col("doc_id").cast("string"), F.lit(" -\n 1 2 "))
    pages = table(spark, d, "documents").select(if_("doc_id div 50").alias("work"), F.col("doc_id").alias("page"), text.alias("text"))
    return matching.clean_pages(pages).withColumn("text", F.md5("text"))


@_query("""s AS (SELECT user_id AS file, event_id, value AS s, CASE event_id % 3 WHEN 1 THEN value + 0.05::DOUBLE WHEN 2 THEN value + 2 END AS e, event_type FROM events WHERE event_type <> 'error')
SELECT file, row_number() OVER w AS pos, row_number() OVER w AS idx, round_even(s * 1000, 0)::BIGINT AS start_ms, round_even(greatest(s + 0.1::DOUBLE, coalesce(e, s + 1)) * 1000, 0)::BIGINT AS end_ms, 'a ' || event_type || ' b' AS content FROM s WINDOW w AS (PARTITION BY file ORDER BY event_id)""")
def segment_cues(spark, d):
    end = if_("CASE event_id % 3 WHEN 1 THEN value + 0.05D WHEN 2 THEN value + 2 END")
    text = if_("if(event_type = 'error', '  ', ' a \n ' || event_type || '  b ')")
    return cue_files.from_segments(table(spark, d, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("ord"), F.col("value").alias("start_s"), end.alias("end_s"), text.alias("text")))


@_query(TIMED + " SELECT to_json({'file': file, 'pos': pos, 'content': content})::VARCHAR AS line FROM timed")
def json_report(spark, d):
    return json_files.json_lines(_timed(spark, d), "file", "pos", "content")


@_query(TIMED + rf""" SELECT '| ' || file || ' | ' || pos || ' | ' || replace(replace(content, 'two', 't\|o'), {_NL}, ' ') || ' |' AS line FROM timed""")
def markdown_rows(spark, d):
    return table_markdown(_timed(spark, d).withColumn("content", F.replace("content", F.lit("two"), F.lit("t|o"))), "file", "pos", "content")


_QUEUE = _REVIEWS + """, q AS (SELECT e.issue_id, e.file, e.idx, e.category, CASE WHEN reason = '' THEN 'Evidence requires review.' ELSE reason END AS reason, level, evidence FROM e JOIN r USING (issue_id) WHERE decision = 'defer' OR (decision = 'accept' AND category = 'semantic' AND evidence = 'looks right'))"""


@_query(_QUEUE + " SELECT issue_id, file, idx, category, 'high' AS severity, reason, level AS evidence_level, evidence AS evidence_summary, 'audio_or_human_review' AS review_method FROM q")
def manual_queue(spark, d):
    return closure.manual_queue(_closed(spark, d))


@_query(_QUEUE + f""" SELECT '## ' || issue_id || ' / ' || coalesce(file, '') || ' #' || idx || {_NL} || {_NL} || '- Category/severity: ' || category || ' / high' || {_NL} || '- Required review: audio_or_human_review' || {_NL} || '- Reason: ' || reason
|| {_NL} || {_NL} || '**Source**' || {_NL} || {_NL} || evidence || {_NL} || {_NL} || '**Current**' || {_NL} || {_NL} || '(missing)' || {_NL} || {_NL} || '**Candidate**' || {_NL} || {_NL} || level || {_NL} AS section FROM q""")
def queue_sections(spark, d):
    queue = closure.manual_queue(_closed(spark, d)).withColumns({"source": F.col("evidence_summary"), "current": F.lit(None).cast("string"), "suggest": F.col("evidence_level")})
    return review_queue_markdown(queue).select("section")


@_query("n AS (SELECT p_partkey, 'f' || p_partkey || CASE WHEN p_size % 5 = 0 THEN '' ELSE '.srt' END AS name, CASE WHEN p_size % 5 = 0 THEN '' ELSE '.srt' END AS suffix, p_size % 4 AS k FROM part) SELECT name, CASE k WHEN 0 THEN name WHEN 1 THEN 'f' || p_partkey || '.bak1' || suffix ELSE 'f' || p_partkey || '.bak2' || suffix END AS backup FROM n")
def backup_names(spark, d):
    """Names of which none, the file itself, it and its first copy, or it, its first and third are there."""
    names = table(spark, d, "part").select(F.concat(F.lit("f"), "p_partkey").alias("stem"), if_("if(p_size % 5 = 0, '', '.srt')").alias("suffix"), if_("p_size % 4").alias("k"))
    there = names.select(F.explode(F.slice(F.array(F.concat("stem", "suffix"), F.concat("stem", F.lit(".bak1"), "suffix"), F.concat("stem", F.lit(".bak3"), "suffix")), F.lit(1), F.col("k"))).alias("name"))
    return reports.backup_names(names.select(F.concat("stem", "suffix").alias("name")), there)


_LISTED = """named AS (SELECT p_brand AS directory, p_brand || '/' || p_name || '/' || ['qc_report.json', 'a.ja.asr.srt', 'x.zh.vtt', 'Lesson 1.md', 'b.partial.json', 'Learning.txt', 'c.mp3', 'review_notes.MD'][p_partkey % 8 + 1] AS path, ['qc_report.json', 'a.ja.asr.srt', 'x.zh.vtt', 'Lesson 1.md', 'b.partial.json', 'Learning.txt', 'c.mp3', 'review_notes.MD'][p_partkey % 8 + 1] AS name FROM part)"""


def _listed(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, ["qc_report.json", "a.ja.asr.srt", "x.zh.vtt", "Lesson 1.md", "b.partial.json", "Learning.txt", "c.mp3", "review_notes.MD"]))
    return table(spark, d, "part").select(F.col("p_brand").alias("directory"), F.concat("p_brand", F.lit("/"), "p_name", F.lit("/"), names[(F.col("p_partkey") % 8).cast("int")]).alias("path"))


@_query(_LISTED + " SELECT path AS file, 'work_artifact_in_final_dir' AS code FROM named WHERE name IN ('qc_report.json', 'a.ja.asr.srt', 'b.partial.json') UNION ALL SELECT directory, 'no_final_subtitles' FROM named GROUP BY directory HAVING NOT bool_or(name = 'x.zh.vtt')")
def final_issues(spark, d):
    return reports.final_issues(_listed(spark, d))


@_query(_LISTED + """, w AS (SELECT DISTINCT CASE WHEN p_size % 5 = 0 THEN p_brand || '-final' ELSE p_brand END AS directory FROM part)
SELECT directory AS file, CASE WHEN directory LIKE '%-final' THEN 'missing_final_dir' ELSE 'no_final_subtitles' END AS code FROM w WHERE directory NOT IN (SELECT directory FROM named WHERE name = 'x.zh.vtt')""")
def wanted_finals(spark, d):
    """Folders that must be there; those that nothing is listed of are missing."""
    wanted = table(spark, d, "part").select(if_("if(p_size % 5 = 0, p_brand || '-final', p_brand)").alias("directory")).distinct()
    return reports.final_issues(_listed(spark, d).join(wanted, "directory", "left_semi"), allow_work=True, folders=wanted)


@_query(_LISTED + " SELECT path FROM named WHERE name IN ('Lesson 1.md', 'Learning.txt')")
def teaching_files(spark, d):
    return reports.teaching_files(_listed(spark, d)).select("path")


@_query(_LISTED + " SELECT count(*) FILTER (name = 'x.zh.vtt') AS finals, count(*) FILTER (name LIKE '%.json') AS reports FROM named")
def file_counts(spark, d):
    return reports.file_counts(_listed(spark, d), {"finals": r"\.zh\.(vtt|srt)$", "reports": r"\.json$"})


@_query(_LISTED + " SELECT path, CASE WHEN path LIKE 'Brand#1/%' THEN substr(path, 9) ELSE path END AS relative FROM named WHERE (name LIKE '%.srt' OR name LIKE '%.vtt' OR name LIKE '%.txt' OR lower(name) LIKE '%.md') AND (path GLOB 'Brand#[1-3]*' OR name GLOB 'L*.txt') AND NOT (path GLOB '*/small*' OR name GLOB '?.zh.vtt')")
def globbed_files(spark, d):
    kept = json_files.in_globs(_listed(spark, d), ["Brand#[1-3]*", "L*.txt"], ["*/small*", "?.zh.vtt"])
    return kept.select("path", json_files.relative(F.col("path"), "Brand#1").alias("relative"))


# --- JSON


@_query("p AS (SELECT event_id, CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 6 = 1 THEN '[1]' ELSE props END AS v FROM events) SELECT event_id AS file, coalesce(CASE WHEN v LIKE '{%' THEN json_extract_string(v, '$.k')::BIGINT END, -1) AS k, 'none' AS name FROM p")
def json_documents(spark, d):
    texts = table(spark, d, "events").select(F.col("event_id").alias("file"), if_("CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 6 = 1 THEN '[1]' ELSE props END").alias("value"))
    return json_files.documents(texts, "struct<k:long,name:string>", {"k": -1, "name": "none"})


@_query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang WHEN doc_id % 5 = 0 THEN source ELSE 'x' END AS value, CASE WHEN doc_id % 3 = 0 AND lang IS NOT NULL THEN 0 WHEN doc_id % 5 = 0 AND source IS NOT NULL THEN 1 ELSE 2 END AS candidate FROM documents".replace("SELECT", "q AS (SELECT 1) SELECT", 1))
def first_found(spark, d):
    docs = table(spark, d, "documents")
    value = lambda e: docs.select("doc_id", if_(e).alias("value"))
    return json_files.first_found([value("if(doc_id % 3 = 0, lang, null)"), value("if(doc_id % 5 = 0, source, null)"), value("'x'")], "doc_id", "value")


@_query(CUES + " SELECT file, CASE file % 3 WHEN 0 THEN 2 * count(*) WHEN 1 THEN count(*) END::INT AS n FROM cues GROUP BY file")
def json_item_counts(spark, d):
    rows = cues(spark, d).groupBy("file").agg(F.to_json(F.collect_list(F.struct("pos", "content"))).alias("l"))
    value = F.when(F.col("file") % 3 == 0, F.concat(F.lit('{"a": '), "l", F.lit(', "note": "[text", "b": '), "l", F.lit("}"))).when(F.col("file") % 3 == 1, F.col("l")).otherwise("no JSON")
    return rows.select("file", json_files.item_count(value).alias("n"))


@_query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name || ',b' WHEN 1 THEN c_name || ',c' WHEN 2 THEN 'm,' || c_name ELSE '' END AS ids FROM customer".replace("SELECT", "q AS (SELECT 1) SELECT", 1))
def model_ids(spark, d):
    reply = if_("""CASE c_custkey % 4 WHEN 0 THEN '{"data": [{"id": "' || c_name || '"}, {"id": ""}, "b"]}' WHEN 1 THEN '{"models": [{"name": "' || c_name || '", "id": "z"}, {"id": "c"}]}' WHEN 2 THEN '{"models": ["m", "' || c_name || '"]}' ELSE 'busy' END""")
    return table(spark, d, "customer").select("c_custkey", F.array_join(json_files.model_ids(reply), ",").alias("ids"))


@_query("""r AS (SELECT p_brand AS file, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS k, p_name AS name, CASE WHEN p_size % 10 = 0 THEN '(' ELSE p_type END AS pattern, CASE WHEN p_size % 7 = 0 THEN '' ELSE 'p' END AS problem FROM part),
x AS (SELECT *, row_number() OVER (PARTITION BY file, name ORDER BY k) > 1 AS again FROM r) SELECT file, k, unnest(list_filter([CASE WHEN problem = '' THEN 'missing:problem' END, CASE WHEN again THEN 'duplicate_name' END, CASE WHEN pattern = '(' THEN 'invalid_regex' END], lambda e: e IS NOT NULL)) AS error FROM x""")
def rule_errors(spark, d):
    return json_files.rule_errors(json_files.rules(_rule_tables(spark, d)))


def _rule_tables(spark: SparkSession, d: str) -> DataFrame:
    rule = F.struct("p_partkey", F.struct(F.concat(F.lit(" "), "p_name").alias("name"), if_("if(p_size % 10 = 0, '(', p_type)").alias("pattern"), if_("if(p_size % 7 = 0, ' ', 'p')").alias("problem"), F.lit("s").alias("suggestion")).alias("r"))
    tables = table(spark, d, "part").groupBy(F.col("p_brand").alias("file")).agg(F.transform(F.array_sort(F.collect_list(rule)), lambda x: x["r"]).alias("patterns"))
    return tables.select("file", F.to_json(F.struct(F.lit(1).alias("version"), "patterns")).alias("value"))


@_query("SELECT p_brand AS file, p_name AS name, count(*) AS times FROM part GROUP BY ALL HAVING count(*) > 1".replace("SELECT", "q AS (SELECT 1) SELECT", 1))
def duplicate_rules(spark, d):
    return json_files.duplicate_names(json_files.rules(_rule_tables(spark, d)))


@_query("SELECT p_partkey AS file, ['not_an_object', 'bad_version', 'no_patterns'][p_partkey % 4 + 1] AS error FROM part WHERE p_partkey % 4 <> 3".replace("SELECT", "q AS (SELECT 1) SELECT", 1))
def rule_table_errors(spark, d):
    value = if_("""element_at(array('[1]', '{"version": 2}', '{"version": 1, "patterns": []}', '{"version": 1, "patterns": [{"name": "' || p_name || '"}]}'), int(p_partkey % 4) + 1)""")
    return json_files.table_errors(table(spark, d, "part").select(F.col("p_partkey").alias("file"), value.alias("value")))


# --- texts and times


@_query("t AS (SELECT o_orderkey, (o_orderkey * 7919) % 90000000 AS ms FROM orders) SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN ms - ms % 100 ELSE ms END AS ms FROM t")
def srt_times(spark, d):
    """Times with one digit of a fraction or three, a point or a comma, and some that are none."""
    ms = (F.col("o_orderkey") * 7919) % 90_000_000
    told = format_srt(ms, ",")
    value = F.when(F.col("o_orderkey") % 9 == 0, "1:2").when(F.col("o_orderkey") % 4 == 0, F.substring(told, 1, 10)).when(F.col("o_orderkey") % 2 == 0, F.translate(told, ",", ".")).otherwise(told)
    return table(spark, d, "orders").select("o_orderkey", parse_srt(value).alias("ms"))


@_query("t AS (SELECT o_orderkey AS k FROM orders) SELECT k, CASE k % 5 WHEN 0 THEN k * 1000 WHEN 1 THEN (k * 60 + 2) * 1000 + 500 WHEN 2 THEN k * 3600000 + 120000 + 3250 END AS ms, (CASE WHEN k % 3 = 0 THEN 1000 END)::BIGINT AS start_ms, CASE WHEN k % 3 = 0 THEN 60000 * (k + 1) END AS end_ms FROM t")
def flexible_times(spark, d):
    k = F.col("k")
    value = if_("CASE k % 5 WHEN 0 THEN k || '' WHEN 1 THEN k || ':2,5' WHEN 2 THEN k || ':02:03.25' WHEN 3 THEN 'x' ELSE '' END")
    window = if_("CASE k % 3 WHEN 0 THEN '1-' || (k + 1) || ':00' WHEN 1 THEN (k + 5) || '-' || k ELSE 'none' END")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k")).select(k, flexible_ms(value).alias("ms"), window_ms(window)["start_ms"].alias("start_ms"), window_ms(window)["end_ms"].alias("end_ms"))


@_query("""t AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'work rj' || (100000 + c_custkey) || ' / x' WHEN 1 THEN 'ARJ' || (100000 + c_custkey) ELSE 'RJ12' END AS t, c_name FROM customer)
SELECT c_custkey, nullif(upper(regexp_extract(t, '(?i)\\b(RJ\\d{6,10})\\b', 1)), '') AS bounded, nullif(upper(regexp_extract(t, '(?i)(RJ\\d{6,10})', 1)), '') AS loose, regexp_replace(t || '*' || c_name, '[^\\pL\\pN._-]+', '_', 'g') AS slug FROM t""".replace("\\\\", "\\"))
def work_ids(spark, d):
    text = if_("CASE c_custkey % 3 WHEN 0 THEN 'work rj' || (100000 + c_custkey) || ' / x' WHEN 1 THEN 'ARJ' || (100000 + c_custkey) ELSE 'RJ12' END")
    return table(spark, d, "customer").select("c_custkey", work_id(text).alias("bounded"), work_id(text, False).alias("loose"), slug(F.concat(text, F.lit("*"), "c_name")).alias("slug"))


@_query("SELECT doc_id, array_to_string(list_filter([trim(lang), trim(source), 'a b'], lambda x: x IS NOT NULL), '|') AS parts FROM documents".replace("SELECT", "q AS (SELECT 1) SELECT", 1))
def listed_values(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(listed(F.concat_ws(",", "lang", F.lit(" "), "source", F.lit("; a b \n"))), "|").alias("parts"))


@_query(CUES + """, t AS (SELECT file, pos, CASE WHEN pos % 2 = 0 THEN repeat('あんっ ', (30 + idx)::INT) WHEN pos % 5 = 0 THEN repeat('ab ', 80) ELSE content END AS content FROM cues),
p AS (SELECT *, regexp_replace(content, '[\\s\\pZ]+', '', 'g') AS packed FROM t),
h AS (SELECT *, string_split(packed, '') AS cs, list_distinct(string_split(packed, '')) AS ds FROM p)
SELECT file, pos, md5(CASE WHEN length(packed) >= 100 AND regexp_matches(packed, '[んあぁはハアぅうっッ♡アア青]') AND (len(ds) <= 12 OR list_max(list_transform(ds, lambda c: len(list_filter(cs, lambda x: x = c)))) > 0.45 * length(packed)) THEN 'NOISE' ELSE content END) AS content FROM h""".replace("\\\\", "\\"))
def simplified_texts(spark, d):
    text = if_("CASE WHEN pos % 2 = 0 THEN repeat('あんっ ', int(30 + idx)) WHEN pos % 5 = 0 THEN repeat('ab ', 80) ELSE content END")
    return cues(spark, d).select("file", "pos", F.md5(simplified(text, "NOISE")).alias("content"))


@_query(TIMED + f""" SELECT file, pos, md5('{{"i":' || idx || ',"start":"' || {_stamp('start_ms')} || '","end":"' || {_stamp('end_ms')} || '","text":"' || replace(content, {_NL}, '\\n') || '"}}') AS item FROM timed""")
def payload_rows(spark, d):
    return stages.payload(_timed(spark, d)).select("file", "pos", F.md5(F.to_json("item")).alias("item"))


_TERMS = ["the", "tion", "the", "qu"]


@_query(CUES + """, t AS (SELECT file, pos, content || CASE pos % 4 WHEN 1 THEN ' ???' WHEN 2 THEN ' □' ELSE '' END AS content, CASE pos % 3 WHEN 0 THEN 'a' || chr(10) || 'b' WHEN 1 THEN 'かな' ELSE 'x' END AS zh FROM cues)
SELECT file, pos, (""" + " + ".join(f"contains(content, '{t}')::INT" for t in _TERMS) + " + (length(content) > 140)::INT + 2 * (contains(content, '???') OR contains(content, '□'))::INT + contains(zh, chr(10))::INT + contains(zh, 'か')::INT)::BIGINT AS score FROM t")
def risk_of_pairs(spark, d):
    rows = cues(spark, d).select("file", "pos", if_("content || CASE pos % 4 WHEN 1 THEN ' ???' WHEN 2 THEN ' □' ELSE '' END").alias("content"), if_("CASE pos % 3 WHEN 0 THEN 'a\nb' WHEN 1 THEN 'かな' ELSE 'x' END").alias("zh"))
    return readability.risk_score(rows, _TERMS)


# --- default limits


_BRIEF = CUES + """, brief AS (SELECT file, pos, idx, start_ms, start_ms + CASE WHEN pos % 4 = 0 THEN 120 WHEN pos % 4 = 1 THEN 119 ELSE 2000 END AS end_ms, substr(content, 1, (38 + pos % 12)::INT) AS content FROM cues)"""


def _brief(spark: SparkSession, d: str) -> DataFrame:
    return cues(spark, d).withColumns({"end_ms": if_("start_ms + CASE WHEN pos % 4 = 0 THEN 120 WHEN pos % 4 = 1 THEN 119 ELSE 2000 END"), "content": if_("substr(content, 1, int(38 + pos % 12))")})


_CHARS = r"length(regexp_replace({}, '[\s\pZ.,!?;:\"''()\[\]{{}}\-…、。！？「」『』（）]', '', 'g'))"


@_query(_BRIEF + ", c AS (SELECT *, " + _CHARS.format("content") + " AS chars, string_split(content, chr(10)) AS l FROM brief) SELECT file, pos, idx, unnest(list_filter([CASE WHEN chars > 42 THEN 'too_many_chars' END, CASE WHEN chars / greatest(0.001, (end_ms - start_ms) / 1000) > 10 THEN 'high_cps' END, CASE WHEN len(l) > 2 THEN 'too_many_lines' END, CASE WHEN len(list_filter(l, lambda x: " + _CHARS.format("x") + " > 24)) > 0 THEN 'line_too_long' END], lambda x: x IS NOT NULL)) AS code FROM c")
def readability_defaults(spark, d):
    return readability.warnings(_brief(spark, d)).where("code <> 'dense_repeated_sound'")


@_query("""o AS (SELECT l_orderkey AS file, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos, [0, 1, 119, 120, 121, 500, 501, 2000][(l_partkey % 8 + 1)::INT] AS over, [119, 120, 240, 3000][(l_suppkey % 4 + 1)::INT] AS dur FROM lineitem),
c AS (SELECT file, pos, pos * 10000 - over AS start_ms, (pos + 1) * 10000 - CASE WHEN pos % 5 = 0 THEN 10000 - dur ELSE 0 END AS end_ms FROM o),
s AS (SELECT *, lag(start_ms) OVER w AS ls, lag(end_ms) OVER w AS le FROM c WINDOW w AS (PARTITION BY file ORDER BY pos)), k AS (SELECT *, coalesce(le - start_ms, 0) AS o FROM s)
SELECT file, pos, greatest(o, 0)::BIGINT AS overlap_ms, CASE WHEN start_ms >= end_ms OR coalesce(ls >= le, false) THEN 'invalid' WHEN o <= 0 THEN 'ok' WHEN o <= 120 AND start_ms - ls >= 120 THEN 'minor' WHEN o <= 120 THEN 'too_short' WHEN o <= 500 THEN 'moderate' ELSE 'severe' END AS kind FROM k""")
def overlap_defaults(spark, d):
    return timeline.overlap_classes(_lines(spark, d)).select("file", "pos", "overlap_ms", "kind")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order as cues whose overlaps stand at the limits."""
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), pos.cast("long").alias("pos"), if_("element_at(array(0, 1, 119, 120, 121, 500, 501, 2000), int(l_partkey % 8) + 1)").alias("over"), if_("element_at(array(119, 120, 240, 3000), int(l_suppkey % 4) + 1)").alias("dur"))
    return rows.select("file", "pos", F.col("pos").alias("idx"), if_("pos * 10000 - over").alias("start_ms"), if_("(pos + 1) * 10000 - if(pos % 5 = 0, 10000 - dur, 0)").alias("end_ms"), F.lit("x").alias("content"))


@_query(CUES + """, b AS (SELECT file, pos, idx, pos * 1000 AS start_ms, pos * 1000 + 1000 - CASE WHEN pos % 9 = 0 THEN 351 ELSE 350 END AS end_ms, substr('abcde', 1, CASE WHEN length(content) % 11 = 0 THEN 5 ELSE 4 END) AS content FROM cues),
g AS (SELECT *, (length(content) <= 4)::INT AS short, lead(start_ms) OVER (PARTITION BY file ORDER BY pos) - end_ms AS gap FROM b),
w AS (SELECT *, min(short) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS s, count(*) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS n, max(gap) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS most FROM g)
SELECT file, pos, idx FROM w WHERE s = 1 AND n = 4 AND most <= 350""")
def short_runs_defaults(spark, d):
    rows = cues(spark, d).withColumns({"start_ms": if_("pos * 1000"), "end_ms": if_("pos * 1000 + 1000 - if(pos % 9 = 0, 351, 350)"), "content": if_("substr('abcde', 1, if(length(content) % 11 = 0, 5, 4))")})
    return readability.short_runs(rows)


# --- tracks


@_query(FILES + """, w AS (SELECT track_key, path, duration_s FROM files WHERE without AND extension = 'wav'), m AS (SELECT f.track_key, f.path, f.duration_s FROM files f JOIN (SELECT p_partkey, p_size FROM part) p ON split_part(f.path, '/', 2) = p.p_partkey::VARCHAR WHERE f.extension = 'mp3' AND p.p_size * 20000 >= 262144)
SELECT w.track_key AS scope_key, w.path, min(m.path) AS substitute FROM w JOIN m ON m.track_key = w.track_key WHERE w.duration_s IS NOT NULL AND (m.duration_s IS NULL OR abs(w.duration_s - m.duration_s) / greatest(w.duration_s, m.duration_s) <= 0.02::DOUBLE) GROUP BY ALL""")
def wav_substitutes(spark, d):
    rows = track_files.described(files(spark, d))
    return track_files.substitutes(rows.where("category = 'no_se' AND extension = 'wav'").select("scope_key", "path", "duration_s"), rows)


@_query("n AS (SELECT p_partkey, lower(p_brand || [' no se', ' main', ' EX', ' Trial', ' bgm', ''][p_partkey % 6 + 1]) AS p FROM part), t AS (SELECT p_partkey, list_filter([CASE WHEN contains(p, 'no se') THEN 'no_se' END, CASE WHEN contains(p, 'main') THEN 'main_candidate' END, CASE WHEN contains(p, 'ex') THEN 'bonus_or_extra' END, CASE WHEN contains(p, 'trial') THEN 'trial_or_promo' END, CASE WHEN contains(p, 'bgm') THEN 'se_or_bgm_candidate' END], lambda x: x IS NOT NULL) AS tags FROM n) SELECT p_partkey, CASE WHEN len(tags) = 0 THEN 'audio' ELSE array_to_string(tags, ',') END AS tags FROM t")
def folder_tag_lists(spark, d):
    path = F.concat("p_brand", if_("element_at(array(' no se', ' main', ' EX', ' Trial', ' bgm', ''), int(p_partkey % 6) + 1)"))
    return table(spark, d, "part").select("p_partkey", F.array_join(folder_tags(path), ",").alias("tags"))


@_query(FILES + ", c AS (SELECT DISTINCT p_brand FROM part WHERE p_size = 7) SELECT path FROM files WHERE directory IN (SELECT p_brand FROM c)")
def scoped_files(spark, d):
    chosen = table(spark, d, "part").where("p_size = 7").select(F.concat(F.lit("./"), "p_brand").alias("value"))
    return track_files.in_scope(files(spark, d), "selected_dirs", chosen).select("path")


@_query("s AS (SELECT p_name || p_partkey AS track_key, 'no/' || p_partkey AS path, p_size % 4 = 0 AS requires_review, ['a/' || p_brand, 'b/' || p_size] AS c FROM part), x AS (SELECT track_key, path, unnest(c) AS counterpart FROM s WHERE NOT requires_review) SELECT counterpart, arg_max(path, track_key) AS path FROM x GROUP BY counterpart")
def preferred_sources(spark, d):
    chosen = table(spark, d, "part").select(if_("p_name || p_partkey").alias("track_key"), if_("'no/' || p_partkey").alias("path"), if_("p_size % 4 = 0").alias("requires_review"), if_("array('a/' || p_brand, 'b/' || p_size)").alias("counterparts"))
    return track_files.preferred_of(chosen)


_WAVS = "w AS (SELECT s_suppkey AS file, 800 + (s_suppkey * 37) % 900 AS n, 10 + s_suppkey % 90 AS l, (s_suppkey * 7) % 200 AS r FROM supplier)"


def _wavs(spark: SparkSession, d: str) -> DataFrame:
    """Recordings of one constant level on each side, 1000 samples a second; every fourth is none."""
    le = lambda x, n: F.concat(*[F.substring(F.lpad(F.hex(x), 2 * n, "0"), 2 * (n - k) - 1, 2) for k in range(n)])
    w = table(spark, d, "supplier").select(F.col("s_suppkey").alias("file"), if_("800 + (s_suppkey * 37) % 900").alias("n"), if_("10 + s_suppkey % 90").alias("l"), if_("(s_suppkey * 7) % 200").alias("r"))
    form = "57415645666d7420100000000100" + "0200" + "e8030000" + "a00f0000" + "0400" + "1000" + "64617461"
    body = F.concat(F.lit("52494646"), le(F.col("n") * 4 + 36, 4), F.lit(form), le(F.col("n") * 4, 4), F.repeat(F.concat(le(F.col("l"), 2), le(F.col("r"), 2)), F.col("n").cast("int")))
    return w.select(F.col("file").cast("string").alias("path"), F.when(F.col("file") % 4 == 3, F.lit("none").cast("binary")).otherwise(F.unhex(body)).alias("content"))


@_query(_WAVS + " SELECT file::VARCHAR AS path, CASE WHEN file % 4 <> 3 THEN n / 1000 END AS duration_s FROM w")
def wav_durations(spark, d):
    return audio_files.wav_durations(_wavs(spark, d))


@_query("""p AS (SELECT p_partkey AS k, row_number() OVER (ORDER BY p_partkey) AS n FROM part)
SELECT k::VARCHAR AS path, CASE k % 5 WHEN 0 THEN (k * 100 + 1) / 44100 WHEN 1 THEN (k * 10) / 1000 WHEN 2 THEN (k + 1) * 1152 / 44100 WHEN 3 THEN (k * 7 + 312 - 312) / 48000 END AS duration_s FROM p""")
def container_durations(spark, d):
    """FLAC, MP4 with its index amid up to 160 KiB, MPEG audio with counted frames, Opus in Ogg, and text."""
    k = F.col("p_partkey")
    big = lambda n, size: F.lpad(F.hex(n.cast("long")), 2 * size, "0")
    little = lambda n, size: F.concat(*[F.lpad(F.hex(F.shiftright(n.cast("long"), 8 * i) % 256), 2, "0") for i in range(size)])
    zeros = lambda n: F.lit("00" * n)
    flac = F.concat(F.lit("664c614300000022"), zeros(10), F.lit("0ac442f0"), big(k * 100 + 1, 4), zeros(16))
    mvhd = F.concat(F.lit("0000006c6d766864"), zeros(12), F.lit("000003e8"), big(k * 10, 4), zeros(80))
    body = lambda name, byte: F.when(k % 50 == 1, F.concat(F.lit("00014008" + name), F.repeat(F.lit(byte), 0x14000))).otherwise("00000108" + name + byte * 256)
    mp4 = F.concat(F.lit("00000010667479704d34412000000000"), body("6d646174", "11"), F.lit("000000746d6f6f76"), mvhd, body("66726565", "00"))
    frame = F.lit("fffb9000" + "00" * 413)
    mp3 = F.concat(F.lit("fffb9000" + "00" * 32 + "58696e6700000001"), big(k + 1, 4), zeros(417 - 48), frame)
    page = lambda granule, body: F.concat(F.lit("4f67675300" + "00"), granule, F.lit("07000000" + "00" * 8 + "0113"), F.lit(body))
    opus = F.concat(page(zeros(8), "4f707573486561640102" + "3801" + "00" * 7), page(little(k * 7 + 312, 8), "00" * 19))
    kinds = F.when(k % 5 == 0, flac).when(k % 5 == 1, mp4).when(k % 5 == 2, mp3).when(k % 5 == 3, opus).otherwise(F.hex(F.lit("no audio, words only")))
    return containers.durations(table(spark, d, "part").select(k.cast("string").alias("path"), F.unhex(kinds).alias("content")))


@_query(_WAVS + ", f AS (SELECT *, unnest(range(0, ceil(n / 500)::BIGINT)) AS k FROM w WHERE file % 4 <> 3) SELECT file::VARCHAR AS file, k + 1 AS pos, k / 2 AS start_s, least(n, (k + 1) * 500) / 1000 AS end_s, l::INT AS left_rms, r::INT AS right_rms FROM f")
def wav_frames(spark, d):
    return audio_files.frames(_wavs(spark, d)).select("file", "pos", "start_s", "end_s", F.col("left_rms").cast("int").alias("left_rms"), F.col("right_rms").cast("int").alias("right_rms"))


@_query(_SCORED + """, q AS (SELECT *, active::INT * 1.0 + CASE state WHEN 'none' THEN 1.25 WHEN 'weak' THEN 0.9 ELSE -0.5 END + CASE WHEN sided THEN 0.75 WHEN active THEN 0.3 ELSE 0 END + CASE WHEN level >= threshold + 8 THEN 0.4 ELSE 0 END AS score FROM z WHERE active AND (state <> 'strong' OR abs(left_db - right_db) >= 5)),
b AS (SELECT *, sum(CASE WHEN pos = lp + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY file ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(pos) OVER (PARTITION BY file ORDER BY pos) AS lp FROM q)),
g AS (SELECT file, run, min(start_s)::DOUBLE AS start_s, avg((state <> 'strong')::INT) AS u, round(avg(score)::DOUBLE + 0.6::DOUBLE * avg((state <> 'strong')::INT) + 0.4::DOUBLE, 9) AS trust FROM b GROUP BY file, run HAVING max(end_s) - min(start_s) >= 1)
SELECT file, start_s, CASE WHEN trust >= 2.7 AND u >= 0.6 THEN 'high' ELSE 'medium' END AS confidence FROM g WHERE trust >= 1.8""")
def confident_candidates(spark, d):
    seen = activity.scored(activity.coverage(frames(spark, d), cues(spark, d)))
    return activity.at_least(activity.candidates(seen), "medium").select("file", "start_s", "confidence")


@_query(FRAMES + r""", c AS (SELECT *, regexp_replace(content, '[\s\pZ]+', '', 'g') AS t, (end_ms - start_ms) / 1000 AS s FROM cues), v AS (SELECT *, length(t) = 0 OR (s >= 2.5 AND length(t) <= 4) OR (s >= 4 AND length(t) / s <= 1) AS weak FROM c),
m AS (SELECT f.file, f.pos, bool_and(weak) AS all_weak, list({p: v.pos, w: weak, t: t} ORDER BY v.pos) AS l FROM frames f JOIN v ON f.file = v.file AND v.start_ms / 1000 < f.end_s AND v.end_ms / 1000 > f.start_s GROUP BY ALL)
SELECT f.file, f.pos, md5(coalesce(substr(array_to_string(list_transform(list_filter(l, lambda x: all_weak OR NOT x.w), lambda x: x.t), ' / '), 1, 120), '')) AS heard FROM frames f LEFT JOIN m ON m.file = f.file AND m.pos = f.pos""")
def heard_texts(spark, d):
    return activity.coverage(frames(spark, d), cues(spark, d)).select("file", "pos", F.md5("heard").alias("heard"))


# --- review and repair


@_query(CUES + _SIDES.replace("AS end_ms FROM", "AS end_ms, content FROM") + """, j AS (SELECT coalesce(c.file, r.file) AS file, c.idx, r.idx AS ri, c.start_ms, r.start_ms AS rs, c.end_ms, r.end_ms AS re, c.file AS l, r.file AS rf FROM cues c FULL JOIN r ON c.file = r.file AND c.pos = r.pos),
t AS (SELECT file, CASE WHEN count(l) = 0 THEN 'only_right' WHEN count(rf) = 0 THEN 'missing_translation' WHEN count(l) <> count(rf) OR count(*) <> count(l) THEN 'count_mismatch' WHEN bool_or(idx <> ri) THEN 'pair_index_mismatch' WHEN bool_or(start_ms <> rs OR end_ms <> re) THEN 'pair_timeline_mismatch' END AS code FROM j GROUP BY file)
SELECT file, 'bad' AS kind, code, 0::BIGINT AS pos FROM t WHERE code <> 'only_right' UNION ALL SELECT cues.file, 'pair', NULL, pos FROM cues JOIN t ON t.file = cues.file WHERE code IS NULL""")
def strict_pairs(spark, d):
    rows = cues(spark, d)
    right = _right(rows).withColumn("pos", if_("if(pos >= 1000, pos - 1000, pos)")).withColumn("pos", if_("if(pos % 11 = 0, pos + 1000, pos)"))
    pairs, bad = review.strict_pairs(rows, right)
    return bad.select("file", F.lit("bad").alias("kind"), "code", F.lit(0).cast("long").alias("pos")).unionByName(pairs.select("file", F.lit("pair").alias("kind"), F.lit(None).cast("string").alias("code"), "pos"))


_ALLOWED = _REVIEWS + """, x AS (SELECT r.issue_id, e.issue_id AS ei, e.file, e.idx, decision = 'accept' AND category = 'semantic' AND evidence = 'looks right' AS put_off, reason = '' OR level = 'insufficient' AS failed, level FROM r LEFT JOIN e USING (issue_id) WHERE decision = 'accept')"""


@_query(_ALLOWED + """ SELECT issue_id, CASE WHEN ei IS NULL THEN 'not_in_closure' WHEN put_off OR failed THEN 'not_authorised' WHEN issue_id % 13 = 0 THEN 'other_file' WHEN issue_id % 17 = 0 THEN 'other_index' WHEN issue_id % 19 = 0 THEN 'other_replacement' END AS refusal FROM x""")
def authorisations(spark, d):
    """Reviews that were edited after the closure: another file, index or text."""
    closed = _closed(spark, d)
    its = closed.select("issue_id", F.col("file").alias("f"), F.col("idx").alias("x"))
    edited = _reviewed(spark, d).drop("file", "idx").join(its, "issue_id", "left").withColumns({"file": if_("if(issue_id % 13 = 0, 'other', f)"), "idx": if_("if(issue_id % 17 = 0, x + 1, x)"), "replacement": if_("if(issue_id % 19 = 0, 'newer', replacement)")}).drop("f", "x")
    return closure.authorised(edited, closed).select("issue_id", "refusal")


@_query(_REVIEWS + """, j AS (SELECT e.issue_id AS ei, r.issue_id AS ri, decision, category, evidence, decision = 'accept' AND category = 'semantic' AND evidence = 'looks right' AS put_off, reason = '' OR (decision = 'accept' AND level = 'insufficient') OR decision = 'defer' AS failed FROM e FULL JOIN r USING (issue_id)),
s AS (SELECT CASE WHEN ri IS NULL THEN 'unresolved' WHEN ei IS NULL THEN 'unknown' WHEN put_off OR decision = 'defer' THEN 'deferred' WHEN decision = 'accept' AND NOT failed THEN 'ready_to_apply' WHEN decision = 'reject' AND NOT failed THEN 'rejected' ELSE 'invalid' END AS status, ei IS NOT NULL AND ri IS NOT NULL AND (put_off OR decision = 'defer') AS manual FROM j)
SELECT 'fail' AS result, count(*) FILTER (status <> 'unknown') AS total, count(*) FILTER (status = 'ready_to_apply') AS ready_to_apply, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'deferred') AS deferred, count(*) FILTER (status = 'invalid') AS invalid, count(*) FILTER (status = 'unresolved') AS unresolved, count(*) FILTER (status = 'unknown') AS unknown, count(*) FILTER (manual) AS manual_review FROM s""")
def closure_summary(spark, d):
    return closure.summary(_closed(spark, d))


_UPDATES = CUES + """, u AS (SELECT file, idx, CASE WHEN file % 5 = 0 AND idx = 2 THEN 'other' ELSE '' END AS cur, CASE WHEN idx % 3 = 0 THEN 'new ' || idx ELSE content END AS rep FROM cues),
ok AS (SELECT u.file, bool_and(trim(cur) = '' AND regexp_replace(rep, '[\\s\\pZ]+', '', 'g') <> '') AS ok FROM u GROUP BY u.file)""".replace("\\\\", "\\")


def _updates(rows: DataFrame) -> DataFrame:
    return rows.select("file", "idx", if_("if(file % 5 = 0 AND idx = 2, 'other', '')").alias("current"), if_("if(idx % 3 = 0, 'new ' || idx, content)").alias("replacement"))


@_query(_UPDATES + " SELECT cues.file, pos, md5(CASE WHEN ok AND idx % 3 = 0 THEN 'new ' || idx ELSE content END) AS content FROM cues JOIN ok ON ok.file = cues.file")
def updated_cues(spark, d):
    rows = cues(spark, d)
    return review.updated_cues(rows, _updates(rows)).select("file", "pos", F.md5("content").alias("content"))


@_query(_UPDATES + " SELECT cues.file, NOT bool_or(ok AND idx % 3 = 0 AND idx > 6) AS within FROM cues JOIN ok ON ok.file = cues.file GROUP BY cues.file")
def changes_within(spark, d):
    """Whether only the first six cues of a file changed."""
    rows = cues(spark, d)
    return review.changed_within(rows, review.updated_cues(rows, _updates(rows)), rows.where("idx <= 6").select("file", "idx"))


_REPAIR = CUES + """, s AS (SELECT *, lag(start_ms) OVER w AS ls, lag(end_ms) OVER w AS le FROM cues WINDOW w AS (PARTITION BY file ORDER BY pos)),
k AS (SELECT file, coalesce(le - start_ms, 0) > 0 OR start_ms >= end_ms AS issue, coalesce(le - start_ms, 0) BETWEEN 1 AND 300 AND start_ms - ls >= 120 AND start_ms < end_ms AS fixable FROM s),
f AS (SELECT file, count(*) FILTER (issue) AS issues, count(*) FILTER (fixable) AS fixable, file % 3 = 0 AS zh FROM k GROUP BY file),
st AS (SELECT file, CASE WHEN issues = 0 THEN 'ok' WHEN zh THEN 'blocked_by_existing_zh' WHEN fixable > 0 THEN 'fixed' ELSE 'needs_review' END AS status, issues, CASE WHEN zh THEN 0 ELSE fixable END AS fixed FROM f)"""


def _repairs(spark: SparkSession, d: str) -> DataFrame:
    rows = cues(spark, d)
    return timeline.repair_status(rows, rows.select(if_("file + if(file % 3 = 0, 0, 1000000)").alias("file")), minor_ms=300)


@_query(_REPAIR + " SELECT file, status, issues, fixed FROM st")
def repair_statuses(spark, d):
    return _repairs(spark, d)


@_query(_REPAIR + " SELECT count(*) AS files, sum(issues)::BIGINT AS issues, sum(fixed)::BIGINT AS fixed, sum(issues - fixed)::BIGINT AS not_fixed, count(*) FILTER (status = 'blocked_by_existing_zh') AS blocked_files, count(*) FILTER (status = 'fixed') AS changed_files FROM st")
def repair_report(spark, d):
    return timeline.repair_summary(_repairs(spark, d))


@_query(_REPAIR + " SELECT status, count(*) AS n FROM st GROUP BY status")
def status_histogram(spark, d):
    return reports.histogram(_repairs(spark, d))


_ALL_ISSUES = CUES + """, s AS (SELECT *, lag(idx, 1, 0) OVER w AS li, lag(end_ms) OVER w AS le FROM cues WINDOW w AS (PARTITION BY file ORDER BY pos)),
i AS (SELECT file::VARCHAR AS file, pos, unnest(list_filter([CASE WHEN idx <> li + 1 THEN 'index_not_continuous' END, CASE WHEN start_ms >= end_ms THEN 'invalid_time_range' END, CASE WHEN start_ms < le THEN 'time_overlap' END, CASE WHEN trim(content) = '' THEN 'empty_subtitle' END, CASE WHEN idx <> pos THEN 'index_position_mismatch' END], lambda x: x IS NOT NULL)) AS code FROM s
UNION ALL SELECT DISTINCT file::VARCHAR, NULL, 'missing_translation' FROM cues WHERE file % 6 = 0),
a AS (SELECT file, pos, CASE WHEN code = 'index_position_mismatch' THEN 'warning' ELSE 'error' END AS level, code FROM i)"""


def _all_issues(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = cues(spark, d)
    missing = review.missing_pairs(rows, _right(rows)).withColumn("code", F.lit("missing_translation"))
    return rows, reports.issues(timeline.structural_issues(rows), missing)


@_query(_ALL_ISSUES + " SELECT * FROM a")
def validation_issues(spark, d):
    return _all_issues(spark, d)[1]


_BY_FILE = _ALL_ISSUES + ", b AS (SELECT f.file, count(*) FILTER (level = 'error') AS errors, count(*) FILTER (level = 'warning') AS warnings FROM (SELECT DISTINCT file::VARCHAR AS file FROM cues) f LEFT JOIN a ON a.file = f.file GROUP BY f.file), st AS (SELECT *, CASE WHEN errors > 0 THEN 'FAIL' WHEN warnings > 0 THEN 'WARN' ELSE 'OK' END AS status FROM b)"


@_query(_BY_FILE + " SELECT * FROM st")
def validation_report(spark, d):
    rows, found = _all_issues(spark, d)
    return reports.by_file(found, rows)


@_query(_BY_FILE + " SELECT length(file)::INT AS digits, ['OK', 'WARN', 'FAIL'][max(list_position(['OK', 'WARN', 'FAIL'], status))] AS status FROM st GROUP BY length(file)")
def worst_statuses(spark, d):
    rows, found = _all_issues(spark, d)
    return reports.worst(reports.by_file(found, rows).withColumn("digits", F.length("file")), "digits")


# --- chunks and model stages


@_query("RECURSIVE " + CUES + """, r AS (SELECT file, pos, idx, length(content) AS ch, contains(content, 'tion')::INT AS rk, regexp_matches(content, '[。！？….!?][ \\n]*$') AND length(trim(content, ' ' || chr(10))) >= 18 AS e, start_ms, end_ms FROM cues),
f AS (SELECT file, pos, 0::BIGINT AS chunk, 1 AS n, ch, rk, e, end_ms FROM r WHERE pos = 1
UNION ALL SELECT file, pos, CASE WHEN cut THEN chunk + 1 ELSE chunk END, CASE WHEN cut THEN 1 ELSE n + 1 END, CASE WHEN cut THEN xch ELSE ch + xch END, CASE WHEN cut THEN xrk ELSE rk + xrk END, xe, xend FROM (
 SELECT r.file, r.pos, f.chunk, f.n, f.ch, f.rk, r.ch AS xch, r.rk AS xrk, r.e AS xe, r.end_ms AS xend, (f.n >= 4 OR (f.n >= 2 AND f.ch >= 1500) OR (f.n >= 2 AND f.rk >= 3) OR (f.n >= 3 AND f.ch >= 700)) OR (f.n >= 2 AND f.ch >= 700 AND (f.e OR r.start_ms - f.end_ms >= 400)) AS cut FROM f JOIN r ON r.file = f.file AND r.pos = f.pos + 1)),
t AS (SELECT f.file, f.chunk, f.pos, r.idx, r.ch, r.rk, f.n AS n, f.ch AS tc, f.rk AS tr, max(f.chunk) OVER (PARTITION BY f.file) AS last, row_number() OVER (PARTITION BY f.file, f.chunk ORDER BY f.pos DESC) AS back FROM f JOIN r ON r.file = f.file AND r.pos = f.pos)
SELECT file, chunk, arg_min(idx, pos) AS start_i, arg_max(idx, pos) AS end_i, string_agg(idx::VARCHAR, ',' ORDER BY pos) AS targets, count(*) AS count, sum(ch)::BIGINT AS chars, sum(rk)::BIGINT AS risk_score,
max(CASE WHEN back = 1 THEN CASE WHEN n >= 4 THEN 'max_chunk_size' WHEN n >= 2 AND tc >= 1500 THEN 'hard_chars' WHEN n >= 2 AND tr >= 3 THEN 'risk_density' WHEN n >= 3 AND tc >= 700 THEN 'target_chars' WHEN chunk = last THEN 'end' ELSE 'semantic_gap_or_sentence' END END) AS reason FROM t GROUP BY file, chunk""")
def chunk_summary(spark, d):
    rows = cues(spark, d).withColumns({"chars": F.length("content").cast("long"), "risk": F.col("content").contains("tion").cast("long")})
    chunked = chunking.dynamic(rows, size=3, least=2, most=4, target=700, hard=1500, risk_limit=3, gap_ms=400)
    told = chunking.summary(rows.join(chunked, ["file", "pos"]))
    return told.select("file", "chunk", "start_i", "end_i", F.array_join(F.transform("target_indexes", lambda x: x.cast("string")), ",").alias("targets"), "count", "chars", "risk_score", "reason")


@_query(CUES + """, p AS (SELECT file, pos, idx, (pos - 1) // 8 AS chunk, CASE WHEN pos % 7 = 0 THEN '' ELSE 'p' || idx END AS problem FROM cues) SELECT file, chunk::BIGINT AS chunk, idx AS i, problem, 's' AS suggest, 'light' AS stage FROM p WHERE problem <> ''""")
def findings_kept(spark, d):
    """Replies with blank rows and indexes that were not asked for."""
    rows = cues(spark, d).select("file", "pos", if_("floor((pos - 1) / 8)").alias("chunk"), "idx", if_("if(pos % 7 = 0, '', 'p' || idx)").alias("problem"))
    one = F.struct(F.col("idx").alias("i"), "problem", F.lit("s").alias("suggest"))
    far = F.array(F.struct(F.lit(10**9).cast("long").alias("i"), F.lit("p").alias("problem"), F.lit("s").alias("suggest")))
    replied = rows.groupBy("file", "chunk").agg(F.collect_list("idx").alias("targets"), F.concat(F.lit("```json\n"), F.to_json(F.concat(F.collect_list(one), far)), F.lit("\n```")).alias("reply"))
    return stages.findings(replied).select("file", "chunk", "i", "problem", "suggest", "stage")


def _asked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Chunks of two, and the cues that have an answer: all but every fifth."""
    rows = cues(spark, d).select("file", "pos", "idx", if_("floor((pos - 1) / 2)").alias("chunk"))
    return rows.groupBy("file", "chunk").agg(F.collect_list("idx").alias("targets")), rows.select("file", "chunk", if_("idx + if(pos % 5 = 0, 1000, 0)").alias("i"))


@_query(CUES + " SELECT file, ((pos - 1) // 2)::BIGINT AS chunk, idx AS i FROM cues WHERE pos % 5 = 0")
def incomplete_targets(spark, d):
    return stages.incomplete(*_asked(spark, d))


@_query(CUES + " SELECT file, ((pos - 1) // 2)::BIGINT AS chunk FROM cues GROUP BY ALL HAVING NOT bool_or(pos % 5 = 0)")
def complete_chunks(spark, d):
    return stages.complete_chunks(*_asked(spark, d)).select("file", "chunk")


@_query(CUES + ", g AS (SELECT file, ((pos - 1) // 2)::BIGINT AS chunk, idx AS i, pos % 5 = 0 AS gone FROM cues) SELECT file, chunk, i FROM g WHERE (file, chunk) NOT IN (SELECT (file, chunk) FROM g WHERE gone)")
def reusable_groups(spark, d):
    asked, done = _asked(spark, d)
    return stages.reusable_groups(asked.select("file", "chunk", F.explode("targets").alias("i")), done.select("file", "i"))


@_query(CUES + """, n AS (SELECT file, pos, max((length(content) > 400)::INT) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM cues), i AS (SELECT file, pos, pos - row_number() OVER (PARTITION BY file ORDER BY pos) AS island FROM n WHERE near = 1)
SELECT file, pos, ((pos - 1) // 12)::BIGINT AS chunk, 'light' AS stage FROM cues UNION ALL SELECT file, pos, (island * 1000 + (row_number() OVER (PARTITION BY file, island ORDER BY pos) - 1) // 8)::BIGINT, 'deep' FROM i""")
def two_pass_plan(spark, d):
    rows = cues(spark, d)
    deep = chunking.dilated_groups(rows.select("file", "pos", (F.length("content") > 400).alias("flag"))).select("file", "pos", (F.col("island") * 1000 + F.col("part")).alias("chunk"))
    return stages.plan(chunking.fixed(rows, 12), deep)


@_query("c AS (SELECT user_id AS file, value AS seconds, event_id % 3 = 0 AS cached, 1 + event_id % 2 AS attempts FROM events) SELECT file, count(*) AS chunks, round(sum(seconds), 6) AS seconds, round(avg(seconds) FILTER (NOT cached), 6) AS mean_asked, count(*) FILTER (cached) AS cached, count(*) FILTER (attempts > 1) AS retried FROM c GROUP BY file")
def stage_timing(spark, d):
    chunks = table(spark, d, "events").select(F.col("user_id").alias("file"), F.col("value").alias("seconds"), if_("event_id % 3 = 0").alias("cached"), if_("1 + event_id % 2").alias("attempts"))
    return stages.timing(chunks).withColumns({"seconds": F.round("seconds", 6), "mean_asked": F.round("mean_asked", 6)})


class _Model:
    """A model for tests: it takes a text at its second asking only, and those of a length that 5 divides not at all."""

    def __init__(self):
        self.asked: set[str] = set()

    def __call__(self, request: str) -> str:
        if len(request) % 5 == 0:
            raise ValueError(f"refused {len(request)}")
        if request not in self.asked:
            self.asked.add(request)
            raise TimeoutError("busy")
        return hashlib.sha256(request[::-1].encode()).hexdigest()


@_query("t AS (SELECT doc_id, coalesce(text, '') AS r FROM documents) SELECT doc_id, CASE WHEN length(r) % 5 <> 0 THEN sha256(reverse(r)) END AS reply, CASE WHEN length(r) % 5 = 0 THEN 'ValueError: refused ' || length(r) END AS error FROM t")
def retried_requests(spark, d):
    """Whole texts put to a model that is busy at first and refuses some."""
    asked = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("request"))
    return stages.ask(asked, _Model(), attempts=2, wait_s=0.0).select("doc_id", "reply", "error")


def _host(url: str) -> str:
    from urllib.parse import urlsplit

    parts = urlsplit(url)
    if parts.path.count("/") % 2:
        raise LookupError(parts.path)
    return parts.hostname


@_query("""t AS (SELECT DISTINCT url AS file, regexp_extract(url, '^[^:]*://([^/?#]*)', 1) AS host, regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1) AS p FROM pages WHERE url IS NOT NULL), c AS (SELECT *, (length(p) - length(replace(p, '/', ''))) % 2 = 1 AS odd FROM t)
SELECT file, CASE WHEN odd THEN 'failed' ELSE 'ok' END AS status, CASE WHEN odd THEN 'LookupError: ' || p ELSE host END AS message FROM c""")
def files_worked(spark, d):
    """Addresses of all pages, parsed one by one; some fail."""
    return reports.each_file(table(spark, d, "pages").where("url IS NOT NULL").select(F.col("url").alias("file")).distinct(), _host).select("file", "status", "message")


@_query("t AS (SELECT doc_id, coalesce(text, '') AS request FROM documents) SELECT doc_id, sha256(request || chr(31) || 'model=m' || chr(31) || 'prompt=p') AS signature FROM t")
def request_signatures(spark, d):
    return stages.signed(table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("request")), prompt="p", model="m").select("doc_id", "signature")


_PROBES = """p AS (SELECT c_custkey // 3 AS model, c_custkey % 3 AS ord, CASE WHEN c_custkey % 3 = 2 THEN 'json' ELSE 'plain' END AS style, c_custkey % 3 = 1 AS quiet, CASE WHEN (c_custkey * 7) % 11 = 0 THEN 401 + (c_custkey % 4) * 33 END AS code, c_custkey % 20 AS s, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'x' ELSE '{}' END AS content, c_custkey % 7 = 0 AS thinks FROM customer),
v AS (SELECT model, arg_min(code, ord) FILTER (code IS NOT NULL) AS code, bool_or(code IS NULL AND NOT quiet) AS plain_ok, bool_or(code IS NOT NULL AND quiet) AS quiet_failed, bool_or(code IS NULL AND content = '') AS empty, count(*) FILTER (code IS NULL AND s > 12) AS slow, bool_or(code IS NULL AND style = 'json' AND content <> '{}') AS bad, bool_or(code IS NULL AND quiet AND thinks) AS loud FROM p GROUP BY model)"""


@_query(_PROBES + " SELECT model, CASE WHEN code IS NOT NULL AND plain_ok AND quiet_failed THEN 'no_thinking_payload_rejected' WHEN code = 401 THEN 'auth_failed' WHEN code = 404 THEN 'model_not_found' WHEN code >= 500 THEN 'model_load_failed' WHEN code IS NOT NULL THEN 'backend_http_error' WHEN empty OR slow >= 2 OR bad THEN 'too_slow_reasoning_model' WHEN loud THEN 'no_thinking_not_effective' ELSE 'ok_for_translation' END AS verdict FROM v")
def probe_verdicts(spark, d):
    probes = table(spark, d, "customer").select(
        if_("c_custkey div 3").alias("model"), if_("c_custkey % 3").alias("ord"), if_("if(c_custkey % 3 = 2, 'json', 'plain')").alias("style"), if_("c_custkey % 3 = 1").alias("no_thinking"), if_("if((c_custkey * 7) % 11 = 0, 401 + (c_custkey % 4) * 33, null)").alias("http_code"),
        if_("double(c_custkey % 20)").alias("elapsed_s"), if_("CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'x' ELSE '{}' END").alias("content"), if_("c_custkey % 7 = 0").alias("thinks"),
    )
    return stages.probe_verdict(probes)


_PROFILES = """p AS (SELECT c_custkey AS run, c_custkey % 11 <> 0 AS confirmed, CASE WHEN c_custkey % 7 = 0 THEN 'guess' WHEN c_custkey % 7 = 1 THEN 'user_default_authorized' ELSE 'user' END AS source, c_custkey % 5 <> 0 AS presented, c_custkey % 3 AS items, CASE WHEN c_custkey % 13 = 0 THEN 'x' ELSE 'standard' END AS quality, CASE c_custkey % 4 WHEN 0 THEN 'all' WHEN 1 THEN 'selected_dirs' WHEN 2 THEN 'selected_files' ELSE 'none' END AS scope, c_custkey % 6 AS q, c_custkey % 2 = 0 AS wav, c_custkey % 9 AS st FROM customer)"""


@_query(_PROFILES + """ SELECT run, unnest(list_filter([CASE WHEN NOT confirmed THEN 'not_confirmed' END, CASE WHEN source = 'guess' THEN 'bad_confirmation_source' END, CASE WHEN items = 0 THEN 'unconfirmed:a' END, CASE WHEN items < 2 THEN 'unconfirmed:b' END, CASE WHEN source = 'user_default_authorized' THEN 'no_confirmation_text' END, CASE WHEN NOT presented THEN 'questions_not_presented' END,
CASE WHEN q = 0 THEN 'no_questionnaire' END, CASE WHEN q = 1 THEN 'questionnaire_changed' END, CASE WHEN quality = 'x' THEN 'bad_quality_mode' END, CASE WHEN scope = 'none' THEN 'bad_scope' END, CASE WHEN scope = 'selected_dirs' THEN 'no_selected_dirs' END, CASE WHEN scope = 'all' THEN 'no_scope_summary' END,
CASE WHEN wav THEN 'no_wav_strategy' END, CASE WHEN wav THEN 'no_wav_report' END, CASE WHEN wav THEN 'unconfirmed:wav_only_asr_strategy' END, CASE WHEN st = 0 THEN 'asr:no_backend' END, CASE WHEN st = 1 THEN 'asr:off' END, CASE WHEN st <> 2 THEN 'translate:no_base_url' END, CASE WHEN st = 3 THEN 'translate:not_a_chat_model' END, 'qc:no_backend', 'qc:no_model', 'qc:no_base_url'], lambda x: x IS NOT NULL)) AS error FROM p""")
def preflight_errors(spark, d):
    part = lambda name, backend, model, url: f"'{name}', named_struct('backend', {backend}, 'model', {model}, 'base_url', {url})"
    profile = {
        "run": "c_custkey", "confirmed": "c_custkey % 11 <> 0", "confirmation_source": "CASE WHEN c_custkey % 7 = 0 THEN 'guess' WHEN c_custkey % 7 = 1 THEN 'user_default_authorized' ELSE 'user' END", "confirmation_text": "' '", "questions_presented": "c_custkey % 5 <> 0",
        "confirmed_items": "slice(array('a', 'b'), 1, int(c_custkey % 3))", "quality_mode": "if(c_custkey % 13 = 0, 'x', 'standard')", "output_format": "'srt'", "scope": "CASE c_custkey % 4 WHEN 0 THEN 'all' WHEN 1 THEN 'selected_dirs' WHEN 2 THEN 'selected_files' ELSE 'none' END", "selected_dirs": "CAST(array() AS array<string>)", "selected_files": "array('f')", "scope_summary": "''",
        "questionnaire": "if(c_custkey % 6 = 0, null, 'text')", "questionnaire_sha256": "sha2(if(c_custkey % 6 = 1, 'other', 'text'), 256)", "wav_choice_required": "c_custkey % 2 = 0", "wav_strategy": "''", "wav_report": "''",
        "stages": "map(" + part("asr", "CASE c_custkey % 9 WHEN 0 THEN '' WHEN 1 THEN 'off' ELSE 'local' END", "'m'", "''") + ", " + part("translate", "if(c_custkey % 9 = 2, 'off', 'api')", "if(c_custkey % 9 = 3, 'Whisper', 'm')", "' '") + ")",
    }
    return stages.preflight(table(spark, d, "customer").select(*[if_(e).alias(c) for c, e in profile.items()]), ["b", "a"], ["user", "user_default_authorized"])


@_query("p AS (SELECT c_custkey, ['fast', 'remote_api', 'reasoning_x', 'reasoning_slow', 'odd', '', 'qc'][c_custkey % 7 + 1] AS c FROM customer) SELECT c_custkey, CASE WHEN c IN ('remote_api', 'reasoning_slow') THEN c WHEN c = 'reasoning_x' THEN 'reasoning_verified' WHEN c IN ('fast', 'qc') THEN 'balanced_non_reasoning' ELSE 'unknown' END AS profile FROM p")
def profile_classes(spark, d):
    return table(spark, d, "customer").select("c_custkey", stages.profile_class(if_("element_at(array('fast', 'remote_api', 'reasoning_x', 'reasoning_slow', 'odd', ' ', 'qc'), int(c_custkey % 7) + 1)")).alias("profile"))


@_query("h AS (SELECT c_custkey AS host, ['mac', 'linux', 'other'][c_custkey % 3 + 1] AS platform, CASE WHEN c_custkey % 5 = 0 THEN 'asked' ELSE '' END AS explicit, list_slice(['w', 'mlx', 'cpp'], 1, (c_custkey % 4)::INT) AS available FROM customer) SELECT host, CASE WHEN explicit <> '' THEN explicit WHEN platform = 'mac' AND list_contains(available, 'mlx') THEN 'mlx' WHEN platform = 'linux' AND list_contains(available, 'cpp') THEN 'cpp' ELSE available[1] END AS backend FROM h")
def backend_choices(spark, d):
    hosts = table(spark, d, "customer").select(F.col("c_custkey").alias("host"), if_("element_at(array('mac', 'linux', 'other'), int(c_custkey % 3) + 1)").alias("platform"), if_("if(c_custkey % 5 = 0, 'asked', ' ')").alias("explicit"), if_("slice(array('w', 'mlx', 'cpp'), 1, int(c_custkey % 4))").alias("available"))
    return reports.resolved_backend(hosts, {"mac": "mlx", "linux": "cpp"})


@_query("SELECT o_custkey, arg_min(o_orderkey, o_orderkey) FILTER (o_orderstatus = 'F') AS candidate, count(*) AS tried FROM orders GROUP BY o_custkey".replace("SELECT", "q AS (SELECT 1) SELECT", 1))
def first_successes(spark, d):
    tried = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("candidate"), F.col("o_orderkey").alias("priority"), (F.col("o_orderstatus") == "F").alias("ok"))
    return reports.first_success(tried, "o_custkey")


@_query("""m AS (SELECT DISTINCT p_type || '-' || p_size || '_b' AS model FROM part), k AS (SELECT DISTINCT p_type || '_' || p_size AS id FROM part),
s AS (SELECT model, id, CASE WHEN contains(lower(id), lower(model)) THEN 100 ELSE 0 END + CASE WHEN contains(regexp_replace(lower(id), '[-_]', '', 'g'), regexp_replace(lower(model), '[-_]', '', 'g')) THEN 80 ELSE 0 END + 10 * len(list_filter(string_split(replace(lower(model), '_', '-'), '-'), lambda w: length(w) >= 3 AND contains(lower(id), w))) AS score FROM m, k)
SELECT model, id, score::BIGINT AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY score DESC, id)::INT AS rank FROM s WHERE score > 0) WHERE rank <= 5""")
def similar_models(spark, d):
    part = table(spark, d, "part")
    return reports.similar_models(part.select(if_("p_type || '-' || p_size || '_b'").alias("model")).distinct(), part.select(if_("p_type || '_' || p_size").alias("id")).distinct())


# --- state


@_query("w AS (SELECT doc_id, sha256(coalesce(text, '')) AS signature FROM documents), o AS (SELECT sha256(coalesce(text, '') || CASE WHEN doc_id % 4 = 0 THEN '' ELSE '!' END) AS signature, doc_id % 3 > 0 AS ok FROM documents) SELECT doc_id FROM w WHERE signature NOT IN (SELECT signature FROM o WHERE ok)")
def pending_inputs(spark, d):
    docs = table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    done = docs.select(F.sha2(F.concat("text", if_("if(doc_id % 4 = 0, '', '!')")), 256).alias("signature"), if_("if(doc_id % 3 > 0, 'ok', 'failed')").alias("status"))
    return pending(docs.select("doc_id", F.sha2("text", 256).alias("signature")), done).select("doc_id")


@_query("n AS (SELECT doc_id + (doc_id % 3 = 0)::INT * 1000000 AS path, lang AS status FROM documents) SELECT doc_id AS path, CASE WHEN doc_id % 3 <> 0 THEN 'b-' || lang ELSE source END AS status FROM documents UNION ALL SELECT path, 'b-' || status FROM n WHERE path >= 1000000")
def manifest(spark, d):
    docs = table(spark, d, "documents")
    held = docs.select(F.col("doc_id").alias("path"), F.col("source").alias("status"))
    new = docs.select(if_("doc_id + if(doc_id % 3 = 0, 1000000, 0)").alias("path"), F.col("lang").alias("status"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("ord")).withColumn("status", F.concat_ws("-", "ord", "status"))
    return reports.upsert_manifest(held, new.withColumn("ord", F.when(F.col("ord") == "a", 1).otherwise(2)))


@_query(_GAPS + f""", n AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY start_ms, end_ms) AS id, {_stamp('start_ms', '.')} AS s, {_stamp('end_ms', '.')} AS e FROM gaps)
SELECT file, id, s AS start, e AS end, end_ms - start_ms AS duration_ms, 'clips/' || file || '__w' || lpad(id::VARCHAR, 3, '0') || '__' || replace(replace(s, ':', ''), '.', '') || '_' || replace(replace(e, ':', ''), '.', '') || '__left.wav' AS left_clip, 'planned' AS status FROM n""")
def clip_manifest(spark, d):
    rows = cues(spark, d)
    return reports.clip_manifest(recovery.uncovered(rows, _lengths(rows), 300)).select("file", "id", "start", "end", "duration_ms", "left_clip", "status")


@_query("SELECT count(*) AS total, count(*) FILTER (event_type IN ('view', 'click')) AS pending FROM events".replace("SELECT", "q AS (SELECT 1) SELECT", 1))
def queue_totals(spark, d):
    return review.queue_report(table(spark, d, "events").select(if_("CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'pending_review' ELSE event_type END").alias("status")))


@_query("SELECT event_id FROM events WHERE event_type IN ('view', 'click')".replace("SELECT", "q AS (SELECT 1) SELECT", 1))
def pending_entries(spark, d):
    return review.pending(table(spark, d, "events").select("event_id", if_("CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'pending_review' ELSE event_type END").alias("status"))).select("event_id")


@_query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN coalesce(source, lang) ELSE lang END AS v FROM documents".replace("SELECT", "q AS (SELECT 1) SELECT", 1))
def changed_statuses(spark, d):
    docs = table(spark, d, "documents")
    return review.update_by_key(docs.select("doc_id", F.col("lang").alias("v")), docs.select("doc_id", if_("if(doc_id % 3 = 0, source, null)").alias("v")), "doc_id", "v")


@_query("""q AS (SELECT p_partkey AS id, p_partkey AS ord, p_brand AS target, p_size % 2 = 0 AS ok, p_name AS entry FROM part), l AS (SELECT DISTINCT p_brand AS target FROM part WHERE p_brand <> 'Brand#1'), h AS (SELECT p_brand AS target, p_name AS entry FROM part WHERE p_brand <> 'Brand#1' AND p_partkey % 50 = 0),
a AS (SELECT q.*, l.target AS known, (q.target, q.entry) IN (SELECT (target, entry) FROM h) AS held, row_number() OVER (PARTITION BY q.target, entry ORDER BY ord, id) AS k FROM q LEFT JOIN l ON l.target = q.target WHERE ok)
SELECT id, CASE WHEN known IS NULL THEN 'unknown_target' WHEN held OR k > 1 THEN 'already_present' ELSE 'applied' END AS status FROM a""")
def promoted_rows(spark, d):
    part = table(spark, d, "part")
    queue = part.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("ord"), F.col("p_brand").alias("target"), if_("if(p_size % 2 = 0, ' Approve', 'reject')").alias("decision"), F.col("p_name").alias("entry"))
    libraries = part.where("p_brand <> 'Brand#1'").select(F.col("p_brand").alias("target"), if_("if(p_partkey % 50 = 0, p_name, null)").alias("entry")).distinct()
    return review.promote(queue, libraries)[1]


@_query("SELECT p_brand, 'round_' || lpad((max(CASE WHEN p_size % 3 > 0 THEN p_size ELSE 0 END) + 1)::VARCHAR, 2, '0') AS name FROM part GROUP BY p_brand".replace("SELECT", "q AS (SELECT 1) SELECT", 1))
def next_rounds(spark, d):
    return reports.next_round(table(spark, d, "part").select("p_brand", if_("if(p_size % 3 > 0, 'round_', 'turn_') || p_size").alias("name")), "p_brand")


@_query("SELECT c_custkey AS owner, '{' || CASE WHEN c_mktsegment <> 'FURNITURE' THEN '\"market\":\"' || c_mktsegment || '\",' ELSE '' END || '\"name\":\"' || c_name || '\"}' AS record FROM customer".replace("SELECT", "q AS (SELECT 1) SELECT", 1))
def setting_records(spark, d):
    people = table(spark, d, "customer")
    one = lambda setting, column: people.select(F.col("c_custkey").alias("owner"), F.lit(setting).alias("setting"), F.col(column).alias("value"))
    return reports.record(one("name", "c_name").unionByName(one("market", "c_mktsegment").where("value <> 'FURNITURE'"))).select("owner", F.to_json("record").alias("record"))


@_query(CUES + " SELECT file, idx FROM (SELECT file, idx, row_number() OVER (PARTITION BY file ORDER BY idx) AS k FROM cues WHERE length(content) > 100) WHERE k <= 12")
def first_long_cues(spark, d):
    return matching.first_of_each(cues(spark, d).where("length(content) > 100")).select("file", "idx")


_SOUNDS = ["", "……", "！？", "あx…あ", "はい", "abc", "ok now", "うん", "。a。a", "longer text of several words", "12", "ab"]
_LEXICON = ", ".join(f"'{x}'" for x in activity.WEAK_TEXTS)


@_query(CUES + f""", t AS (SELECT file, pos, {_SOUNDS}[((file + pos) % 12 + 1)::INT] AS c, (500 + ((file * 7 + pos * 3) % 12) * 500) / 1000 AS s FROM cues), k AS (SELECT *, regexp_replace(c, '[\\s\\pZ]+', '', 'g') AS t FROM t)
SELECT file, pos, length(t) = 0 OR lower(t) IN ({_LEXICON}) OR NOT regexp_matches(t, '[\\pL\\pN]') OR (length(t) >= 3 AND len(list_distinct(string_split(t, ''))) <= 2 AND regexp_matches(t, '[…。.、,・~ー-]')) OR (length(t) <= 4 AND regexp_matches(t, 'ん|あ|は|ふ|ちゅ|嗯|啊|哈'))
OR (s >= 2.5 AND length(t) <= 4) OR (s >= 4 AND length(t) / greatest(s, 0.1) <= 1) AS weak FROM k""".replace("\\\\", "\\"))
def weak_texts(spark, d):
    text = F.array(*map(F.lit, _SOUNDS))[if_("int((file + pos) % 12)")]
    return cues(spark, d).select("file", "pos", activity.weak_text(text, if_("(500 + ((file * 7 + pos * 3) % 12) * 500) / 1000")).alias("weak"))


@_query(CUES + """, c AS (SELECT *, ((pos - 1) // 3)::BIGINT AS chunk FROM cues), g AS (SELECT file, chunk, min(pos) AS a, max(pos) AS b FROM c GROUP BY ALL)
SELECT g.file, g.chunk, coalesce(string_agg(c.idx::VARCHAR, ',' ORDER BY c.pos) FILTER (c.pos < a), '') AS before, coalesce(string_agg(c.idx::VARCHAR, ',' ORDER BY c.pos) FILTER (c.pos > b), '') AS after FROM g LEFT JOIN c ON c.file = g.file AND c.pos BETWEEN a - 2 AND b + 2 GROUP BY g.file, g.chunk""")
def chunk_contexts(spark, d):
    rows = cues(spark, d)
    found = chunking.contexts(rows.join(chunking.fixed(rows, 3), ["file", "pos"]))
    told = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return found.select("file", "chunk", told("before"), told("after"))


@_query("o AS (SELECT o_orderkey, 'f/' || o_orderkey AS path, o_custkey AS size_bytes, epoch_ms(o_orderdate) AS modified FROM orders) SELECT o_orderkey, sha256(to_json({'path': path, 'size_bytes': size_bytes, 'modified': modified})::VARCHAR) AS fingerprint FROM o")
def fingerprints(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", if_("'f/' || o_orderkey").alias("path"), F.col("o_custkey").alias("size_bytes"), F.col("o_orderdate").cast("timestamp").alias("modified"))
    return audio_files.fingerprint(rows).select("o_orderkey", "fingerprint")
