import json

import duckdb
from pyspark.sql import functions as F

from cuespark import catalog
from cuespark.functions import text as T
from cuespark.operators import matching
from cuespark.sources import documents, reports


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(expr.alias("x")).collect()[0][0]


def test_classes_and_decisions(spark):
    rows = [("漏译一句", ""), ("ASR 误", ""), ("", "CPS"), ("", ""), (None, None)]
    df = spark.createDataFrame(rows, "p string, s string").select(T.issue_class(F.col("p"), F.col("s")).alias("c"))
    assert [tuple(r.c) for r in df.collect()] == [("omission", "high"), ("hallucination", "high"), ("readability", "medium"), ("semantic", "high"), ("semantic", "high")]
    words = spark.createDataFrame([(" Yes ",), ("n",), ("deferred",), ("maybe",), (" ",), (None,)], "w string")
    assert [r[0] for r in words.select(T.decision(F.col("w"), "pending")).collect()] == ["accept", "reject", "defer", "maybe", "pending", "pending"]


def test_small_functions(spark):
    assert one(spark, T.script_form(F.col("t")), t="あ︙ １2 — いー。「う」") == "あーいーう"
    assert one(spark, T.keywords(F.col("t")), t="a, b、a / |c  d") == ["a", "b", "c d"]
    assert one(spark, T.work_id(F.col("t")), t="x/rj01201653/y") == "RJ01201653"
    assert one(spark, T.work_id(F.col("t")), t="none") is None
    assert one(spark, T.slug(F.col("t")), t="あ b/c.wav") == "あ_b_c.wav"
    assert one(spark, T.folder_tags(F.col("t")), t="Work/本編/SEなし") == ["no_se", "main_candidate"]
    assert one(spark, T.folder_tags(F.col("t")), t="other") == ["audio"]
    times = spark.createDataFrame([("1.5",), ("2:03",), ("1:02:03,25",), ("x",), ("",), (None,)], "t string")
    assert [r[0] for r in times.select(T.flexible_ms(F.col("t"))).collect()] == [1500, 123000, 3723250, None, None, None]
    assert tuple(one(spark, T.window_ms(F.col("t")), t="1-0:02")) == (1000, 2000)
    assert one(spark, T.window_ms(F.col("t")), t="3-2") is None
    assert one(spark, T.simplified(F.col("t"), "note"), t="あん" * 60) == "note"
    assert one(spark, T.simplified(F.col("t"), "note"), t="ab" * 60) == "ab" * 60


def test_json_is_mended_only_where_broken(spark):
    kind = "struct<i:long,zh:string>"
    rows = [('```json\n[{"i": 1, "zh": "a"}\n{"i": 2, "zh": "b"},]\n```', [(1, "a"), (2, "b")]), ('So: [{"i": 3, "zh": "c"}] done', [(3, "c")]), ('[{"i": 4, "zh": "} {"}]', [(4, "} {")]), ("no", None), (None, None)]
    df = spark.createDataFrame([(r[0],) for r in rows], "t string").select(T.json_rows(F.col("t"), kind).alias("x"))
    assert [None if r.x is None else [tuple(v) for v in r.x] for r in df.collect()] == [r[1] for r in rows]


def test_lines_blocks_and_dispatch(spark):
    good = "1\n00:00:00,000 --> 00:00:01,000\nHi\n"
    texts = [("a.srt", good), ("b.srt", "broken\nfile\n"), ("c.vtt", "WEBVTT\n\nNOTE x\n\n00:00.000 --> 00:01.000\nHi\nyou\n"), ("d.txt", "one two\r\n\nfour"), ("e.txt", None), ("f.md", "")]
    got = sorted(tuple(r) for r in documents.rule_texts(spark.createDataFrame(texts, "file string, value string")).fillna(-1).collect())
    assert got == [("a.srt", -1, 1, "Hi"), ("b.srt", 1, -1, "broken"), ("b.srt", 2, -1, "file"), ("c.vtt", 1, -1, "WEBVTT"), ("c.vtt", 3, -1, "NOTE x"), ("c.vtt", 5, 1, "Hi\nyou"), ("d.txt", 1, -1, "one"), ("d.txt", 2, -1, "two"), ("d.txt", 3, -1, ""), ("d.txt", 4, -1, "four")]


def test_review_items_of_reports(spark):
    report = {"a": [{"i": 1, "problem": " p ", "suggest": "s"}, {"i": "1", "problem": "p", "suggest": "s"}, {"i": "x", "problem": "p"}, {"i": 2}, 5], "b": "no list"}
    rows = documents.review_items(spark.createDataFrame([(json.dumps(report),), ("no json",)], "value string")).collect()
    assert [(r.file, r.idx, r.problem, r.suggest, r.category) for r in rows] == [("a", 1, "p", "s", "semantic")]


def test_page_metadata(spark):
    graph = {"@graph": [{"name": ["Inner &amp; name"], "genre": "x/y"}], "brand": {"name": "B"}, "keywords": ["y", "z"]}
    pages = [
        (1, f'<title>T</title><meta name="keywords" content="k1,k2"><script type="application/ld+json">{json.dumps(graph)}</script><script type="application/ld+json">bad</script>'),
        (2, '<title> only\n title </title><meta property="og:image" content="i.png">'), (3, None), (4, ""),
    ]
    rows = {r.page_id: r for r in documents.page_metadata(spark.createDataFrame(pages, "page_id int, html string")).collect()}
    assert (rows[1].title, rows[1].maker, rows[1].keywords) == ("Inner & name", "B", ["k1", "k2", "x", "y", "z"])
    assert (rows[2].title, rows[2].image, rows[2].keywords) == ("only title", "i.png", [])
    assert rows[3].title == rows[4].title == ""


def test_page_metadata_of_cut_off_references(spark):
    data = {"name": "Q&A &amp; more&amp", "image": "i?a=1&copy=2"}
    pages = [
        (1, "<title>the&amp;&amp;&amp;amp &lt;b&gt;</title>"), (2, "<title>and&amp</title>"), (3, "<title>token = &quot</title>"), (4, "<title>&amp;lt; &ampx; &quo R&D &</title>"), (5, None), (6, ""),
        (7, '<title>T</title><meta name="description" content="x &amp;amp; y &amp z"><script type="application/ld+json">' + json.dumps(data) + "</script>"), (8, "<title>&#39;&#x41; &eacute;&#66</title>"),
    ]
    df = spark.createDataFrame(pages, "page_id long, html string")
    rows = {r.page_id: r for r in documents.page_metadata(df, strict=True).collect()}
    assert [rows[k].title for k in range(1, 9)] == ["the&&&amp <b>", "and&amp", "token = &quot", "&lt; &ampx; &quo R&D &", "", "", "Q&A & more&amp", "'A é&#66"]
    assert (rows[7].description, rows[7].image) == ("x &amp; y &amp z", "i?a=1&copy=2")
    assert {r.page_id: r.title for r in documents.page_metadata(df.where("page_id IN (2, 3)")).collect()} == {2: "and&", 3: 'token = "'}


def test_page_metadata_query_agrees_on_cut_off_references(spark, tmp_path):
    titles = ["and&amp", "a&lt", "token = &quot", "x &amp;amp; y", "&amp;lt;", "R&D", "&gt;&quot;", "plain"]
    spark.createDataFrame([(k, f"<html><title>{t}</title><p>x</p></html>") for k, t in enumerate(titles)], "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = sorted(con.execute(catalog.oracle_sql()["page_metadata"]).fetchall())
    assert sorted(tuple(r) for r in catalog.page_metadata(spark, str(tmp_path)).collect()) == want and len(want) == len(titles)


def test_page_windows_and_unscripted(spark):
    pages = matching.clean_pages(spark.createDataFrame([("w", 1, "- 1 -\nabcdefgh\n\n12 3"), ("w", 2, " 7 "), ("w", 3, "ijklmnop"), ("w", 4, "qrstuvwx")], "work string, page int, text string"))
    assert [(r.page, r.text) for r in pages.orderBy("page").collect()] == [(1, "abcdefgh"), (2, "ijklmnop"), (3, "qrstuvwx")]
    tracks = spark.createDataFrame([("w", "t", "ijklmnop qrstuvwx"), ("w", "u", "0"), ("v", "x", "abc")], "work string, track string, text string")
    best = {r.track: (r.first_page, r.last_page, r.ratio) for r in matching.best_page_window(tracks, pages).collect()}
    assert best == {"t": (2, 3, 1.0), "u": (1, 1, 0.0), "x": (1, 1, 0.0)}
    cues = spark.createDataFrame([("w", "f", 1, "cdef"), ("w", "f", 2, "zzzz\nyyyy"), ("w", "f", 3, "zz"), ("w", "f", 4, "ijklmn9op")], "work string, file string, idx int, content string")
    scripts = spark.createDataFrame([("w", "abcdefgh ijklmnop qrstuvwx")], "work string, text string")
    assert [(r.idx, r.content) for r in matching.unscripted(cues, scripts).collect()] == [(2, "zzzz yyyy")]


def test_export_writes_whole_files_once(spark, tmp_path):
    cues = spark.createDataFrame([("a", 1, 1, 0, 1000, "Hi"), ("a", 2, 2, 1000, 2000, "yo"), ("b", 1, 1, 0, 500, "x")], "file string, pos long, idx long, start_ms long, end_ms long, content string")
    first = {(r.file, r.kind): r.status for r in reports.export(cues, str(tmp_path), "both").collect()}
    assert set(first.values()) == {"wrote"} and len(first) == 4
    assert {r.status for r in reports.export(cues, str(tmp_path), "vtt").collect()} == {"skipped_exists"}
    assert (tmp_path / "b.vtt").read_text() == "WEBVTT\n\n00:00:00.000 --> 00:00:00.500\nx\n"
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.srt", "a.vtt", "b.srt", "b.vtt"]


def test_markdown(spark):
    items = spark.createDataFrame([("q", "f", 1, "semantic", "high", "listen", "r", "", None, "new")], "issue_id string, file string, idx int, category string, severity string, review_method string, reason string, source string, current string, suggest string")
    text = reports.review_queue_markdown(items).collect()[0].section
    assert text.startswith("## q / f #1\n") and text.count("(missing)") == 2 and text.endswith("new\n")
    assert [r.line for r in reports.table_markdown(spark.createDataFrame([("a|b", 1)], "x string, y int"), "x", "y").collect()] == ["| a\\|b | 1 |"]


def test_report_of_candidates(spark):
    rows = [("f", 61.5, 63.25, "high", "left", -20.5, -30.0, 1.0, 0.0, ["channel_energy_active", "main_asr_gap"]), ("f", 2.0, 4.0, "low", "balanced", -40.0, -40.0, 0.5, 0.25, []), ("g", 0.0, 1.0, "medium", "right", -1.0, -2.0, 0.0, 0.0, ["x"])]
    found = spark.createDataFrame(rows, "file string, start_s double, end_s double, confidence string, side string, avg_left_db double, avg_right_db double, gap_ratio double, weak_ratio double, reasons array<string>")
    sections = [r.section for r in reports.activity_markdown(found).orderBy("ord").collect()]
    assert [x.split("\n")[0] for x in sections] == ["## C001 00:00:02.000 - 00:00:04.000", "## C002 00:01:01.500 - 00:01:03.250", "## C001 00:00:00.000 - 00:00:01.000"]
    assert "- left / right dB: `-20.5` / `-30.0`\n" in sections[1] and "- reasons: channel_energy_active, main_asr_gap\n" in sections[1] and sections[0].endswith("ignore\n")
    assert {r.file: "candidates: `2`" in r.head for r in reports.activity_head(found).collect()} == {"f": True, "g": False}


def test_directories_are_converted(spark, tmp_path):
    from cuespark.sources.reports import convert

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.srt").write_text("1\n00:00:00,000 --> 00:00:01,000\nHi\n")
    (tmp_path / "in" / "b.srt").write_text("1\nno time\n")
    ask = lambda **o: {(r.file, r.kind, r.status) for r in convert(spark, str(tmp_path / "in"), str(tmp_path / "out"), "both", **o).collect()}
    assert ask() == {("a", "srt", "wrote"), ("a", "vtt", "wrote"), ("b", None, "parse_error")}
    assert (tmp_path / "out" / "a.vtt").read_text() == "WEBVTT\n\n00:00:00.000 --> 00:00:01.000\nHi\n"
    assert ask() == {("a", "srt", "skipped_exists"), ("a", "vtt", "skipped_exists"), ("b", None, "parse_error")}


def test_globs():
    import fnmatch
    import re

    from cuespark.sources.json_files import glob_pattern

    for glob in ("*.srt", "a/*/b?.vtt", "[ab]*", "[!ab]x", "x[", "a.b+c", "*"):
        for text in ("a.srt", "a/x/y/b1.vtt", "ab", "cx", "x[", "a.b+c", "aXbbc", ""):
            assert bool(re.search(glob_pattern(glob), text)) == fnmatch.fnmatchcase(text, glob), (glob, text)


def test_similarity_is_that_of_the_library():
    import difflib
    import random

    from cuespark.operators import matching

    random.seed(5)
    for alphabet in ("ab", "abcdefgh ", "あいう🙂x"):
        for _ in range(60):
            a, b = ("".join(random.choice(alphabet) for _ in range(random.randint(0, 130))) for _ in range(2))
            matcher = difflib.SequenceMatcher(None, a, b, autojunk=False)
            assert matching._ratio(a, b) == matcher.ratio()
            assert matching._matched(a, b) == sum(m.size for m in matcher.get_matching_blocks()) <= matching._common(a, b)
