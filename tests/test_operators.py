from pyspark.sql import functions as F

from cuespark.functions.timecode import format_srt, parse_srt
from cuespark.operators import chunking, review, timeline
from cuespark.sources import cue_files
from cuespark.streaming.resume import pending, process_new_files

CUE = "file string, pos long, idx long, start_ms long, end_ms long, content string"


def test_time_codes(spark):
    df = spark.createDataFrame([("00:00:01,5", 1500), ("1:02:03.004", 3723004), ("00:75:00,000", 4500000), ("no", None)], "t string, ms long")
    assert df.where(~parse_srt(F.col("t")).eqNullSafe(F.col("ms"))).count() == 0
    assert [r[0] for r in spark.createDataFrame([(0,), (360_000_001,)], "m long").select(format_srt(F.col("m"))).collect()] == ["00:00:00,000", "100:00:00,001"]


def test_srt_round_trip_and_errors(spark):
    texts = spark.createDataFrame([("a", "1\r\n00:00:00,000 --> 00:00:01,000\r\nHi\r\nthere\r\n\r\n2\r\n00:00:01,0 --> 00:00:02,5 X1:2\r\nyo\r\n"), ("b", "1\n00:00:00,000 -> 00:00:01,000\nbad\n")], "file string, value string")
    out = cue_files.parse_srt_files(texts)
    assert [tuple(r) for r in out.where("file = 'a'").orderBy("pos").select("idx", "start_ms", "end_ms", "content").collect()] == [(1, 0, 1000, "Hi\nthere"), (2, 1000, 2500, "yo")]
    assert [tuple(r) for r in out.where("file = 'b'").select("pos", "error").collect()] == [(None, "parse_error")]
    again = cue_files.parse_srt_files(cue_files.to_texts(out.where("error IS NULL")))
    assert again.exceptAll(out.where("error IS NULL")).count() == 0


def test_vtt(spark):
    texts = spark.createDataFrame([("a", "WEBVTT\n\nid\n00:01.000 --> 00:02.500\nHi\n\n00:xx --> 00:03.000\nbad\n\n01:00:00.000 --> 01:00:01.000\nyo\n")], "file string, value string")
    rows = [tuple(r) for r in cue_files.parse_vtt_files(texts).orderBy(F.col("start_ms").asc_nulls_last()).select("pos", "start_ms", "end_ms", "content", "error").collect()]
    assert rows[:2] == [(1, 1000, 2500, "id\nHi", None), (2, 3600000, 3601000, "yo", None)]
    assert rows[2][0] is None and rows[2][4] == "bad_cue"


def test_overlap_limits_and_clip(spark):
    rows = [("f", 1, 1, 0, 1000, "a"), ("f", 2, 2, 880, 2000, "b"), ("f", 3, 3, 1879, 3000, "c"), ("f", 4, 4, 2500, 4000, "d"), ("f", 5, 5, 3499, 5000, "e")]
    cues = spark.createDataFrame(rows, CUE)
    kinds = [r.kind for r in timeline.overlap_classes(cues).orderBy("pos").collect()]
    assert kinds == ["ok", "minor", "moderate", "moderate", "severe"]
    once = timeline.overlap_clip(cues)
    assert [r.end_ms for r in once.orderBy("pos").collect()] == [880, 2000, 3000, 4000, 5000]


def test_merge_is_inclusive_and_idempotent(spark):
    w = spark.createDataFrame([("f", 0, 100), ("f", 350, 400), ("f", 651, 700), ("f", 10, 20)], "file string, start_ms long, end_ms long")
    once = timeline.merged_windows(w)
    assert sorted((r.start_ms, r.end_ms, r.n) for r in once.collect()) == [(0, 400, 3), (651, 700, 1)]
    assert timeline.merged_windows(once.drop("n")).drop("n").exceptAll(once.drop("n")).count() == 0


def test_updates_are_all_or_none(spark):
    cues = spark.createDataFrame([("f", 1, "one"), ("f", 2, "two"), ("g", 1, "one")], "file string, idx int, content string")
    updates = spark.createDataFrame([("f", 1, "one", "uno"), ("f", 2, "old", "dos"), ("g", 1, "", "uno"), ("g", 1, "one", "one")], "file string, idx int, current string, replacement string")
    got = sorted((r.file, r.status) for r in review.apply_updates(cues, updates).collect())
    assert got == [("f", "not_applied"), ("f", "stale"), ("g", "already_correct"), ("g", "applied")]


def test_resume(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("src", "out", "check"))
    for n in (3, 2):
        spark.range(n).write.mode("append").parquet(src)
        process_new_files(spark, src, "id long", lambda df: df, out, check)
    assert spark.read.parquet(out).count() == 5
    inputs = spark.createDataFrame([("a",), ("b",)], "signature string")
    done = spark.createDataFrame([("a", "ok"), ("b", "failed")], "signature string, status string")
    assert [r[0] for r in pending(inputs, done).collect()] == ["b"]


def test_update_and_promotion(spark):
    held = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, status string, note string")
    changes = spark.createDataFrame([(1, "done"), (2, None), (3, "z")], "id int, status string")
    assert sorted(tuple(r) for r in review.update_by_key(held, changes, "id", "status").collect()) == [(1, "done", "x"), (2, "b", "y")]
    libraries = spark.createDataFrame([("rules", "r1"), ("terms", None)], "target string, entry string")
    queue = spark.createDataFrame([(1, 1, "rules", "Approve", "r1"), (2, 2, "terms", "approve", "t1"), (3, 3, "terms", "approve", "t1"), (4, 4, "none", "approve", "e"), (5, 5, "rules", "reject", "r2")], "id int, ord int, target string, decision string, entry string")
    after, told = review.promote(queue, libraries)
    assert {r.id: r.status for r in told.collect()} == {1: "already_present", 2: "applied", 3: "already_present", 4: "unknown_target"}
    assert sorted((r.target, r.entry or "") for r in after.collect()) == [("rules", "r1"), ("terms", ""), ("terms", "t1")]


def greedy(rows, size, least, most, target, hard, limit, gap_ms):
    """Chunks by the definition, row by row: (chunk, reason) of each row."""
    chunks, now = [], []
    for k, (chars, risk, ends, start, end) in enumerate(rows):
        if now:
            last = rows[k - 1]
            if len(now) >= least and sum(rows[i][0] for i in now) >= target and (last[2] or gap_ms is not None and start - last[4] >= gap_ms):
                chunks.append((now, "semantic_gap_or_sentence"))
                now = []
        now = now + [k]
        n, c, r = len(now), sum(rows[i][0] for i in now), sum(rows[i][1] for i in now)
        why = "max_chunk_size" if n >= most else "hard_chars" if n >= least and c >= hard else "risk_density" if n >= least and r >= limit else "target_chars" if n >= size and c >= target else None
        if why:
            chunks.append((now, why))
            now = []
    return [(k, why) for k, (some, why) in enumerate(chunks + ([(now, "end")] if now else [])) for _ in some]


def test_chunks_and_why_they_close(spark):
    import random

    random.seed(1)
    rows = []
    for file in range(40):
        at = 0
        for pos in range(1, random.randint(1, 60)):
            text = "w" * random.randint(0, 90) + random.choice(["", ".", "。 ", "」"])
            at += random.choice([0, 0, 1500])
            rows.append((str(file), pos, at, at + 900, text, len(text), random.choice([0, 0, 1, 3])))
            at += 900
    cues = spark.createDataFrame(rows, "file string, pos long, start_ms long, end_ms long, content string, chars long, risk long")
    for gap in (None, 1200):
        got = {(r.file, r.pos): (r.chunk, r.reason) for r in chunking.dynamic(cues, 5, 3, 8, 150, 300, 5, gap_ms=gap).collect()}
        assert len(got) == len(rows)
        for file in {r[0] for r in rows}:
            mine = [r for r in rows if r[0] == file]
            want = greedy([(r[5], r[6], len(r[4].strip()) >= 18 and r[4].strip()[-1:] in "。！？….!?", r[2], r[3]) for r in mine], 5, 3, 8, 150, 300, 5, gap)
            assert [got[file, r[1]] for r in mine] == want
    long = spark.range(100_000).select(F.lit("a").alias("file"), (F.col("id") + 1).alias("pos"), F.lit("x").alias("content"), F.lit(10).alias("chars"), F.lit(0).alias("risk"))
    assert chunking.dynamic(long).agg(F.max("chunk")).first()[0] == 100_000 // 24


def test_interval_coverage_of_any_length(spark):
    import random

    random.seed(2)
    span = lambda: (a := random.randint(0, 30), a + random.choice([0, 0, 1, 5, 10**9]))
    frames = [(random.choice("ab"), k, *span()) for k in range(60)]
    others = [(random.choice("abc"), *span()) for _ in range(60)]
    got = {r.frame: r.n for r in timeline.interval_coverage(spark.createDataFrame(frames, "file string, frame long, start_ms long, end_ms long"), spark.createDataFrame(others, "file string, start_ms long, end_ms long")).collect()}
    assert got == {k: sum(f == g and s < b and e > a for g, s, e in others) for f, k, a, b in frames}


def test_updated_cues(spark):
    cues = spark.createDataFrame([("a", 1, 1, "x"), ("a", 2, 2, "y"), ("b", 1, 1, "z"), ("b", 2, 1, "z2")], "file string, pos long, idx long, content string")
    updates = spark.createDataFrame([("a", 1, "x", "new"), ("a", 2, "stale", "n"), ("b", 1, "z2", " changed ")], "file string, idx long, current string, replacement string")
    after = review.updated_cues(cues, updates)
    assert {(r.file, r.pos): r.content for r in after.collect()} == {("a", 1): "x", ("a", 2): "y", ("b", 1): "z", ("b", 2): "changed"}
    assert {r.status for r in review.apply_updates(cues, updates, apply=False).collect()} == {"not_applied", "stale", "would_apply"}
    free = review.updated_cues(cues, updates, allow_stale=True)
    assert {r.file: r.within for r in review.changed_within(cues, free, updates.where("idx = 1")).collect()} == {"a": False, "b": True}
