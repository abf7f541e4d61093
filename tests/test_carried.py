import random

import pytest
from pyspark.sql import functions as F

from cuespark.operators import activity, audio, carried, chunking, recovery, timeline

rng = random.Random(6)


@pytest.fixture(scope="module")
def cues(spark):
    """One file with nearly all rows, some short ones, rows without a file."""
    rows, at = [], {}
    for i in range(900):
        file = rng.choice([1] * 12 + [2, 3, None])
        pos, start = at.get(file, (0, 0))
        start += rng.choice([-40, 0, 10, 300, 900])
        rows.append((file, pos + 1, pos + 1 + (rng.random() < 0.1), start, start + rng.choice([0, 50, 400, 2500]), rng.choice(["", "text"]), rng.randrange(12), rng.choice("ab")))
        at[file] = (pos + 1, start)
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "file long, pos long, idx long, start_ms long, end_ms long, content string, level long, reason string").repartition(4).cache()


def lengths(rows):
    return rows.groupBy("file").agg((F.max("end_ms") + 2000).alias("duration_ms"))


def frames(rows):
    return rows.select("file", "pos", (F.col("start_ms") / 1000).alias("start_s"), (F.col("end_ms") / 1000).alias("end_s"), (F.col("level") * 900 + 1).alias("left_rms"), (F.col("level") * 500 + 1).alias("right_rms"), F.when(F.col("reason") == "a", "none").otherwise("strong").alias("state"))


OPERATORS = {
    "structural_issues": timeline.structural_issues, "overlap_classes": lambda c: timeline.overlap_classes(c, least_ms=300), "overlap_clip": lambda c: timeline.overlap_clip(c, least_ms=5), "gap_windows": lambda c: timeline.gap_windows(c, 100),
    "merged_windows": timeline.merged_windows, "interval_coverage": lambda c: timeline.interval_coverage(c.where("level > 3").select("file", F.col("pos").alias("frame"), "start_ms", "end_ms"), c.where("level < 9")),
    "uncovered": lambda c: recovery.uncovered(c, lengths(c), 50), "merged": lambda c: recovery.merged(c.select("file", "start_ms", "end_ms", "reason").distinct()), "islands": lambda c: audio.islands(c.withColumn("candidate", F.col("level") > 3), 600, 10),
    "noise_floor": audio.noise_floor, "scored": lambda c: activity.scored(frames(c)), "candidates": lambda c: activity.candidates(activity.scored(frames(c), -60.0), 0.75, 0.0, 1.0).select("file", "start_s", "end_s", "frames", "confidence", "reasons"),
}


def chunked(c, **limits):
    told = c.where("file IS NOT NULL").select("file", "pos", (F.col("level") * 30).alias("chars"), (F.col("level") % 3).alias("risk"), F.when(F.col("level") > 6, "A sentence that is long enough.").otherwise("no").alias("content"), "start_ms", "end_ms")
    return chunking.dynamic(told, **limits)


OPERATORS |= {
    "chunks": lambda c: chunked(c, size=4, least=2, most=7, target=300, hard=700, risk_limit=6),
    "chunks_by_gaps": lambda c: chunked(c, size=6, least=3, most=9, target=250, hard=2000, risk_limit=99, gap_ms=100),
    "chunks_of_one": lambda c: chunked(c, size=1, least=1, most=1, target=1, hard=1, risk_limit=1),
    "chunks_of_many": lambda c: chunked(c, size=60, least=50, most=150, target=9000, hard=90000, risk_limit=9999),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_long_files_in_ranges_give_the_same_rows(cues, name, monkeypatch):
    told = lambda: sorted(str(tuple(r)) for r in OPERATORS[name](cues).collect())
    whole = told()
    monkeypatch.setattr(carried, "MOST", 40)
    for pieces in (2, 16):
        monkeypatch.setattr(carried, "PIECES", pieces)
        assert told() == whole
    assert whole


def test_a_long_file_is_spread(cues, monkeypatch):
    monkeypatch.setattr(carried, "MOST", 40)
    monkeypatch.setattr(carried, "PIECES", 16)
    sizes = {(r.file, r._range): r["count"] for r in carried.ranged(cues, "pos").groupBy("file", "_range").count().collect()}
    of_one = [n for (f, _), n in sizes.items() if f == 1]
    assert len(of_one) == 16 and max(of_one) <= 2 * sum(of_one) / 16
    assert {f for f, _ in sizes if f != 1} == {2, 3, None} and carried.ranged(cues.where("false"), "pos").count() == 0


def test_running_values_by_hand(cues, monkeypatch):
    monkeypatch.setattr(carried, "MOST", 40)
    monkeypatch.setattr(carried, "PIECES", 7)
    rows = carried.with_sums(carried.with_reached(carried.with_next(carried.with_previous(carried.ranged(cues, "pos"), ["pos"], F.struct("idx"), "prev"), ["pos"], F.struct("idx"), "next"), ["pos"], "end_ms", "top"), ["pos"], {"n": F.col("level"), "m": F.lit(1)}).collect()
    for file in {r.file for r in rows}:
        mine = sorted((r for r in rows if r.file == file), key=lambda r: r.pos)
        top, n = None, 0
        for k, r in enumerate(mine):
            n += r.level
            assert (r.prev and r.prev.idx) == (mine[k - 1].idx if k else None) and (r.next and r.next.idx) == (mine[k + 1].idx if k + 1 < len(mine) else None)
            assert r.top == top and (r.n, r.m) == (n, k + 1)
            top = r.end_ms if top is None else max(top, r.end_ms)
