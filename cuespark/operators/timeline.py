"""Order, overlap, gap and merge analysis of cues (file, pos, idx, start_ms, end_ms, content).

Operators need the rows of a file in order: one exchange by file and range of its
order, which the window functions that follow share (see ``carried``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespark.functions.timecode import blank
from cuespark.operators import carried


def _issues(df: DataFrame, rules: list[tuple[Column, str]], *keep: str) -> DataFrame:
    found = F.filter(F.array(*[F.when(test, F.lit(code)) for test, code in rules]), lambda c: c.isNotNull())
    return df.select(*keep, F.explode(found).alias("code"))


def structural_issues(cues: DataFrame) -> DataFrame:
    """A row for each broken rule: index order, time range, overlap with the previous cue, empty text."""
    seen = carried.with_previous(carried.ranged(cues, "pos"), ["pos"], F.struct("idx", "end_ms"), "last")
    rules = [
        (F.col("idx") != F.when(F.col("last").isNull(), 0).otherwise(F.col("last.idx")) + 1, "index_not_continuous"),
        (F.col("start_ms") >= F.col("end_ms"), "invalid_time_range"),
        (F.col("start_ms") < F.col("last.end_ms"), "time_overlap"),
        (blank(F.col("content")), "empty_subtitle"),
        (F.col("idx") != F.col("pos"), "index_position_mismatch"),
    ]
    return _issues(seen, rules, "file", "pos", "idx")


def _classed(cues: DataFrame, minor_ms: int = 120, severe_ms: int = 500, least_ms: int = 120) -> DataFrame:
    """Cues in ranges, with overlap_ms and kind."""
    seen = carried.with_previous(carried.ranged(cues, "pos"), ["pos"], F.struct("start_ms", "end_ms"), "last")
    over = F.coalesce(F.col("last.end_ms") - F.col("start_ms"), F.lit(0))
    kind = (
        F.when((F.col("start_ms") >= F.col("end_ms")) | F.coalesce(F.col("last.start_ms") >= F.col("last.end_ms"), F.lit(False)), "invalid")
        .when(over <= 0, "ok")
        .when((over <= minor_ms) & (F.col("start_ms") - F.col("last.start_ms") >= least_ms), "minor")
        .when(over <= minor_ms, "too_short")
        .when(over <= severe_ms, "moderate")
        .otherwise("severe")
    )
    return seen.withColumns({"overlap_ms": F.greatest(over, F.lit(0)).cast("long"), "kind": kind}).drop("last")


def overlap_classes(cues: DataFrame, **limits) -> DataFrame:
    """Each cue against the one before it: ok, minor, too_short (clipping would leave too little), moderate, severe, invalid.

    Limits: minor_ms, severe_ms, least_ms.
    """
    return _classed(cues, **limits).select("file", "pos", "idx", "overlap_ms", "kind")


def overlap_clip(cues: DataFrame, **limits) -> DataFrame:
    """Ends of cues after minor overlaps with the next are clipped to its start; starts never move, so nothing cascades."""
    told = carried.with_next(_classed(cues, **limits), ["pos"], F.struct("kind", "start_ms"), "next")
    end = F.when(F.col("next.kind") == "minor", F.col("next.start_ms")).otherwise(F.col("end_ms"))
    return told.select("file", "pos", "idx", "start_ms", end.alias("end_ms"))


def gap_windows(cues: DataFrame, least_ms: int) -> DataFrame:
    """Times in which no cue has run, of at least ``least_ms``: between the latest end so far and the next start."""
    seen = carried.with_reached(carried.ranged(cues, "start_ms"), ["start_ms", "end_ms", "pos"], "end_ms", "reached")
    reached = F.greatest(F.lit(0), F.coalesce("reached", F.lit(0)))
    return seen.select("file", reached.cast("long").alias("gap_start"), F.col("start_ms").alias("gap_end")).where(F.col("gap_end") - F.col("gap_start") >= least_ms)


def merged_windows(windows: DataFrame, within_ms: int = 250) -> DataFrame:
    """Windows (file, start_ms, end_ms) of one file that touch within ``within_ms`` become one."""
    return touching(windows, within_ms).groupBy("file", "run").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n")).drop("run")


def touching(windows: DataFrame, within_ms: int) -> DataFrame:
    """Windows with the number of their run: one that begins more than ``within_ms`` after all before have ended begins another."""
    order = ["start_ms", "end_ms"]
    seen = carried.with_reached(carried.ranged(windows, "start_ms"), order, "end_ms", "reached")
    fresh = F.col("reached").isNull() | (F.col("start_ms") > F.col("reached") + within_ms)
    return carried.with_runs(seen, order, fresh, "run").drop("reached", "_range", "_split")


def interval_coverage(frames: DataFrame, intervals: DataFrame) -> DataFrame:
    """For each frame (file, frame, start_ms, end_ms), how many intervals (file, start_ms, end_ms) of its file overlap it, half-open.

    Of the intervals that begin before a frame ends, those have passed that end by its
    beginning: two running counts over a file's times, whatever the lengths; no pairs
    are formed.  Nothing should end before it starts.
    """
    proper = (F.col("start_ms") < F.col("end_ms")).cast("long")
    event = lambda df, at, kind, sign, frame: df.select("file", F.col(at).alias("at"), F.lit(kind).alias("kind"), (sign * F.lit(1)).cast("long").alias("n"), (sign * proper).alias("proper"), frame, proper.alias("wide"))
    none, its = F.lit(None).cast(frames.schema["frame"].dataType).alias("frame"), F.col("frame")
    # at one time ends come first, then frames, then starts
    times = event(intervals, "end_ms", 0, F.lit(1), none).unionByName(event(intervals, "start_ms", 3, F.lit(1), none)).unionByName(event(frames, "start_ms", 1, F.lit(0), its)).unionByName(event(frames, "end_ms", 2, F.lit(0), its))
    of = lambda kind, name: F.when(F.col("kind") == kind, F.col(name)).otherwise(0)
    told = carried.with_sums(carried.ranged(times, "at"), ["at", "kind"], {"begun": of(3, "n"), "ended": of(0, "n"), "begun_proper": of(3, "proper"), "ended_proper": of(0, "proper")}, ties=True).where("frame IS NOT NULL")
    # intervals without length do not count for frames without length
    begun, ended = (F.when(F.col("wide") == 1, F.col(x)).otherwise(F.col(f"{x}_proper")) for x in ("begun", "ended"))
    hits = told.groupBy("file", "frame").agg((F.sum(F.when(F.col("kind") == 2, begun).otherwise(0)) - F.sum(F.when(F.col("kind") == 1, ended).otherwise(0))).cast("long").alias("n"))
    return frames.join(hits, ["file", "frame"], "left").select("file", "frame", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def segments(tracks: DataFrame, size_ms: int = 900_000, overlap_ms: int = 8_000) -> DataFrame:
    """Overlapping stretches of fixed size over tracks (file, duration_ms), with how far each reaches into its neighbours.

    A track of unknown duration, or of none, is one stretch without an end.
    """
    if not 0 <= overlap_ms < size_ms:
        raise ValueError("the overlap must be less than the size")
    hop = size_ms - overlap_ms
    known = F.coalesce(F.col("duration_ms") > 0, F.lit(False))
    last = F.when(known, F.greatest(F.lit(0), F.ceil((F.col("duration_ms") - overlap_ms) / hop) - 1)).otherwise(0)
    out = tracks.withColumns({"_known": known, "k": F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long")))})
    end = F.when(F.col("_known"), F.least(F.col("k") * hop + size_ms, F.col("duration_ms")))
    return out.select(
        "file", F.col("k").cast("long").alias("segment"), (F.col("k") * hop).cast("long").alias("start_ms"), end.cast("long").alias("end_ms"),
        F.when(F.col("k") > 0, overlap_ms).otherwise(0).cast("long").alias("overlap_before_ms"), F.when(F.coalesce(end >= F.col("duration_ms"), F.lit(False)), 0).otherwise(overlap_ms).cast("long").alias("overlap_after_ms"),
        F.when(F.col("_known"), "planned").otherwise("planned_unknown_duration").alias("status"),
    )


def repair_actions(cues: DataFrame, fix: bool = False, **limits) -> DataFrame:
    """Overlaps (file, pos, idx, kind, action) of cues: auto_fixable (fixed, with ``fix``) where the earlier end can be clipped, else review_required."""
    done = "fixed" if fix else "auto_fixable"
    return overlap_classes(cues, **limits).where("kind <> 'ok'").select("file", "pos", "idx", "kind", F.when(F.col("kind") == "minor", done).otherwise("review_required").alias("action"))


def repair_status(cues: DataFrame, translated: DataFrame, fix: bool = True, allow: bool = False, **limits) -> DataFrame:
    """A row for each file: status (ok, needs_review, fixed, blocked_by_existing_zh), issues, and those fixed.

    With ``fix``, a file with issues that has a translation (file) is left as it is, as
    clipping would part their times, unless ``allow``.
    """
    issues = repair_actions(cues, **limits).groupBy("file").agg(F.count("*").alias("issues"), F.count_if(F.col("action") == "auto_fixable").alias("fixable"))
    files = cues.select("file").distinct().join(issues, "file", "left").join(translated.select("file", F.lit(True).alias("_zh")).distinct(), "file", "left")
    some, blocked = F.coalesce("issues", F.lit(0)) > 0, F.coalesce("_zh", F.lit(False)) & F.lit(fix and not allow)
    fixed = F.when(some & ~blocked & F.lit(fix), F.coalesce("fixable", F.lit(0))).otherwise(0)
    status = F.when(~some, "ok").when(blocked, "blocked_by_existing_zh").when(fixed > 0, "fixed").otherwise("needs_review")
    return files.select("file", status.alias("status"), F.coalesce("issues", F.lit(0)).alias("issues"), fixed.cast("long").alias("fixed"))


def repair_summary(statuses: DataFrame) -> DataFrame:
    """One row of counts over the files of ``repair_status``."""
    n = lambda s: F.count_if(F.col("status") == s)
    left = F.col("issues") - F.col("fixed")
    return statuses.agg(F.count("*").alias("files"), F.sum("issues").alias("issues"), F.sum("fixed").alias("fixed"), F.sum(left).alias("not_fixed"), n("blocked_by_existing_zh").alias("blocked_files"), n("fixed").alias("changed_files"))
