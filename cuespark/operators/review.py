"""Review of candidate issues: pairing, context, closure and application."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuespark.functions.text import trimmed


def pair_mismatch(left: DataFrame, right: DataFrame) -> DataFrame:
    """Cues of two versions of a file, position by position: where index or times differ, or one side has ended."""
    r = right.select("file", "pos", F.col("idx").alias("r_idx"), F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    code = (
        F.when(F.col("r_idx").isNull(), "missing_right").when(F.col("idx").isNull(), "missing_left").when(F.col("idx") != F.col("r_idx"), "index_mismatch")
        .when((F.col("start_ms") != F.col("r_start")) | (F.col("end_ms") != F.col("r_end")), "timeline_mismatch")
    )
    return left.join(r, ["file", "pos"], "full_outer").select("file", "pos", code.alias("code")).where("code IS NOT NULL")


def missing_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Files of the left side that the right side lacks; files only on the right are not reported."""
    return left.select("file").distinct().join(right.select("file").distinct(), "file", "left_anti")


def neighbour_context(items: DataFrame, cues: DataFrame, offsets=(-2, -1, 1, 2)) -> DataFrame:
    """Cues near each item (file, idx) by index, not by position; neighbours that do not exist are left out."""
    wanted = items.select("file", "idx", F.explode(F.array(*map(F.lit, offsets))).alias("offset")).withColumn("at", F.col("idx") + F.col("offset"))
    last = cues.groupBy("file", "idx").agg(F.max_by("content", "pos").alias("content")).withColumnRenamed("idx", "at")
    return wanted.join(last, ["file", "at"]).select("file", "idx", "offset", "content")


def apply_updates(cues: DataFrame, updates: DataFrame, apply: bool = True, allow_stale: bool = False) -> DataFrame:
    """cues (file, idx, content) with updates (file, idx, current, replacement), all or none of a file's: file, idx, status.

    An update fails where its cue is missing, its replacement blank or its view of the
    cue stale (unless ``allow_stale``); then no update of that file is made.  Without
    ``apply`` what would be applied is told and nothing else.
    """
    last = cues.groupBy("file", "idx").agg(F.max_by("content", "pos").alias("content")) if "pos" in cues.columns else cues.select("file", "idx", "content")
    joined = updates.join(last, ["file", "idx"], "left")
    stale = (trimmed(F.col("current")) != "") & (trimmed(F.col("current")) != trimmed(F.col("content"))) & F.lit(not allow_stale)
    new = trimmed(F.col("replacement"))
    status = F.when(F.col("content").isNull(), "not_found").when(new == "", "empty").when(stale, "stale").when(new == trimmed(F.col("content")), "already_correct").otherwise("applied" if apply else "would_apply")
    joined = joined.withColumn("status", status)
    failed = F.max(F.col("status").isin("not_found", "empty", "stale").cast("int")).over(Window.partitionBy("file"))
    return joined.withColumn("status", F.when(F.col("status").isin("applied", "would_apply") & (failed == 1), "not_applied").otherwise(F.col("status"))).select("file", "idx", "status")


def updated_cues(cues: DataFrame, updates: DataFrame, **options) -> DataFrame:
    """All cues (file, pos, idx, ..., content) after the updates that ``apply_updates`` makes; of cues with one index the last changes, of updates of one cue the greatest text counts."""
    made = apply_updates(cues, updates, **options).where("status = 'applied'").distinct()
    text = updates.groupBy("file", "idx").agg(F.max(trimmed(F.col("replacement"))).alias("_new")).join(made.select("file", "idx"), ["file", "idx"])
    last = F.row_number().over(Window.partitionBy("file", "idx").orderBy(F.desc("pos"))) == 1
    rows = cues.withColumn("_last", last).join(text, ["file", "idx"], "left")
    content = F.coalesce(F.when(F.col("_last"), F.col("_new")), F.col("content"))
    return rows.select(*[content.alias(c) if c == "content" else F.col(c) for c in cues.columns])


def changed_within(before: DataFrame, after: DataFrame, allowed: DataFrame) -> DataFrame:
    """file, within: whether all cues (file, idx, content) of a file that changed are among those allowed (file, idx)."""
    text = lambda df: F.sort_array(F.collect_list(F.struct("pos", "content"))).alias(df)
    one = before.groupBy("file", "idx").agg(text("a")).join(after.groupBy("file", "idx").agg(text("b")), ["file", "idx"], "full_outer")
    changed = one.where(~F.col("a").eqNullSafe(F.col("b"))).join(allowed.select("file", "idx", F.lit(True).alias("_ok")).distinct(), ["file", "idx"], "left")
    bad = changed.where("_ok IS NULL").select("file").distinct().withColumn("_bad", F.lit(True))
    return before.select("file").distinct().join(bad, "file", "left").select("file", F.col("_bad").isNull().alias("within"))


def strict_pairs(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (file, pos, idx, start_ms, end_ms, ja, zh) of files whose cues agree one by one, and the other files with why: count, index or timeline mismatch.

    Files of the left side that the right side lacks are missing; those of the right alone are not looked at.
    """
    r = right.select("file", "pos", F.col("idx").alias("r_idx"), F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"), F.col("content").alias("zh"), F.lit(True).alias("r"))
    both = left.withColumn("l", F.lit(True)).join(r, ["file", "pos"], "full_outer")
    why = (
        F.when(F.max(F.col("l")).isNull(), "only_right").when(F.max(F.col("r")).isNull(), "missing_translation").when(F.count("l") != F.count("r"), "count_mismatch")
        .when(F.count_if(F.col("idx") != F.col("r_idx")) > 0, "pair_index_mismatch").when(F.count_if((F.col("start_ms") != F.col("r_start")) | (F.col("end_ms") != F.col("r_end"))) > 0, "pair_timeline_mismatch")
    )
    told = both.groupBy("file").agg(why.alias("code"))
    good = both.join(told.where("code IS NULL").select("file"), "file", "left_semi")
    return good.select("file", "pos", "idx", "start_ms", "end_ms", F.col("content").alias("ja"), "zh"), told.where("code IS NOT NULL AND code <> 'only_right'")


def upsert_absent(held: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``held`` and the rows of ``new`` whose key it lacks."""
    return held.unionByName(new.join(held.select(key).distinct(), key, "left_anti").select(held.columns))


def cache_misses(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows of ``wanted`` (signature) without a cached result of that signature whose status is ok."""
    return wanted.join(cache.where("status = 'ok'").select("signature").distinct(), "signature", "left_anti")


def update_by_key(held: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """``held`` with ``column`` replaced where ``changes`` (key, column) has a value; of several changes of a key the greatest counts."""
    new = changes.where(F.col(column).isNotNull()).groupBy(key).agg(F.max(column).alias("_new"))
    value = F.coalesce("_new", column)
    return held.join(new, key, "left").select(*[value.alias(c) if c == column else F.col(c) for c in held.columns])


def promote(queue: DataFrame, libraries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Approved rows of a queue (id, ord, target, decision, entry) into libraries (target, entry).

    The libraries with each new entry once, and what became of every approved row (id,
    status): applied, already_present (there before, or from an earlier row), or
    unknown_target, where no library has that name.
    """
    approved = queue.where(F.lower(F.trim("decision")) == "approve")
    known = libraries.select("target").distinct().withColumn("_known", F.lit(True))
    held = libraries.where("entry IS NOT NULL").select("target", "entry").distinct().withColumn("_held", F.lit(True))
    j = approved.join(known, "target", "left").join(held, ["target", "entry"], "left")
    rank = F.row_number().over(Window.partitionBy("target", "entry").orderBy("ord", "id"))
    j = j.withColumn("status", F.when(F.col("_known").isNull(), "unknown_target").when(F.col("_held") | (rank > 1), "already_present").otherwise("applied"))
    added = j.where("status = 'applied'").select("target", "entry")
    return libraries.select("target", "entry").unionByName(added), j.select("id", "status")


def pending(queue: DataFrame) -> DataFrame:
    """Entries of a review queue (status) that wait."""
    return queue.where(F.col("status").isin("pending", "pending_review"))


def queue_report(queue: DataFrame) -> DataFrame:
    """One row: entries of a review queue, and those that wait."""
    return queue.agg(F.count("*").alias("total"), F.count_if(F.col("status").isin("pending", "pending_review")).alias("pending"))
