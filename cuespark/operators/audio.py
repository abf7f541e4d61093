"""Audio tracks and activity frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuespark.operators import carried

# Kinds of file by preference, first to last.
PRIORITY = {"mp3": 0, "wav": 1, "wave": 1, "flac": 2, "m4a": 3, "aac": 4, "opus": 5, "ogg": 6, "wma": 7}


def ext_rank(extension: Column) -> Column:
    """Rank of a kind of file; 99 for kinds without one."""
    ranks = F.create_map(*[F.lit(x) for pair in PRIORITY.items() for x in pair])
    return F.coalesce(F.try_element_at(ranks, F.lower(extension)), F.lit(99))


def rollup(files: DataFrame) -> DataFrame:
    """Per directory: files, known seconds, files of unknown duration, and the paths in order."""
    return files.groupBy("directory").agg(F.count("*").alias("files"), F.coalesce(F.sum("duration_s"), F.lit(0.0)).alias("seconds"), F.count_if(F.col("duration_s").isNull()).alias("unknown"), F.array_sort(F.collect_list("path")).alias("paths"))


def best_variant(files: DataFrame) -> DataFrame:
    """Of each track_key the file with the fewest warnings, then by kind, then by path."""
    return files.groupBy("track_key").agg(F.min(F.struct("warnings", ext_rank(F.col("extension")).alias("rank"), "path")).alias("m"), F.count("*").alias("variants")).select("track_key", F.col("m.path").alias("path"), "variants")


def variant_match(files: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Files of one track_key whose durations differ by no more than the tolerance: how many such others each has.

    Counted over each key's files in order of duration, without forming pairs.
    """
    # others within [d * (1 - t), d / (1 - t)]: |a - b| / max(a, b) <= t
    sides = files.select("track_key", "path", "duration_s")
    events = sides.select("track_key", F.lit(None).cast("string").alias("path"), F.col("duration_s").alias("at"), F.lit(1).alias("kind"), F.lit(1).alias("n"))
    low = sides.select("track_key", "path", (F.col("duration_s") * (1 - tolerance)).alias("at"), F.lit(0).alias("kind"), F.lit(0).alias("n"))
    high = sides.select("track_key", "path", (F.col("duration_s") / (1 - tolerance)).alias("at"), F.lit(2).alias("kind"), F.lit(0).alias("n"))
    before = F.sum("n").over(Window.partitionBy("track_key").orderBy("at", "kind"))
    seen = events.unionByName(low).unionByName(high).withColumn("before", before).where("kind <> 1")
    return seen.groupBy("track_key", "path").agg((F.sum(F.when(F.col("kind") == 2, F.col("before")).otherwise(-F.col("before"))) - 1).cast("long").alias("matches"))


def noise_floor(frames: DataFrame, p: float = 0.2) -> DataFrame:
    """Nearest-rank percentile of level per file, ranks rounded half to even."""
    rank = lambda n: F.bround((n - 1) * p) + 1
    return carried.value_of_rank(carried.ranged(frames.select("file", "level"), "level"), "level", rank, "floor")


def islands(frames: DataFrame, merge_ms: int, least_ms: int) -> DataFrame:
    """Runs of candidate frames (file, pos, start_ms, end_ms, candidate): a run ends at another frame or a hole in time."""
    kept = frames.where("candidate")
    seen = carried.with_previous(carried.ranged(kept, "pos", among=frames), ["pos"], F.struct("pos", "end_ms"), "last")
    breaks = F.coalesce((F.col("pos") != F.col("last.pos") + 1) | (F.col("start_ms") - F.col("last.end_ms") > merge_ms), F.lit(True))
    runs = carried.with_runs(seen, ["pos"], breaks, "run")
    return runs.groupBy("file", "run").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("frames")).where(F.col("end_ms") - F.col("start_ms") >= least_ms).drop("run")
