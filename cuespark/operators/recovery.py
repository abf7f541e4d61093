"""Windows of a recording to recognise again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuespark.operators import carried
from cuespark.operators.timeline import touching


def uncovered(cues: DataFrame, tracks: DataFrame, least_ms: int = 2_000) -> DataFrame:
    """Gaps between cues in their order, and from the last end to the duration of the track (file, duration_ms).

    A track without cues is one gap; a track whose duration is unknown has no gap at its end.
    """
    seen = carried.with_reached(carried.ranged(cues, "pos"), ["pos"], "end_ms", "reached")
    reached = F.greatest(F.lit(0), F.coalesce("reached", F.lit(0)))
    inner = seen.select("file", reached.cast("long").alias("start_ms"), F.col("start_ms").alias("_e")).withColumnRenamed("_e", "end_ms")
    last = cues.groupBy("file").agg(F.max("end_ms").alias("last"))
    tail = tracks.join(last, "file", "left").select("file", F.greatest(F.lit(0), F.coalesce("last", F.lit(0))).cast("long").alias("start_ms"), F.col("duration_ms").alias("end_ms"))
    return inner.unionByName(tail).where(F.col("end_ms") - F.col("start_ms") >= least_ms).withColumn("reason", F.lit("main_asr_gap"))


def padded(windows: DataFrame, tracks: DataFrame, pad_ms: int, least_ms: int) -> DataFrame:
    """Windows (file, start_ms, end_ms, reason) widened on both sides within the track; short ones are dropped."""
    wide = windows.join(tracks.select("file", "duration_ms"), "file")
    wide = wide.withColumns({"start_ms": F.greatest(F.lit(0), F.col("start_ms") - pad_ms).cast("long"), "end_ms": F.least(F.col("duration_ms"), F.col("end_ms") + pad_ms).cast("long")})
    return wide.where(F.col("end_ms") - F.col("start_ms") >= least_ms).select("file", "start_ms", "end_ms", "reason")


def merged(windows: DataFrame, within_ms: int = 250) -> DataFrame:
    """Windows that touch within ``within_ms`` become one, with their reasons joined by ``+`` in order of first appearance."""
    runs = touching(windows, within_ms).withColumnRenamed("run", "_run")
    each = runs.groupBy("file", "_run", "reason").agg(F.min(F.struct("start_ms", "end_ms")).alias("first"), F.max("end_ms").alias("last"))
    out = each.groupBy("file", "_run").agg(F.min("first.start_ms").alias("start_ms"), F.max("last").alias("end_ms"), F.array_sort(F.collect_list(F.struct("first", "reason"))).alias("why"))
    return out.select("file", "start_ms", "end_ms", F.array_join(F.transform("why", lambda x: x["reason"]), "+").alias("reason"))
