"""Cue files: SRT and VTT texts to cues and back.

A file is one row (file, value).  An SRT file with any bad block gives no cues but
one error; a VTT file skips bad cues and warns of each, and numbers the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuespark.functions.timecode import SRT_TIME, format_srt, parse_srt

#: White space of any script, and the separators U+001C to U+001F, but no line feed: a line of these ends a cue.
_SPACE = r"[\x{1c}-\x{1f}\s&&[^\n]]"
_ANY = r"[\x{1c}-\x{1f}\s]"
#: Either side of the arrow begins with a time, and white space parts it from what else stands there.
_SRT_TIMING = rf"(?Us)^{_ANY}*{SRT_TIME}(?:{_ANY}(?:(?!-->).)*)?-->{_ANY}*{SRT_TIME}(?:{_ANY}.*)?$".replace(r"\d", "[0-9]")
_VTT_TIME = r"(?:(\d+):)?(\d{2}):(\d{2})\.(\d{3})"


def read_texts(spark: SparkSession, path: str, glob: str = "*.srt", recursive: bool = False) -> DataFrame:
    """(file, value): whole files whose names match."""
    reader = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", recursive)
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")


def _blocks(texts: DataFrame, blank: str) -> DataFrame:
    """Runs of lines between blank ones, as arrays, in order."""
    unix = F.concat(F.lit("\n"), F.regexp_replace("value", r"\r\n?", "\n"), F.lit("\n"))
    cut = F.filter(F.split(unix, blank), lambda b: F.regexp_replace(b, rf"(?U){_ANY}", "") != "")
    return texts.select("file", F.posexplode(cut).alias("k", "block")).select("file", "k", F.split(F.regexp_replace("block", r"^\n+|\n+$", ""), "\n").alias("lines"))


def parse_srt_files(texts: DataFrame) -> DataFrame:
    """file, pos, idx, start_ms, end_ms, content, error: cues, or one row with an error for a file that is not wholly well formed."""
    b = _blocks(texts, rf"(?U)\n(?:{_SPACE}*\n)+")
    index, timing = F.regexp_replace(F.get("lines", F.lit(0)), rf"(?U)^{_ANY}+|{_ANY}+$", ""), F.get("lines", F.lit(1))
    stop = F.regexp_extract(timing, r"(?s)-->(.*)$", 1)
    b = b.withColumn("bad", ~(index.rlike(r"^\d+$") & F.coalesce(timing.rlike(_SRT_TIMING), F.lit(False))))
    w = Window.partitionBy("file")
    b = b.withColumn("n_bad", F.sum(F.col("bad").cast("int")).over(w)).withColumn("pos", F.row_number().over(w.orderBy("k")).cast("long"))
    good = b.where("n_bad = 0").select("file", "pos", index.try_cast("long").alias("idx"), parse_srt(timing).alias("start_ms"), parse_srt(stop).alias("end_ms"), F.array_join(F.slice("lines", F.lit(3), F.size("lines")), "\n").alias("content"), F.lit(None).cast("string").alias("error"))
    none = lambda kind: F.lit(None).cast(kind)
    bad = b.where("n_bad > 0").select("file").distinct().select("file", none("long").alias("pos"), none("long").alias("idx"), none("long").alias("start_ms"), none("long").alias("end_ms"), none("string").alias("content"), F.lit("parse_error").alias("error"))
    return good.unionByName(bad)


def _vtt_ms(text: Column) -> Column:
    part = lambda k: F.coalesce(F.expr("0L") + F.nullif(F.regexp_extract(text, _VTT_TIME, k), F.lit("")).try_cast("long"), F.lit(0))
    return F.when(text.rlike(_VTT_TIME), part(1) * 3_600_000 + part(2) * 60_000 + part(3) * 1000 + part(4))


def parse_vtt_files(texts: DataFrame) -> DataFrame:
    """file, pos, idx, start_ms, end_ms, content, error: good cues numbered from 1, and a warning for each bad one."""
    b = _blocks(texts, rf"(?U)\n(?:{_SPACE}*\n)+").where(F.exists("lines", lambda x: x.contains("-->")))
    at = F.array_position(F.transform("lines", lambda x: x.contains("-->")), True)
    b = b.withColumn("timing", F.element_at("lines", at.cast("int"))).withColumn("start_ms", _vtt_ms(F.split("timing", "-->")[0])).withColumn("end_ms", _vtt_ms(F.split("timing", "-->")[1]))
    b = b.withColumn("content", F.array_join(F.filter("lines", lambda x: (x != F.col("timing")) & (F.trim(x) != "WEBVTT")), "\n"))  # an identifier stays in the text
    ok = F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull()
    b = b.withColumn("error", F.when(~ok, "bad_cue"))
    number = F.row_number().over(Window.partitionBy("file", F.col("error")).orderBy("k")).cast("long")
    return b.withColumn("pos", F.when(ok, number)).select("file", "pos", F.col("pos").alias("idx"), "start_ms", "end_ms", "content", "error")


def to_texts(cues: DataFrame, kind: str = "srt") -> DataFrame:
    """(file, value): each file's cues as an SRT or VTT text."""
    mark = "," if kind == "srt" else "."
    timing = F.concat(format_srt(F.col("start_ms"), mark), F.lit(" --> "), format_srt(F.col("end_ms"), mark))
    head = [F.col("idx").cast("string")] if kind == "srt" else []
    block = F.concat_ws("\n", *head, timing, F.col("content"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", block.alias("block")))), lambda x: x["block"]), "\n\n")
    text = F.concat(body, F.lit("\n")) if kind == "srt" else F.concat(F.lit("WEBVTT\n\n"), body, F.lit("\n"))
    return cues.groupBy("file").agg(text.alias("value"))


def from_segments(segments: DataFrame) -> DataFrame:
    """Recogniser segments (file, ord, start_s, end_s, text) as cues: white space collapsed, empty ones dropped, renumbered, a tenth of a second long at least."""
    text = F.trim(F.regexp_replace("text", r"(?U)\s+", " "))
    kept = segments.withColumn("content", text).where("content <> ''")
    pos = F.row_number().over(Window.partitionBy("file").orderBy("ord")).cast("long")
    end = F.greatest(F.col("start_s") + 0.1, F.coalesce("end_s", F.col("start_s") + 1))
    return kept.select("file", pos.alias("pos"), pos.alias("idx"), F.bround(F.col("start_s") * 1000).cast("long").alias("start_ms"), F.bround(end * 1000).cast("long").alias("end_ms"), "content")
