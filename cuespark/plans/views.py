"""Timed-text views of general tables, in integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as cues of a file."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c, t = F.col("conv_id"), F.col("turn")
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "conversations").select(
        c.alias("file"), F.row_number().over(w).cast("long").alias("pos"), (t + 1).alias("idx"), text.alias("content"),
        (1000 + (F.length(text) * 37 + c * 11) % 5000).alias("dur"), (((c * 7 + t * 13) % 16) * 100 - 900).alias("gap"),
    )
    before = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start_ms", F.coalesce(F.sum(F.col("dur") + F.col("gap")).over(before), F.lit(0)))
    return rows.select("file", "pos", "idx", "start_ms", (F.col("start_ms") + F.col("dur")).alias("end_ms"), "content")


CUES = """base AS (SELECT conv_id AS file, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, turn + 1 AS idx, coalesce(text, '') AS content,
  1000 + (length(coalesce(text, '')) * 37 + conv_id * 11) % 5000 AS dur, ((conv_id * 7 + turn * 13) % 16) * 100 - 900 AS gap FROM conversations),
cues AS (SELECT file, pos, idx, start_ms, start_ms + dur AS end_ms, content FROM (SELECT *, coalesce(sum(dur + gap) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ms FROM base))"""


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("p", "content")).select("file", (F.col("p") + 1).cast("long").alias("pos"), "content")


LINES = """lines AS (SELECT doc_id AS file, generate_subscripts(l, 1)::BIGINT AS pos, unnest(l) AS content FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))"""


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as intervals, numbered by time."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("file"), F.row_number().over(w).cast("long").alias("pos"), F.col("event_id").alias("frame"), ms.alias("start_ms"),
        (ms + (F.col("value") * 1000).cast("long")).alias("end_ms"), F.floor("value").cast("long").alias("level"), F.col("event_type").alias("kind"),
    )


IVALS = """ivals AS (SELECT user_id AS file, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, event_id AS frame, epoch_us(ts) // 1000 AS start_ms,
  epoch_us(ts) // 1000 + trunc(value * 1000)::BIGINT AS end_ms, floor(value)::BIGINT AS level, event_type AS kind FROM events)"""


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as audio files of tracks."""
    kinds = F.array(*map(F.lit, ("mp3", "wav", "flac", "ogg")))
    return table(spark, sf_dir, "part").select(
        F.col("p_name").alias("track_key"), F.concat(F.col("p_name"), F.lit("/"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_brand").alias("directory"),
        kinds[(F.col("p_partkey") % 4).cast("int")].alias("extension"), (F.col("p_size") % 3).cast("long").alias("warnings"), F.when(F.col("p_size") % 10 != 0, F.floor("p_retailprice").cast("double")).alias("duration_s"),
    )


TRACKS = """tracks AS (SELECT p_name AS track_key, p_name || '/' || p_partkey AS path, p_brand AS directory, ['mp3', 'wav', 'flac', 'ogg'][p_partkey % 4 + 1] AS extension, (p_size % 3)::BIGINT AS warnings,
  CASE WHEN p_size % 10 <> 0 THEN floor(p_retailprice)::DOUBLE END AS duration_s FROM part)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as frames of half a second, with levels from their values."""
    rms = F.floor(F.col("value") * 20).cast("int")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), F.row_number().over(w).cast("long").alias("pos"), rms.alias("left_rms"), (rms * (1 + F.col("event_id") % 3)).cast("int").alias("right_rms"))
    return rows.withColumns({"start_s": (F.col("pos") - 1) / 2, "end_s": F.col("pos") / 2})


FRAMES = CUES + """, base_frames AS (SELECT user_id AS file, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, floor(value * 20)::INT AS left_rms, (floor(value * 20)::INT * (1 + event_id % 3))::INT AS right_rms FROM events),
frames AS (SELECT *, (pos - 1) / 2 AS start_s, pos / 2 AS end_s FROM base_frames)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as audio files, every other one said to be without effects."""
    kinds = F.array(*map(F.lit, ("mp3", "wav", "flac", "ogg")))
    key = F.col("p_partkey")
    kind = kinds[(F.floor(key / 2) % 4).cast("int")]
    path = F.concat("p_brand", F.lit("/"), key.cast("string"), F.lit("/"), "p_name", F.when(key % 2 == 0, " No_SE").otherwise(""), F.lit("."), kind)
    return table(spark, sf_dir, "part").select(path.alias("path"), F.col("p_brand").alias("directory"), kind.alias("extension"), (F.col("p_size").cast("long") * 20_000).alias("size_bytes"), F.when(F.col("p_size") % 10 != 0, F.floor("p_retailprice").cast("double")).alias("duration_s"))


FILES = r"""named AS (SELECT *, ['mp3', 'wav', 'flac', 'ogg'][p_partkey // 2 % 4 + 1] AS extension FROM part),
files AS (SELECT p_brand || '/' || p_partkey || '/' || p_name || CASE WHEN p_partkey % 2 = 0 THEN ' No_SE' ELSE '' END || '.' || extension AS path, p_brand AS directory, extension, list_position(['mp3', 'wav', 'flac', '', '', '', 'ogg'], extension) AS k, (p_size * 20000 < 262144)::INT AS w, p_partkey % 2 = 0 AS without,
  CASE WHEN p_size % 10 <> 0 THEN floor(p_retailprice)::DOUBLE END AS duration_s, regexp_replace(lower(p_name), '[\s\-_.,/\\()]+', '', 'g') AS track_key FROM named)"""
