"""Audio files: listings, WAV headers and PCM frames."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuespark.dist import ship

# Endings of audio files.
EXTENSIONS = ("wav", "wave", "flac", "mp3", "m4a", "aac", "ogg", "opus", "webm", "wma")
#: Bytes of a file that are looked at first; most files' samples begin within them.
HEAD = 1 << 20
#: Bytes of samples in a row, roughly.
SLICE = 1 << 20
INFO = "data_at long, data_bytes long, rate long, channels int, width int"


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, name, directory, extension, size_bytes, modified of audio files under a folder; contents are not read.

    Names that begin with ``._`` hold metadata of a file system and are left out; files
    of no bytes are not listed either, as Spark reads none.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    found = files.select("path", name.alias("name"), F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("directory"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("extension"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))
    return found.where(F.col("extension").isin(*EXTENSIONS) & ~F.col("name").startswith("._"))


def fingerprint(files: DataFrame) -> DataFrame:
    """Adds ``fingerprint`` of path, size and time of change."""
    return files.withColumn("fingerprint", F.sha2(F.to_json(F.struct("path", "size_bytes", F.unix_millis("modified").alias("modified"))), 256))


def _chunks(head: bytes):
    """(name, offset of the body, size) of the chunks of a RIFF file."""
    at = 12
    while at + 8 <= len(head):
        name, size = struct.unpack_from("<4sI", head, at)
        yield name, at + 8, size
        at += 8 + size + size % 2


def _info(head: bytes | None):
    """Where samples are and of what kind; None if the file holds none that are PCM; () if what is there ends before them."""
    if not head or head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        return None
    form, end = None, 12
    for name, at, size in _chunks(head):
        if name == b"fmt " and at + 16 <= len(head):
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", head, at)
            form = (rate, channels, (bits + 7) // 8) if kind in (1, 0xFFFE) and rate and channels and bits else None
        elif name == b"data":
            return None if form is None else (at, size, *form)
        end = at + size + size % 2
    return () if end + 8 > len(head) else None


def _wav_info(head: pd.Series) -> pd.DataFrame:
    rows = [(*(_info(h) or (None,) * 5), _info(h) == ()) for h in head]
    out = pd.DataFrame(rows, columns=["data_at", "data_bytes", "rate", "channels", "width", "more"])
    return out.astype({c: "Int64" for c in out.columns[:-1]} | {"more": "bool"})


def wav_info(files: DataFrame) -> DataFrame:
    """files (path, content): path and ``info``, whose fields are null for anything that is not PCM.

    Only the first MiB of a file goes to Python, and the whole of those few whose samples begin beyond it.
    """
    ship(files.sparkSession)
    udf = F.pandas_udf(_wav_info, INFO + ", more boolean")
    first = files.withColumn("_i", udf(F.substring("content", 1, HEAD)))
    whole = first.withColumn("_w", udf(F.when(F.col("_i.more") & (F.length("content") > HEAD), F.col("content"))))
    names = [x.split()[0] for x in INFO.split(", ")]
    info = F.struct(*[F.coalesce(F.col(f"_i.{n}"), F.col(f"_w.{n}")).alias(n) for n in names])
    return whole.withColumn("info", info).drop("_i", "_w")


def wav_durations(files: DataFrame) -> DataFrame:
    """path, duration_s: samples over rate; null if the header cannot be read."""
    i = F.col("info")
    return wav_info(files).select("path", (F.floor(i["data_bytes"] / (i["channels"] * i["width"])) / i["rate"]).alias("duration_s"))


def _levels(pcm: pd.Series, step: pd.Series) -> pd.Series:
    def one(raw: bytes, n: int):
        pairs = np.frombuffer(raw[: len(raw) // 4 * 4], dtype="<i2").reshape(-1, 2).astype("float64") ** 2
        starts = np.arange(0, len(pairs), n)
        if not len(starts):
            return []
        sizes = np.diff(np.append(starts, len(pairs)))
        rms = np.sqrt(np.add.reduceat(pairs, starts) / sizes[:, None]).astype("int64")
        return [{"k": k, "left_rms": int(a), "right_rms": int(b)} for k, (a, b) in enumerate(rms)]

    return pd.Series([one(r, int(n)) for r, n in zip(pcm, step)])


def frames(files: DataFrame, frame_s: float = 0.5) -> DataFrame:
    """Frames (file, pos, start_s, end_s, left_rms, right_rms) of 16-bit stereo WAV files (path, content); others give none.

    A file is cut into slices of whole frames before its samples go to Python, so a
    batch holds a few slices and never a whole recording.
    """
    spark = files.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    i = F.col("info")
    good = wav_info(files).where((i["channels"] == 2) & (i["width"] == 2))
    step = F.greatest(F.lit(1), F.floor(i["rate"] * frame_s)).cast("long")
    total = F.floor(F.least(i["data_bytes"], F.length("content") - i["data_at"]) / 4).cast("long")
    sized = good.select(F.col("path").alias("file"), "content", i["data_at"].alias("at"), i["rate"].alias("rate"), step.alias("step"), total.alias("total")).where("total > 0")
    per = F.greatest(F.lit(1), F.floor(SLICE / (F.col("step") * 4))).cast("long")
    sized = sized.withColumn("per", per)
    bytes_of = F.col("per") * F.col("step") * 4
    starts = F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / (F.col("per") * F.col("step"))))
    slices = F.transform(starts, lambda s: F.struct(s.alias("s"), F.substring(F.col("content"), (F.col("at") + 1 + s * bytes_of).cast("int"), F.least(bytes_of, F.col("total") * 4 - s * bytes_of).cast("int")).alias("pcm")))
    cut = sized.select("file", "rate", "step", "total", "per", F.explode(slices).alias("x"))
    levels = cut.select("file", "rate", "step", "total", "per", "x.s", F.explode(F.pandas_udf(_levels, "array<struct<k:long,left_rms:int,right_rms:int>>")("x.pcm", "step")).alias("f"))
    number = F.col("s") * F.col("per") + F.col("f.k")
    return levels.select("file", (number + 1).alias("pos"), (number * F.col("step") / F.col("rate")).alias("start_s"), (F.least(F.col("total"), (number + 1) * F.col("step")) / F.col("rate")).alias("end_s"), "f.left_rms", "f.right_rms")
