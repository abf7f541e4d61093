"""Durations of audio containers from ranges of their bytes, never from whole files.

Readers walk a container by its own sizes and offsets and ask for the few bytes they
need: boxes of MP4, the header of a Xing, Info or VBRI frame of MPEG audio, the stream
information of FLAC, the last page of Ogg, elements of WebM, objects of ASF, chunks of
WAV.  Anything else, or what is broken, has no duration.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuespark.dist import ship

#: Bytes at both ends of a file's content that go to Python; what a reader asks beyond them is cut out for it.
ENDS = 1 << 16
#: Steps that a walk over boxes, blocks or frames may take.
STEPS = 10_000

Read = Callable[[int, int], bytes]


class Beyond(Exception):
    """A range that is not at hand."""

    def __init__(self, at: int, n: int):
        super().__init__(at, n)
        self.at, self.n = at, n


def held(pieces: list[tuple[int, bytes]], size: int) -> Read:
    """Reads from pieces of a file (offset, bytes)."""

    def read(at: int, n: int) -> bytes:
        n = max(0, min(n, size - at))
        for start, piece in pieces:
            if start <= at and at + n <= start + len(piece):
                return piece[at - start : at - start + n]
        raise Beyond(at, n)

    return read


def _riff(read: Read, size: int) -> float | None:
    at, rate = 12, None
    for _ in range(STEPS):
        name, body = struct.unpack("<4sI", read(at, 8))
        if name == b"fmt ":
            _, channels, hz, _, align, _ = struct.unpack("<HHIIHH", read(at + 8, 16))
            rate = hz * align if hz and align and channels else None
        elif name == b"data":
            return body / rate if rate else None
        at += 8 + body + body % 2
    return None


def _mp4(read: Read, size: int) -> float | None:
    def boxes(at: int, end: int):
        for _ in range(STEPS):
            if at + 8 > end:
                return
            n, name = struct.unpack(">I4s", read(at, 8))
            head = 8
            if n == 1:
                n, head = struct.unpack(">Q", read(at + 8, 8))[0], 16
            n = n or end - at
            if n < head:
                return
            yield name, at + head, min(at + n, end)
            at += n

    for name, at, end in boxes(0, size):
        if name != b"moov":
            continue
        scale = whole = None
        for inner, start, stop in boxes(at, end):
            if inner == b"mvhd":
                wide = read(start, 1) == b"\x01"
                scale, whole = struct.unpack(">IQ" if wide else ">II", read(start + (20 if wide else 12), 12 if wide else 8))
                if whole == (1 << 64 if wide else 1 << 32) - 1:
                    whole = 0
            elif inner == b"mvex" and not whole:
                for deep, first, _ in boxes(start, stop):
                    if deep == b"mehd":
                        whole = struct.unpack(">Q", read(first + 4, 8))[0] if read(first, 1) == b"\x01" else struct.unpack(">I", read(first + 4, 4))[0]
        return whole / scale if scale and whole else None
    return None


def _after_id3(read: Read, size: int) -> int:
    at = 0
    while at + 10 <= size and (head := read(at, 10))[:3] == b"ID3":
        at += 10 + (head[6] << 21 | head[7] << 14 | head[8] << 7 | head[9]) + (10 if head[5] & 0x10 else 0)
    return at


# Kilobits a second of MPEG audio by version and layer, and samples a second.
_BIT_RATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448), (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160), (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_SAMPLE_RATES = (44100, 48000, 32000)


def _mpeg_frame(head: bytes):
    """(bytes, samples, samples a second, bits a second, where a Xing header would be) of a frame; None if it is none."""
    if len(head) < 4 or head[0] != 0xFF or head[1] & 0xE0 != 0xE0:
        return None
    version, layer, rate, hz = head[1] >> 3 & 3, 4 - (head[1] >> 1 & 3), head[2] >> 4, head[2] >> 2 & 3
    if version == 1 or layer == 4 or rate in (0, 15) or hz == 3:
        return None
    first = version == 3
    bits = _BIT_RATES[1 if first else 2, layer][rate - 1] * 1000
    per_second = _SAMPLE_RATES[hz] // (1 if first else 2 if version == 2 else 4)
    samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
    padding = head[2] >> 1 & 1
    length = (12 * bits // per_second + padding) * 4 if layer == 1 else samples // 8 * bits // per_second + padding
    mono = head[3] >> 6 == 3
    return length, samples, per_second, bits, 4 + ((17 if mono else 32) if first else (9 if mono else 17))


def _mpeg(read: Read, size: int) -> float | None:
    """Frames as a Xing, Info or VBRI header counts them; else all bytes at the rate of the first frame."""
    begun = at = _after_id3(read, size)
    for at in range(begun, min(begun + 4096, size - 4)):
        frame = _mpeg_frame(read(at, 4))
        if frame and (at + frame[0] + 4 > size or _mpeg_frame(read(at + frame[0], 4))):
            break
    else:
        return None
    length, samples, per_second, bits, offset = frame
    if at + offset + 12 <= size and (told := read(at + offset, 12))[:4] in (b"Xing", b"Info") and told[7] & 1:
        return struct.unpack(">I", told[8:])[0] * samples / per_second
    if at + 54 <= size and (told := read(at + 36, 18))[:4] == b"VBRI":
        return struct.unpack(">I", told[14:18])[0] * samples / per_second
    end = size - 128 if size >= 128 and read(size - 128, 3) == b"TAG" else size
    return (end - at) * 8 / bits


def _flac(read: Read, size: int) -> float | None:
    at = _after_id3(read, size) + 4
    head, body = read(at, 4), read(at + 4, 18)
    if head[0] & 0x7F or len(body) < 18:
        return None
    packed = int.from_bytes(body[10:18], "big")
    rate, samples = packed >> 44, packed & (1 << 36) - 1
    return samples / rate if rate and samples else None


def _ogg(read: Read, size: int) -> float | None:
    page = read(0, min(size, 27 + 255 + 64))
    serial, body = page[14:18], page[27 + page[26] :]
    skip = 0
    if body[:7] == b"\x01vorbis":
        rate = struct.unpack("<I", body[12:16])[0]
    elif body[:8] == b"OpusHead":
        rate, skip = 48000, struct.unpack("<H", body[10:12])[0]
    elif body[:5] == b"\x7fFLAC":
        rate = int.from_bytes(body[27:30], "big") >> 4
    elif body[:8] == b"Speex   ":
        rate = struct.unpack("<I", body[36:40])[0]
    else:
        return None
    # A page takes 65,307 bytes at most, so the last one begins within these.
    tail = read(max(0, size - ENDS), ENDS)
    at = tail.rfind(b"OggS")
    while at >= 0:
        if tail[at + 14 : at + 18] == serial and (last := int.from_bytes(tail[at + 6 : at + 14], "little")) != (1 << 64) - 1:
            return max(0, last - skip) / rate if rate else None
        at = tail.rfind(b"OggS", 0, at)
    return None


def _webm(read: Read, size: int) -> float | None:
    def number(at: int, keep: bool) -> tuple[int, int]:
        first = read(at, 1)[0]
        n = 9 - first.bit_length()
        value = int.from_bytes(read(at, n), "big")
        unknown = not keep and value == (1 << 7 * n + 1) - 1
        return (-1 if unknown else value if keep else value & (1 << 7 * n) - 1), n

    def elements(at: int, end: int):
        for _ in range(STEPS):
            if at >= end:
                return
            name, n = number(at, True)
            length, m = number(at + n, False)
            start = at + n + m
            stop = end if length < 0 else min(end, start + length)
            yield name, start, stop
            at = stop

    for name, at, end in elements(0, size):
        if name != 0x18538067:
            continue
        for inner, start, stop in elements(at, end):
            if inner == 0x1549A966:
                scale, length = 1_000_000, None
                for deep, first, last in elements(start, stop):
                    if deep == 0x2AD7B1:
                        scale = int.from_bytes(read(first, last - first), "big")
                    elif deep == 0x4489:
                        length = struct.unpack(">f" if last - first == 4 else ">d", read(first, last - first))[0]
                return length * scale / 1e9 if length else None
    return None


_ASF = bytes.fromhex("3026b2758e66cf11a6d900aa0062ce6c")
_ASF_FILE = bytes.fromhex("a1dcab8c47a9cf118ee400c00c205365")


def _asf(read: Read, size: int) -> float | None:
    end, at = min(size, struct.unpack("<Q", read(16, 8))[0]), 30
    for _ in range(STEPS):
        if at + 24 > end:
            return None
        kind, n = read(at, 16), struct.unpack("<Q", read(at + 16, 8))[0]
        if kind == _ASF_FILE:
            played, _, ahead = struct.unpack("<QQQ", read(at + 64, 24))
            return max(0.0, played / 1e7 - ahead / 1e3)
        if n < 24:
            return None
        at += n
    return None


def duration(read: Read, size: int) -> float | None:
    """Seconds of a container, by its first bytes; None for anything else or what is broken.  A range that ``read`` lacks raises ``Beyond``."""
    try:
        if size < 12:
            return None
        head = read(0, 12)
        tagged = head[:3] == b"ID3" and read(_after_id3(read, size), 4) == b"fLaC"
        if head[:4] == b"RIFF" and head[8:] == b"WAVE":
            return _riff(read, size)
        if head[4:8] in (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide"):
            return _mp4(read, size)
        if head[:4] == b"fLaC" or tagged:
            return _flac(read, size)
        if head[:4] == b"OggS":
            return _ogg(read, size)
        if head[:4] == b"\x1a\x45\xdf\xa3":
            return _webm(read, size)
        if head == _ASF[:12]:
            return _asf(read, size)
        return _mpeg(read, size)
    except (struct.error, IndexError, ZeroDivisionError, OverflowError):
        return None


def _tried(at: list[int], pieces: list[bytes], size: int) -> dict:
    """What a file's pieces say: seconds, or the range that is still wanted."""
    try:
        return {"seconds": duration(held(list(zip(at, pieces)), size), size), "at": None}
    except Beyond as more:
        return {"seconds": None, "at": more.at if more.n else None}


_ASKED = "seconds double, at long"


def durations(files: DataFrame, rounds: int = 3) -> DataFrame:
    """files (path, content): path, duration_s; null for what is no container, is broken or has no content.

    The JVM cuts both ends out of a content, and, round by round, ENDS bytes from where
    a reader wants to go on: each round judges only the files that are still open.
    """
    ship(files.sparkSession)

    @F.pandas_udf(_ASKED)
    def asked(at: pd.Series, pieces: pd.Series, size: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_tried(list(a), list(p), int(n)) if a is not None else {"seconds": None, "at": None} for a, p, n in zip(at, pieces, size)], columns=["seconds", "at"]).astype({"seconds": "float64", "at": "Int64"})

    size = F.length("content").cast("long")
    cut = lambda at: F.substring(F.col("content"), (at + 1).cast("int"), F.lit(ENDS))
    last = F.greatest(F.lit(0), size - ENDS)
    some = F.col("content").isNotNull()
    rows = files.select("path", "content").withColumn("_n", F.coalesce(size, F.lit(0)))
    rows = rows.withColumn("_at", F.when(some, F.array(F.lit(0).cast("long"), last))).withColumn("_p", F.when(some, F.array(cut(F.lit(0)), cut(last))))
    rows = rows.withColumn("_a", asked("_at", "_p", "_n")).withColumn("_s", F.col("_a.seconds"))
    for _ in range(rounds):
        more = F.col("_a.at").isNotNull() & F.col("_s").isNull()
        wanted = F.col("_a.at")
        rows = rows.withColumn("_at", F.when(more, F.concat("_at", F.array(wanted)))).withColumn("_p", F.when(more, F.concat("_p", F.array(cut(wanted)))))
        rows = rows.withColumn("_a", asked("_at", "_p", "_n")).withColumn("_s", F.coalesce("_s", "_a.seconds"))
    return rows.select("path", F.when(~F.isnan("_s"), F.col("_s")).alias("duration_s"))


def listed_durations(listing: DataFrame) -> DataFrame:
    """listing (path, size_bytes): path, duration_s, by ranged reads of the files themselves, a few KiB a file.

    For stores that Arrow's file systems open (local and network folders, S3, GCS, HDFS);
    for any other, ``durations`` of contents that Spark reads.
    """
    ship(listing.sparkSession)

    @F.pandas_udf("double")
    def seconds(paths: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([_of_file(p, int(n)) for p, n in zip(paths, sizes)], dtype="float64")

    told = seconds("path", "size_bytes")
    return listing.select("path", F.when(~F.isnan(told), told).alias("duration_s"))


def _of_file(path: str, size: int) -> float | None:
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    try:
        system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        with system.open_input_file(inner) as f:
            return duration(lambda at, n: f.read_at(max(0, min(n, size - at)), at), size)
    except OSError:
        return None
