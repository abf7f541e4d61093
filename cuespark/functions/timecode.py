"""Time codes and text measures as Column expressions; times are BIGINT milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SRT_TIME = r"(\d{1,2}):(\d{2}):(\d{2})[,.](\d{1,3})"
#: White space and punctuation that do not count as readable characters.
UNREAD = r"(?U)[\s.,!?;:\"'()\[\]{}\-…、。！？「」『』（）]"


def parse_srt(text: Column) -> Column:
    """Milliseconds of ``HH:MM:SS,mmm``; one to three digits of fraction, padded on the right; null if it is none."""
    part = lambda k: F.try_to_number(F.regexp_extract(text, SRT_TIME, k), F.lit("999")).cast("long")
    fraction = F.rpad(F.regexp_extract(text, SRT_TIME, 4), 3, "0")
    ms = part(1) * 3_600_000 + part(2) * 60_000 + part(3) * 1000 + F.try_to_number(fraction, F.lit("999")).cast("long")
    return F.when(text.rlike(SRT_TIME), ms)


def format_srt(ms: Column, separator: str = ",") -> Column:
    """``HH:MM:SS,mmm``; hours beyond 99 keep all their digits."""
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours = F.floor(ms / 3_600_000)
    hour = F.when(hours > 99, hours.cast("string")).otherwise(two(hours))
    rest = F.concat(two(F.floor(ms / 60_000) % 60), F.lit(":"), two(F.floor(ms / 1000) % 60), F.lit(separator), F.lpad((ms % 1000).cast("string"), 3, "0"))
    return F.concat(hour, F.lit(":"), rest)


def readable_length(text: Column) -> Column:
    return F.length(F.regexp_replace(text, UNREAD, ""))


def blank(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "") == ""


def stable_id(*parts: Column) -> Column:
    """Identity of a review item: a prefix and 16 hex digits of the sha256 of its parts."""
    return F.concat(F.lit("qc-"), F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 16))
