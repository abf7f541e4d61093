"""Words, names and structures inside texts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The first group of words found in problem and suggestion gives category and severity.
ISSUE_CLASSES = [
    ("漏译|遗漏|缺失|没翻", "omission", "high"),
    ("幻觉|荒唐|误识别|asr", "hallucination", "high"),
    ("术语|专有|译名|名词", "terminology", "high"),
    ("人称|称呼|角色|语气|敬语|口吻", "role_tone", "high"),
    ("标点|断句|换行|编号|时间轴|格式|残留日文|残留英文", "formatting", "low"),
    ("可读|阅读|过长|字数|字符|cps", "readability", "medium"),
    ("错译|语义|上下文|逻辑|不通", "semantic", "high"),
]
# Words for each decision of a review.
DECISION_WORDS = {"accept": ["accept", "accepted", "apply", "yes", "y"], "reject": ["reject", "rejected", "no", "n"], "defer": ["defer", "deferred"]}
# Markers in a folder's lower-cased path, and the tag they give.
FOLDER_TAGS = {
    "no_se": ["no se", "nose", "no_se", "no-se", "無se", "无se", "seなし", "se抜き"],
    "main_candidate": ["本編", "本篇", "main", "track", "トラック"],
    "bonus_or_extra": ["ex", "extra", "bonus", "特典", "おまけ", "番外"],
    "trial_or_promo": ["trial", "sample", "体験", "試聴", "试听", "promo", "プロモ"],
    "se_or_bgm_candidate": ["bgm", "se", "効果音", "環境音"],
}
# A text with one of these characters may stand for sounds.
SOUND = "[んあぁはハアぅうっッ♡아青]"


def trimmed(text: Column) -> Column:
    """Without white space of any script at the ends; null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"(?U)^\s+|\s+$", "")


def first_filled(*texts: Column) -> Column:
    """The first text that is not blank, trimmed; else empty."""
    return F.coalesce(*[F.nullif(trimmed(t), F.lit("")) for t in texts], F.lit(""))


def compact(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "")


# Digits, dashes and punctuation that a script's form leaves out or folds.
DIGITS, DASHES, PUNCTUATION = "[0-9０-９]", "[-‐‑–—―ー−]+", r"""[、。,.!?！？♡❤♪『』「」()\[\]（）…・:：;；"'“”]"""


def script_form(text: Column) -> Column:
    """Form in which scripts and recognised speech are compared: no white space, digits or punctuation, one kind of dash."""
    plain = F.regexp_replace(compact(F.translate(F.coalesce(text, F.lit("")), "︙", "…")), DIGITS, "")
    return F.regexp_replace(F.regexp_replace(plain, DASHES, "ー"), PUNCTUATION, "")


def simplified(text: Column, note: str, least: int = 100, dominant: float = 0.45, few: int = 12) -> Column:
    """``note`` in place of long texts that only repeat a few sounds."""
    packed = compact(text)
    chars = F.array_distinct(F.split(packed, ""))
    most = F.array_max(F.transform(chars, lambda c: F.length(packed) - F.length(F.replace(packed, c, F.lit("")))))
    noise = (F.size(chars) <= few) | (most > dominant * F.length(packed))
    return F.when((F.length(packed) >= least) & packed.rlike(SOUND) & noise, note).otherwise(text)


def issue_class(problem: Column, suggestion: Column) -> Column:
    """struct(category, severity); semantic and high where no group of words is found."""
    told = F.lower(F.concat_ws(" ", F.coalesce(problem, F.lit("")), F.coalesce(suggestion, F.lit(""))))
    pair = lambda category, severity: F.struct(F.lit(category).alias("category"), F.lit(severity).alias("severity"))
    return F.coalesce(*[F.when(told.rlike(words), pair(c, s)) for words, c, s in ISSUE_CLASSES], pair("semantic", "high"))


def decision(word: Column, blank: str) -> Column:
    """accept, reject, defer, or the word itself, lower-cased; a blank one is ``blank``."""
    told = F.lower(trimmed(word))
    known = [F.when(told.isin(words), name) for name, words in DECISION_WORDS.items()]
    return F.coalesce(*known, F.nullif(told, F.lit("")), F.lit(blank))


def folder_tags(path: Column) -> Column:
    """Tags by what a folder's path contains; effects are not tagged in folders said to have none; ``audio`` if there is no tag."""
    low = F.lower(path)
    has = {tag: F.exists(F.array(*map(F.lit, marks)), lambda m: low.contains(m)) for tag, marks in FOLDER_TAGS.items()}
    has["se_or_bgm_candidate"] &= ~has["no_se"]
    tags = F.array_compact(F.array(*[F.when(test, tag) for tag, test in has.items()]))
    return F.when(F.size(tags) == 0, F.array(F.lit("audio"))).otherwise(tags)


def keywords(text: Column) -> Column:
    """Parts between commas, slashes and bars, each once, in order."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), "[,、/|]"), lambda p: trimmed(F.regexp_replace(p, r"(?U)\s+", " ")))
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def listed(text: Column, separators: str = "[,;\n]") -> Column:
    """Values of a field that may hold several, blank ones left out."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), separators), trimmed), lambda p: p != "")


def work_id(text: Column, bounded: bool = True) -> Column:
    """``RJ`` and 6 to 10 digits, upper-cased; null if there is none."""
    edge = r"\b" if bounded else ""
    return F.nullif(F.upper(F.regexp_extract(text, rf"(?i){edge}(RJ\d{{6,10}}){edge}", 1)), F.lit(""))


def slug(text: Column) -> Column:
    """A name for files: anything but letters, digits, ``._-`` becomes ``_``."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}._-]+", "_")


def flexible_ms(text: Column) -> Column:
    """Milliseconds of seconds, ``m:s`` or ``h:m:s``, with a point or comma; null for anything else."""
    told = F.translate(trimmed(text), ",", ".")
    parts = F.split(told, ":")
    seconds = F.element_at(parts, -1).try_cast("double")
    minutes = F.try_element_at(parts, F.lit(-2)).try_cast("long")
    hours = F.try_element_at(parts, F.lit(-3)).try_cast("long")
    total = F.coalesce(hours, F.lit(0)) * 3600 + F.coalesce(minutes, F.lit(0)) * 60 + seconds
    return F.when(told.rlike(r"^(\d+:){0,2}\d+(\.\d*)?$"), F.bround(total * 1000).cast("long"))


def window_ms(text: Column) -> Column:
    """struct(start_ms, end_ms) of ``START-END``; null unless the end is later."""
    sides = F.split(F.coalesce(text, F.lit("")), "-", 2)
    start, end = flexible_ms(F.get(sides, F.lit(0))), flexible_ms(F.get(sides, F.lit(1)))
    return F.when(end > start, F.struct(start.alias("start_ms"), end.alias("end_ms")))


def json_rows(text: Column, schema: str) -> Column:
    """Array of structs from a model's reply: fences are taken off, missing and spare commas mended; else what stands in brackets; else null.

    A reply that is well formed is parsed as it is.
    """
    bare = F.regexp_replace(trimmed(text), r"^```(?:json)?\s*|\s*```$", "")
    mended = lambda t: F.regexp_replace(F.regexp_replace(t, r"\}\s*\{", "}, {"), r",\s*\]", "]")
    parse = lambda t: F.from_json(t, f"array<{schema}>", {"allowUnquotedControlChars": "true"})
    whole = F.when(bare.startswith("["), bare)
    inner = F.nullif(F.regexp_extract(bare, r"(\[[\s\S]*\])", 1), F.lit(""))
    return F.coalesce(*[parse(t) for t in (whole, mended(whole), inner, mended(inner))])


def dbfs(rms: Column) -> Column:
    """Level of a 16-bit amplitude in decibels under full scale; -120 for silence."""
    return F.when(rms <= 0, -120.0).otherwise(20 * F.log10(F.least(rms, F.lit(32767)) / 32767.0))
