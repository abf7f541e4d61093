"""Readability warnings and rule findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuespark.functions.timecode import readable_length
from cuespark.operators.rules import findings


def warnings(cues: DataFrame, most_chars: int = 42, most_cps: float = 10.0, most_lines: int = 2, most_line: int = 24) -> DataFrame:
    """A row for each limit that a cue is over; all rules in one scan."""
    chars = readable_length(F.col("content"))
    seconds = F.greatest(F.lit(0.001), (F.col("end_ms") - F.col("start_ms")) / 1000)
    lines = F.split("content", "\n")
    rules = {
        "too_many_chars": F.col("chars") > most_chars,
        "high_cps": F.col("chars") / seconds > most_cps,
        "too_many_lines": F.size(lines) > most_lines,
        "line_too_long": F.exists(lines, lambda x: readable_length(x) > most_line),
        "dense_repeated_sound": F.regexp_replace("content", r"(?U)\s", "").rlike(r"(.)\1{5,}"),
    }
    found = F.filter(F.array(*[F.when(test, F.lit(code)) for code, test in rules.items()]), lambda c: c.isNotNull())
    return cues.withColumn("chars", chars).select("file", "pos", "idx", F.explode(found).alias("code"))


def short_runs(cues: DataFrame, run: int = 4, short_chars: int = 4, most_gap_ms: int = 350) -> DataFrame:
    """First positions of every ``run`` cues in a row that are all short and close together; windows that overlap each count."""
    w = Window.partitionBy("file").orderBy("pos")
    ahead = w.rowsBetween(0, run - 1)
    seen = cues.withColumn("short", (F.length("content") <= short_chars).cast("int")).withColumn("gap", F.lead("start_ms").over(w) - F.col("end_ms"))
    seen = seen.withColumn("all_short", F.min("short").over(ahead)).withColumn("n", F.count("*").over(ahead)).withColumn("widest", F.max("gap").over(w.rowsBetween(0, run - 2)))
    return seen.where((F.col("all_short") == 1) & (F.col("n") == run) & (F.col("widest") <= most_gap_ms)).select("file", "pos", "idx")


def rule_findings(texts: DataFrame, rules: DataFrame | list[tuple] | None) -> DataFrame:
    """texts (file, pos, content) x rules: file, pos, rule, matched for each match; see ``rules.findings``."""
    return findings(texts.select("file", "pos", "content"), rules).select("file", "pos", "rule", "matched")


# Signs of garbled text.
GARBLED = ("???", "？？？", "\ufffd", "□")


def risk_score(texts: DataFrame, terms: list[str], long_chars: int = 140) -> DataFrame:
    """Risk of texts (file, pos, content, and zh, the translation, if there is one): file, pos, score.

    One for each term that the text contains (each entry of the list counts), one more
    for a long text, two for a garbled one, and one each for a translation with a line
    feed and one with kana.
    """
    one = lambda test: F.coalesce(test, F.lit(False)).cast("int")
    garbled = F.coalesce(*[F.when(F.col("content").contains(g), True) for g in GARBLED])
    score = sum((one(F.col("content").contains(t)) for t in terms), F.lit(0)) + one(F.length("content") > long_chars) + 2 * one(garbled)
    if "zh" in texts.columns:
        score = score + one(F.col("zh").contains("\n")) + one(F.col("zh").rlike(r"[\u3040-\u30ff]"))
    return texts.select("file", "pos", score.cast("long").alias("score"))
