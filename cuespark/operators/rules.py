"""Texts against tables of rules: each match with what the rule says of it."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuespark.dist import ship
from cuespark.functions.patterns import matcher
from cuespark.sources.json_files import RULE_FIELDS, rule_errors

#: Rules that one scan takes; people write them, and a task holds all of them.
MOST_RULES = 100_000
#: Matches that a task holds before it gives them away.
HELD = 20_000

# Rules that hold where no rule table is given, (name, pattern, problem, suggestion).
BUILT_IN = [
    ("asr_thanks", r"感谢(?:您的)?观看|谢谢观看", "May be ASR hallucination over long sounds or ending noise.", "Check audio/source; if it is only sound, replace with a short sound cue."),
    ("asr_subscribe", r"订阅|频道|点赞|字幕组", "Often ASR/video-platform hallucination in ASMR audio.", "Check source context before keeping as dialogue."),
    ("model_artifact", r"语言模型|JSON|undefined|null|Markdown", "Likely model or formatting artifact.", "Remove or retranslate from the original subtitle."),
    ("vagus", r"冥想神经", "Likely mistranslation of 迷走神経.", "Check whether it should be 迷走神经."),
    ("police", r"警察", "May be unrelated near-sound ASR error.", "Check source before keeping."),
    ("shi_houdai", r"大开杀戒", "May be mistranslation of し放題.", "Check whether 想怎么做都可以 is intended."),
    ("love_hotel", r"Love Hotel|爱情旅馆", "Less natural localization for ラブホテル.", "Use 情人旅馆 if context fits."),
    ("cos_layer", r"图层|官方解说员", "Likely mistranslation of レイヤー.", "Use coser/官方 coser as appropriate."),
    ("asmr_script_artifact", r"我的Cosplay", "May be model literalization or odd phrasing.", "Check source and make the cosplay reference natural."),
]


def loaded(rules: DataFrame | None) -> list[tuple[str, ...]]:
    """Rules (file, k, name, pattern, problem, suggestion) as (name, pattern, problem, suggestion, file), in order; the built-in ones for None.

    A table with an error is refused, with what is wrong, before any text is read.
    """
    if rules is None:
        return [(*r, None) for r in BUILT_IN]
    wrong = rule_errors(rules).orderBy("file", "k", "error").limit(20).collect()
    if wrong:
        raise ValueError("rules: " + "; ".join(f"{r.file} [{r.k}] {r.error}" for r in wrong))
    rows = rules.orderBy("file", "k").select(*RULE_FIELDS, F.col("file").cast("string")).limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return [tuple(r) for r in rows]


def findings(texts: DataFrame, rules: DataFrame | list[tuple] | None = None) -> DataFrame:
    """texts (content and any columns) x rules: a row for each match, in any case, of any script.

    ``rules`` is a table as ``json_files.rules`` reads it, a list of (name, pattern) or
    (name, pattern, problem, suggestion), or None for the built-in ones.  Returns the
    texts' other columns, rule, matched, problem, suggestion and rules (the table's
    file).  Only rules of which a text holds a literal that they must find are run on
    it.  A text that is null matches nothing; no rules give no rows.
    """
    ship(texts.sparkSession)
    some = [(*r, *[None] * (5 - len(r))) for r in rules] if isinstance(rules, list) else loaded(rules)
    carried = [f for f in texts.schema.fields if f.name != "content"]
    told = ("rule", "matched", "problem", "suggestion", "rules")
    schema = T.StructType(carried + [T.StructField(c, T.StringType()) for c in told])
    patterns = tuple(r[1] for r in some)

    def given(batch, at, which, matched):
        rows = batch.take(pa.array(at, pa.int64()))
        columns = [rows.column(f.name) for f in carried]
        said = [[some[k][0] for k in which], matched, *[[some[k][i] for k in which] for i in (2, 3, 4)]]
        return pa.RecordBatch.from_arrays(columns + [pa.array(c, pa.string()) for c in said], [f.name for f in schema.fields])

    def scan(batches):
        run = matcher(patterns)
        for batch in batches:
            at, which, matched = [], [], []
            for i, text in enumerate(batch.column("content").to_pylist()):
                for k, m in run.found(text) if text is not None else ():
                    at.append(i)
                    which.append(k)
                    matched.append(m)
                    if len(at) >= HELD:
                        yield given(batch, at, which, matched)
                        at, which, matched = [], [], []
            if at:
                yield given(batch, at, which, matched)

    if not some:
        return texts.select(*[f.name for f in carried], *[F.lit(None).cast("string").alias(c) for c in told]).where("false")
    return texts.mapInArrow(scan, schema)
