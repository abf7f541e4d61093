"""Stages that ask a model: requests over chunks, replies to rows, caches and checks.

The model is a function from request text to reply text.  It alone runs in Python, in
Arrow batches; requests are made and replies read by built-in functions.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuespark.dist import ship
from cuespark.functions.text import json_rows, simplified, trimmed
from cuespark.functions.timecode import format_srt

# Flags that a translation may carry.
FLAGS = ["asr_uncertain", "adult_term", "speaker_ambiguous", "pronoun_ambiguous", "onomatopoeia", "long_line", "possible_noise", "needs_context"]
# Names of recognisers that are no chat models.
RECOGNISERS = ["large-v3", "whisper", "whisper-large-v3"]


# Classes of models with a profile of their own, and classes that have that of another.
PROFILES = ("fast_small_non_reasoning", "balanced_non_reasoning", "large_non_reasoning", "reasoning_verified", "reasoning_slow", "remote_api", "unknown")
BALANCED = ("non_reasoning_instruct", "balanced", "fast", "translation", "qc")
# Fixed value: what stands for long noise in a request.
NOISE_NOTE = "（長い喘ぎ声・キス音・耳舐め音。字幕では简短处理。）"


def profile_class(model_class: Column) -> Column:
    """The class whose profile a model class has: its own, that of reasoning or of balanced models, else ``unknown``."""
    told = F.coalesce(F.nullif(trimmed(model_class), F.lit("")), F.lit("unknown"))
    return F.when(told.isin(*PROFILES), told).when(told.startswith("reasoning"), "reasoning_verified").when(told.isin(*BALANCED), "balanced_non_reasoning").otherwise("unknown")


def payload(cues: DataFrame) -> DataFrame:
    """Cues with ``item``, what a request says of them: index, times as written, and text, long noise as a note."""
    item = F.struct(F.col("idx").alias("i"), format_srt(F.col("start_ms")).alias("start"), format_srt(F.col("end_ms")).alias("end"), simplified(F.col("content"), NOISE_NOTE).alias("text"))
    return cues.withColumn("item", item)


def requests(cues: DataFrame, halo: int = 2) -> DataFrame:
    """Cues (file, pos, chunk, item), ``item`` a struct with ``i``, as one request for each chunk: file, chunk, targets, n and JSON text.

    The request holds the items of the chunk and ``halo`` items before and after it.
    """
    w = Window.partitionBy("file").orderBy("pos")
    near = cues.withColumns({"before": F.collect_list("item").over(w.rowsBetween(-halo, -1)), "after": F.collect_list("item").over(w.rowsBetween(1, halo))})
    chunks = near.groupBy("file", "chunk").agg(F.min_by("before", "pos").alias("context_before"), F.array_sort(F.collect_list(F.struct("pos", "item"))).alias("rows"), F.max_by("after", "pos").alias("context_after"))
    chunks = chunks.withColumn("target_items", F.transform("rows", lambda x: x["item"]))
    return chunks.select("file", "chunk", F.transform("target_items", lambda x: x["i"].cast("long")).alias("targets"), F.size("rows").alias("n"), F.to_json(F.struct("context_before", "target_items", "context_after")).alias("request"))


def signed(asked: DataFrame, **settings: str) -> DataFrame:
    """Adds the signature of request and settings, by which replies are cached; an edit changes only chunks that hold or adjoin it."""
    parts = [F.col("request"), *[F.lit(f"{k}={settings[k]}") for k in sorted(settings)]]
    return asked.withColumn("signature", F.sha2(F.concat_ws("\x1f", *parts), 256))


def ask(asked: DataFrame, model: Callable[[str], str], attempts: int = 3, wait_s: float = 1.5) -> DataFrame:
    """Adds ``reply`` and ``error``; a request that fails is tried again after a wait that grows, and its last error is told, not raised."""
    ship(asked.sparkSession)

    @F.pandas_udf("reply string, error string")
    def replies(texts: pd.Series) -> pd.DataFrame:
        def one(text: str):
            error = None
            for k in range(attempts):
                if k:
                    time.sleep(wait_s * k)
                try:
                    return model(text), None
                except Exception as e:  # noqa: BLE001 - a model may fail in any way
                    error = f"{type(e).__name__}: {e}"
            return None, error

        return pd.DataFrame([one(t) for t in texts], columns=["reply", "error"])

    out = asked.withColumn("_r", replies("request"))
    return out.withColumns({"reply": F.col("_r.reply"), "error": F.col("_r.error")}).drop("_r")


def with_cache(asked: DataFrame, cache: DataFrame, model: Callable[[str], str], **retry) -> DataFrame:
    """Signed requests with replies from the cache (signature, status, reply) where it has one that is ok; only the rest are asked."""
    held = cache.where("status = 'ok'").groupBy("signature").agg(F.max("reply").alias("reply"))
    hits = asked.join(held, "signature").withColumns({"error": F.lit(None).cast("string"), "cached": F.lit(True)})
    return hits.unionByName(ask(asked.join(held, "signature", "left_anti"), model, **retry).withColumn("cached", F.lit(False)))


def translations(replied: DataFrame) -> DataFrame:
    """file, chunk, i, text, flags of replies that are arrays of {i, zh, flags}; the last of an index counts, other flags are left out.

    Indexes that were not asked for are no rows; ``incomplete`` tells which are missing.
    """
    rows = json_rows(F.col("reply"), "struct<i:string,zh:string,flags:array<string>>")
    told = replied.select("file", "chunk", "targets", F.posexplode(rows).alias("k", "x"))
    told = told.select("file", "chunk", "k", "targets", F.expr("try_cast(x.i AS bigint)").alias("i"), trimmed(F.col("x.zh")).alias("text"), F.array_intersect(F.transform(F.coalesce("x.flags", F.array().cast("array<string>")), trimmed), F.array(*map(F.lit, FLAGS))).alias("flags"), F.col("x.zh").isNotNull().alias("has"))
    kept = told.where(F.col("has") & F.array_contains("targets", F.col("i")))
    return kept.groupBy("file", "chunk", "i").agg(F.max_by(F.struct("text", "flags"), "k").alias("m")).select("file", "chunk", "i", "m.text", "m.flags")


def findings(replied: DataFrame, stage: str = "light") -> DataFrame:
    """file, chunk, i, problem, suggest, stage of replies that are arrays of {i, problem, suggest}, for indexes asked and with both texts."""
    rows = json_rows(F.col("reply"), "struct<i:string,problem:string,suggest:string>")
    told = replied.select("file", "chunk", "targets", F.explode(rows).alias("x"))
    told = told.select("file", "chunk", "targets", F.expr("try_cast(x.i AS bigint)").alias("i"), trimmed(F.col("x.problem")).alias("problem"), trimmed(F.col("x.suggest")).alias("suggest"))
    return told.where(F.array_contains("targets", F.col("i")) & (F.col("problem") != "") & (F.col("suggest") != "")).drop("targets").withColumn("stage", F.lit(stage))


def incomplete(asked: DataFrame, done: DataFrame) -> DataFrame:
    """file, chunk, i of targets without a row in ``done``."""
    return asked.select("file", "chunk", F.explode("targets").alias("i")).join(done, ["file", "chunk", "i"], "left_anti")


def complete_chunks(asked: DataFrame, done: DataFrame) -> DataFrame:
    """Requests of which every target has a row in ``done``: what a run that stopped need not ask again."""
    return asked.join(incomplete(asked, done).select("file", "chunk").distinct(), ["file", "chunk"], "left_anti")


def reusable_groups(groups: DataFrame, items: DataFrame) -> DataFrame:
    """Former groups (file, chunk, i) that still stand whole among ``items`` (file, i); a group with any item gone is dropped."""
    now = items.select("file", "i").distinct().withColumn("_here", F.lit(1))
    whole = Window.partitionBy("file", "chunk")
    return groups.join(now, ["file", "i"], "left").withColumn("_n", F.count_if(F.col("_here").isNull()).over(whole)).where("_n = 0").select("file", "chunk", "i")


def plan(light: DataFrame, deep: DataFrame) -> DataFrame:
    """Both passes of checking (file, pos, chunk) as one table."""
    return light.withColumn("stage", F.lit("light")).unionByName(deep.withColumn("stage", F.lit("deep")))


def timing(chunks: DataFrame) -> DataFrame:
    """chunks (file, seconds, cached, attempts): total time, mean of chunks that were asked, counts."""
    return chunks.groupBy("file").agg(F.count("*").alias("chunks"), F.sum("seconds").alias("seconds"), F.avg(F.when(~F.col("cached"), F.col("seconds"))).alias("mean_asked"), F.count_if("cached").alias("cached"), F.count_if(F.col("attempts") > 1).alias("retried"))


def probe_verdict(probes: DataFrame, slow_s: float = 12.0) -> DataFrame:
    """One verdict for each model of its probes (model, ord, style, no_thinking, http_code, elapsed_s, content, thinks).

    A probe with ``http_code`` failed.  Failures come first: of plain requests by the
    first code, of others alone as a rejected setting; then empty, slow or malformed
    replies, then reasoning that was to be off.
    """
    failed = F.col("http_code").isNotNull()
    text = trimmed(F.col("content"))
    bad_json = ~failed & (F.col("style") == "json") & ~(text.startswith("{") & text.endswith("}"))
    s = probes.groupBy("model").agg(
        F.min_by("http_code", F.when(failed, F.col("ord"))).alias("code"), F.max(~failed & ~F.col("no_thinking")).alias("plain_ok"), F.max(failed & F.col("no_thinking")).alias("quiet_failed"),
        F.max(~failed & (text == "")).alias("empty"), F.count_if(~failed & (F.col("elapsed_s") > slow_s)).alias("slow"), F.max(bad_json).alias("bad_json"), F.max(~failed & F.col("no_thinking") & F.col("thinks")).alias("loud"),
    )
    by_code = F.when(F.col("code") == 401, "auth_failed").when(F.col("code") == 404, "model_not_found").when(F.col("code") >= 500, "model_load_failed").otherwise("backend_http_error")
    verdict = (
        F.when(F.col("code").isNotNull() & F.col("plain_ok") & F.col("quiet_failed"), "no_thinking_payload_rejected").when(F.col("code").isNotNull(), by_code)
        .when(F.col("empty") | (F.col("slow") >= 2) | F.col("bad_json"), "too_slow_reasoning_model").when(F.col("loud"), "no_thinking_not_effective").otherwise("ok_for_translation")
    )
    return s.select("model", verdict.alias("verdict"))


def overlay(layers: list[DataFrame], key: str = "setting") -> DataFrame:
    """Settings (setting, value) from layers in order of weight: the first with a value that is not null counts."""
    ranked = None
    for k, layer in enumerate(layers):
        rows = layer.where("value IS NOT NULL").select(key, "value", F.lit(k).alias("layer"))
        ranked = rows if ranked is None else ranked.unionByName(rows)
    return ranked.groupBy(key).agg(F.min_by("value", "layer").alias("value"), F.min("layer").alias("layer"))


def preflight(profiles: DataFrame, required: list[str], sources: list[str], stages: tuple[str, ...] = ("asr", "translate", "qc")) -> DataFrame:
    """Errors (run, error) of run profiles, one row for each rule that is broken; a valid profile has none.

    Columns: run, confirmed, confirmation_source, confirmation_text, confirmed_items,
    questions_presented, questionnaire (text), questionnaire_sha256, quality_mode,
    output_format, scope, selected_dirs, selected_files, scope_summary,
    wav_choice_required, wav_strategy, wav_report, and ``stages``: map of stage to
    struct(backend, model, base_url).
    """
    blank = lambda c: trimmed(F.col(c)) == ""
    true = lambda c: F.coalesce(F.col(c), F.lit(False))
    none = F.array().cast("array<string>")
    has = lambda name: F.array_contains(F.coalesce("confirmed_items", none), name)
    empty = lambda c: F.size(F.coalesce(F.col(c), none)) == 0
    one_of = lambda c, *v: F.coalesce(F.col(c).isin(*v), F.lit(False))
    scope = lambda s: F.coalesce(F.col("scope") == s, F.lit(False))
    rules = [(~true("confirmed"), "not_confirmed"), (~one_of("confirmation_source", *sources), "bad_confirmation_source")]
    rules += [(~has(item), f"unconfirmed:{item}") for item in sorted(required)]
    rules += [
        (one_of("confirmation_source", "user_default_authorized") & blank("confirmation_text"), "no_confirmation_text"),
        (~true("questions_presented"), "questions_not_presented"),
        (F.col("questionnaire").isNull() | blank("questionnaire_sha256"), "no_questionnaire"),
        (F.col("questionnaire").isNotNull() & ~blank("questionnaire_sha256") & (F.sha2("questionnaire", 256) != F.col("questionnaire_sha256")), "questionnaire_changed"),
        (~one_of("quality_mode", "draft", "standard", "premium", "polish"), "bad_quality_mode"),
        (~one_of("output_format", "vtt", "srt", "both"), "bad_output_format"),
        (~one_of("scope", "all", "selected_dirs", "selected_files"), "bad_scope"),
        (scope("selected_dirs") & empty("selected_dirs"), "no_selected_dirs"),
        (scope("selected_files") & empty("selected_files"), "no_selected_files"),
        (scope("all") & blank("scope_summary"), "no_scope_summary"),
    ]
    if "asr" in stages:
        asked = true("wav_choice_required")
        rules += [(asked & ~one_of("wav_strategy", "mp3_cache", "original_wav"), "no_wav_strategy"), (asked & blank("wav_report"), "no_wav_report"), (asked & ~has("wav_only_asr_strategy"), "unconfirmed:wav_only_asr_strategy")]
    for name in stages:
        part = lambda field: trimmed(F.try_element_at("stages", F.lit(name))[field])  # noqa: B023, E731
        off = part("backend").isin("none", "off")
        rules += [(part("backend") == "", f"{name}:no_backend"), (part("model") == "", f"{name}:no_model")]
        if name == "asr":
            rules.append((off, "asr:off"))
        else:
            rules += [(~off & (part("base_url") == ""), f"{name}:no_base_url"), (~off & F.lower(part("model")).isin(RECOGNISERS), f"{name}:not_a_chat_model")]
    return profiles.select("run", F.explode(F.array_compact(F.array(*[F.when(test, code) for test, code in rules]))).alias("error"))
