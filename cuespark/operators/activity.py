"""Which stretches of a recording have energy but no recognised speech.

Frames are rows (file, pos, start_s, end_s, left_rms, right_rms); cues are
(file, pos, start_ms, end_ms, content).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespark.functions.text import compact, dbfs
from cuespark.operators import carried

# Recognised texts that are sounds or fillers rather than speech.
WEAK_TEXTS = ["…", "……", "...", "。。", "。。。", "ん", "んっ", "うん", "ううん", "あ", "あっ", "ああ", "はぁ", "はあ", "ハァ", "ふぅ", "ふう", "ちゅ", "ちゅっ", "チュ", "チュッ", "嗯", "嗯嗯", "啊", "啊啊", "哈", "哈啊"]
# Signs that two-letter noise holds, and sounds that short texts hold.
FILLER_SIGNS = r"[…。.、,・~ー\-]"
SHORT_SOUNDS = "ん|あ|は|ふ|ちゅ|嗯|啊|哈"
CONFIDENCE = ("low", "medium", "high")
# In weak_text, seconds and characters of a long cue that says little; in scored, points and the words that
# tell of them; in candidates, shares and trust that make a side and a tier, and words that every candidate has.


def weak_text(text: Column, seconds: Column) -> Column:
    """True for texts that hardly show speech: blank, filler, signs only, few letters, or little text for their time."""
    t = compact(text)
    n = F.length(t)
    return (
        (n == 0)
        | F.lower(t).isin(WEAK_TEXTS)
        | ~t.rlike(r"[\p{L}\p{N}぀-ヿ一-鿿]")
        | ((n >= 3) & (F.size(F.array_distinct(F.split(t, ""))) <= 2) & t.rlike(FILLER_SIGNS))
        | ((n <= 4) & t.rlike(SHORT_SOUNDS))
        | ((seconds >= 2.5) & (n <= 4))
        | ((seconds >= 4.0) & (n / F.greatest(seconds, F.lit(0.1)) <= 1.0))
    )


#: Seconds of the shortest class of bins, how much longer each next is, and how many there are.
BIN_S, LONGER, CLASSES = 60, 8, 7


def coverage(frames: DataFrame, cues: DataFrame, clip: int = 120) -> DataFrame:
    """Frames with ``state`` (none, weak, strong) and ``heard``: the texts of cues that overlap them, only strong ones if there is one.

    Joined by file and bins of time, so that a long recording is the work of many
    tasks.  A cue is cut into bins of a class that is about its length, so it lies in
    two or three whatever its length; a frame looks in the bins of the classes that its
    file has.  A pair that shares several bins counts in its first.
    """
    seconds = (F.col("end_ms") - F.col("start_ms")) / 1000
    width = F.lit(BIN_S) * F.pow(F.lit(LONGER), F.col("class"))
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor(F.greatest(a, b) / width)))
    c = cues.select("file", F.col("pos").alias("c_pos"), (F.col("start_ms") / 1000).alias("c_start"), (F.col("end_ms") / 1000).alias("c_end"), compact(F.col("content")).alias("c_text"), weak_text(F.col("content"), seconds).alias("c_weak"))
    c = c.withColumn("class", F.least(F.lit(CLASSES - 1), F.greatest(F.lit(0), F.ceil(F.log(float(LONGER), F.greatest(F.lit(1.0), (F.col("c_end") - F.col("c_start")) / BIN_S))))).cast("int"))
    classes = c.groupBy("file").agg(F.collect_set("class").alias("classes"))
    c = c.withColumn("bin", bins(F.col("c_start"), F.col("c_end")))
    f = frames.select("file", "pos", "start_s", "end_s").join(classes, "file").withColumn("class", F.explode("classes")).drop("classes").withColumn("bin", bins(F.col("start_s"), F.col("end_s")))
    meets = (F.col("c_start") < F.col("end_s")) & (F.col("c_end") > F.col("start_s")) & (F.col("bin") == F.floor(F.greatest("c_start", "start_s") / width))
    met = f.join(c, ["file", "class", "bin"]).where(meets).groupBy("file", "pos").agg(F.array_sort(F.collect_list(F.struct("c_pos", "c_weak", "c_text"))).alias("met"), F.min("c_weak").alias("weak"))
    kept = F.filter("met", lambda x: F.col("weak") | ~x["c_weak"])
    met = met.select("file", "pos", F.when(F.col("weak"), "weak").otherwise("strong").alias("state"), F.substring(F.array_join(F.transform(kept, lambda x: x["c_text"]), " / "), 1, clip).alias("heard"))
    return frames.join(met, ["file", "pos"], "left").withColumns({"state": F.coalesce("state", F.lit("none")), "heard": F.coalesce("heard", F.lit(""))})


def scored(frames: DataFrame, threshold_db: float | None = None, side_db: float = 6.0, margin_db: float = 10.0) -> DataFrame:
    """Frames with state, as ``coverage`` gives them, and levels, noise floor, threshold, active, side, score and reasons.

    The floor is the nearest-rank fifth of a file's levels; active frames reach the
    threshold, which is the floor and a margin, -48 dB at least, unless given.
    """
    left, right = dbfs(F.col("left_rms")), dbfs(F.col("right_rms"))
    f = frames.withColumns({"left_db": left, "right_db": right}).withColumn("level_db", F.greatest("left_db", "right_db"))
    f = carried.with_value_of_rank(f, "level_db", lambda n: F.bround((n - 1) * 0.2) + 1, "floor_db")
    f = f.withColumn("threshold_db", F.greatest(F.col("floor_db") + margin_db, F.lit(-48.0)) if threshold_db is None else F.lit(float(threshold_db)))
    f = f.withColumns({"active": F.col("level_db") >= F.col("threshold_db"), "differs_db": F.abs(F.col("left_db") - F.col("right_db"))})
    f = f.withColumn("side", F.when(F.col("differs_db") < side_db, "balanced").when(F.col("left_db") > F.col("right_db"), "left").otherwise("right"))
    one_sided = F.col("side") != "balanced"
    points = [
        (F.col("active"), F.lit("channel_energy_active"), 1.0),
        (F.col("state") == "none", F.lit("main_asr_gap"), 1.25),
        (F.col("state") == "weak", F.lit("weak_main_asr_coverage"), 0.9),
        (F.col("state") == "strong", F.lit("strong_main_asr_coverage"), -0.5),
        (one_sided, F.concat("side", F.lit("_dominant")), 0.75),
        (~one_sided & F.col("active"), F.lit("both_channels_active_or_balanced"), 0.3),
        (F.col("level_db") >= F.col("threshold_db") + 8, F.lit("strong_energy"), 0.4),
    ]
    score = F.lit(0.0)
    for test, _, worth in points:
        score = score + F.when(test, worth).otherwise(0.0)
    return f.withColumns({"score": score, "reasons": F.array_compact(F.array(*[F.when(test, why) for test, why, _ in points]))})


def candidates(frames: DataFrame, merge_s: float = 0.75, least_s: float = 1.0, loud_db: float = 5.0) -> DataFrame:
    """Runs of scored frames that are active and unexplained by speech, or louder on one side, with averages, shares, side and confidence.

    A run ends at a frame of another kind (also one between candidates by ``pos``) and
    at a hole in time of more than ``merge_s``.
    """
    kept = frames.where(F.col("active") & ((F.col("state") != "strong") | (F.col("differs_db") >= loud_db)))
    seen = carried.with_previous(carried.ranged(kept, "pos", among=frames), ["pos"], F.struct("pos", "end_s"), "last")
    breaks = F.coalesce((F.col("pos") != F.col("last.pos") + 1) | (F.col("start_s") > F.col("last.end_s") + merge_s), F.lit(True))
    runs = carried.with_runs(seen, ["pos"], breaks, "run")
    share = lambda test: F.avg(test.cast("double"))
    out = runs.groupBy("file", "run").agg(
        F.min("start_s").alias("start_s"), F.max_by("end_s", "pos").alias("end_s"), F.count("*").alias("frames"),
        F.avg("left_db").alias("avg_left_db"), F.avg("right_db").alias("avg_right_db"), F.max("level_db").alias("max_db"), F.avg("score").alias("_score"),
        share(F.col("state") == "none").alias("gap_ratio"), share(F.col("state") == "weak").alias("weak_ratio"), share(F.col("state") != "strong").alias("_unexplained"), share(F.col("active")).alias("active_ratio"),
        share(F.col("side") == "left").alias("_left"), share(F.col("side") == "right").alias("_right"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("reasons")))).alias("reasons"),
    ).where(F.col("end_s") - F.col("start_s") >= least_s)
    # Rounded, as averages in binary end a bit beside a bound that they meet; of n frames, others differ from it by 1/20n at least.
    trust = F.round(F.col("_score") + F.col("_unexplained") * 0.6 + F.col("active_ratio") * 0.4, 9)
    side = F.when((F.col("_left") > F.col("_right")) & (F.col("_left") >= 0.4), "left").when((F.col("_right") > F.col("_left")) & (F.col("_right") >= 0.4), "right").otherwise("balanced")
    tier = F.when((trust >= 2.7) & (F.col("_unexplained") >= 0.6), "high").when(trust >= 1.8, "medium").otherwise("low")
    more = F.array(F.lit("speech_not_confirmed_energy_only"), F.lit("needs_user_disambiguation"))
    return out.select("file", "start_s", "end_s", "frames", "avg_left_db", "avg_right_db", "max_db", "gap_ratio", "weak_ratio", F.col("_unexplained").alias("gap_or_weak_ratio"), "active_ratio", side.alias("side"), trust.alias("trust"), tier.alias("confidence"), F.concat("reasons", more).alias("reasons"))


def at_least(found: DataFrame, tier: str) -> DataFrame:
    """Candidates of this confidence or more."""
    return found.where(F.col("confidence").isin(*CONFIDENCE[CONFIDENCE.index(tier):]))
