"""Closing a review: every candidate issue decided, with evidence, before anything is applied.

Expected items: issue_id, file, idx, category, severity.  Reviewed items: issue_id,
ord, file, idx, decision, decision_reason, evidence_level, evidence_summary,
replacement, corrected, suggest, current, review_method, review_required.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuespark.functions.text import decision, first_filled, trimmed

# Categories that need evidence, its levels, and words that name a source.
HIGH_RISK = ("semantic", "omission", "hallucination", "terminology", "role_tone")
CONFIRMED = ("script_confirmed", "audio_confirmed", "ja_context_confirmed")
SOURCES = ("台本", "音频", "音轨", "日文", "ja", "原文", "上下文", "asr")


def unsupported_expansion(category: Column, replacement: Column, current: Column, evidence: Column) -> Column:
    """True for a changed text of a category at risk whose evidence names no source."""
    named = F.exists(F.array(*map(F.lit, SOURCES)), lambda s: F.lower(evidence).contains(s))
    return category.isin(*HIGH_RISK) & (replacement != "") & (replacement != current) & ~named


def items(expected: DataFrame, reviewed: DataFrame) -> DataFrame:
    """A row for every id of either side: decision, effective_decision, status, apply_allowed and errors.

    The last of repeated reviews counts and the repetition is an error; two accepted
    items for one cue are both invalid; reviews of unknown ids have status ``unknown``.
    Category and severity are those expected, whatever the review says.
    """
    newest = Window.partitionBy("issue_id").orderBy(F.desc("ord"))
    r = reviewed.withColumns({"_k": F.row_number().over(newest), "_times": F.count("*").over(Window.partitionBy("issue_id"))}).where("_k = 1")
    text = lambda c: trimmed(F.col(c))
    r = r.select(
        "issue_id", "_times", text("file").alias("r_file"), F.col("idx").alias("r_idx"), decision(F.col("decision"), "pending").alias("decision"), text("decision_reason").alias("decision_reason"),
        first_filled(F.col("evidence_level"), F.lit("insufficient")).alias("evidence_level"), text("evidence_summary").alias("evidence_summary"), first_filled(F.col("replacement"), F.col("corrected")).alias("replacement"),
        first_filled(F.col("replacement"), F.col("corrected"), F.col("suggest")).alias("_offered"), text("current").alias("current"), text("review_method").alias("review_method"), F.coalesce("review_required", F.lit(False)).alias("review_required"),
    )
    e = expected.select("issue_id", F.lit(True).alias("_known"), "file", "idx", text("category").alias("category"), text("severity").alias("severity"))
    j = e.join(r, "issue_id", "full_outer")
    accept, reject, defer = (F.col("decision") == d for d in ("accept", "reject", "defer"))
    weak = (F.col("evidence_summary") == "") | (F.col("evidence_level") == "insufficient")
    confirmed = F.col("evidence_level").isin(*CONFIRMED)
    rules = [
        (~(accept | reject | defer), "bad_decision"),
        (~confirmed & (F.col("evidence_level") != "insufficient"), "bad_evidence_level"),
        (accept & (F.col("replacement") == ""), "no_replacement"),
        ((accept | reject | defer) & (F.col("decision_reason") == ""), "no_reason"),
        (accept & weak, "no_evidence"),
        (accept & F.col("category").isin(*HIGH_RISK) & ~confirmed, "unconfirmed_high_risk"),
        (defer & (F.col("review_method") == ""), "no_review_method"),
        (defer & ~F.col("review_required"), "review_not_required"),
    ]
    own = F.array_compact(F.array(*[F.when(test, code) for test, code in rules]))
    unreviewed, unknown = F.col("_times").isNull(), F.col("_known").isNull()
    j = j.withColumn("errors", F.when(unreviewed, F.array(F.lit("missing_decision"))).when(unknown, F.array(F.lit("unknown_item"))).otherwise(own))
    put_off = accept & unsupported_expansion(F.col("category"), F.col("_offered"), F.col("current"), F.col("evidence_summary"))
    j = j.withColumn("effective_decision", F.when(put_off, "defer").when(~unknown, F.col("decision")))
    ready = ~unreviewed & ~unknown & (F.col("effective_decision") == "accept") & (F.size("errors") == 0)
    j = j.withColumns({"apply_allowed": F.coalesce(ready, F.lit(False)), "file": F.coalesce(F.nullif("r_file", F.lit("")), "file"), "idx": F.coalesce("r_idx", "idx")})
    at_once = F.sum(F.col("apply_allowed").cast("int")).over(Window.partitionBy("file", "idx"))
    j = j.withColumn("_clash", F.col("apply_allowed") & (at_once > 1))
    status = (
        F.when(unreviewed, "unresolved").when(unknown, "unknown").when(F.col("_clash"), "invalid").when(F.col("apply_allowed"), "ready_to_apply")
        .when(F.col("effective_decision") == "defer", "deferred").when(reject & (F.size("errors") == 0), "rejected").otherwise("invalid")
    )
    also = F.array_compact(F.array(F.when(F.col("_clash"), "several_for_one_cue"), F.when(F.col("_times") > 1, "repeated_review")))
    return j.select("issue_id", "file", "idx", "category", "severity", "decision", "effective_decision", status.alias("status"), (F.col("apply_allowed") & ~F.col("_clash")).alias("apply_allowed"), "evidence_level", "evidence_summary", "decision_reason", "replacement", "review_method", F.concat("errors", also).alias("errors"))


def summary(closed: DataFrame) -> DataFrame:
    """One row: whether the review passes, and items by status; passes if no item has an error."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return closed.agg(
        F.when(F.count_if(F.size("errors") > 0) == 0, "pass").otherwise("fail").alias("result"), F.count_if(F.col("status") != "unknown").alias("total"),
        *[n(s) for s in ("ready_to_apply", "rejected", "deferred", "invalid", "unresolved", "unknown")], F.count_if(F.col("effective_decision") == "defer").alias("manual_review"),
    )


def manual_queue(closed: DataFrame) -> DataFrame:
    """What people still must review, with a method and a reason for each."""
    return closed.where("effective_decision = 'defer'").select("issue_id", "file", "idx", "category", "severity", first_filled(F.col("decision_reason"), F.lit("Evidence requires review.")).alias("reason"), "evidence_level", "evidence_summary", first_filled(F.col("review_method"), F.lit("audio_or_human_review")).alias("review_method"))


def authorised(reviewed: DataFrame, closed: DataFrame) -> DataFrame:
    """Accepted reviews (issue_id, file, idx, replacement, corrected, suggest, evidence_level, decision) with ``refusal``: the first reason why the closure does not cover them, or null."""
    c = closed.where("status <> 'unknown'").select("issue_id", F.lit(True).alias("_in"), F.col("apply_allowed").alias("_ok"), F.col("file").alias("_file"), F.col("idx").alias("_idx"), F.col("replacement").alias("_text"), F.col("evidence_level").alias("_level"))
    j = reviewed.where(decision(F.col("decision"), "defer") == "accept").join(c, "issue_id", "left")
    offered = first_filled(F.col("replacement"), F.col("corrected"), F.col("suggest"))
    same = lambda a, b: trimmed(F.col(a)) == trimmed(F.col(b))
    refusal = (
        F.when(F.col("_in").isNull(), "not_in_closure").when(~F.col("_ok"), "not_authorised").when(~same("_file", "file"), "other_file")
        .when(F.coalesce("_idx", F.lit(0)) != F.coalesce("idx", F.lit(0)), "other_index").when(trimmed(F.col("_text")) != offered, "other_replacement").when(~same("_level", "evidence_level"), "other_evidence_level")
    )
    return j.select(*[F.col(x) for x in reviewed.columns], refusal.alias("refusal"))
