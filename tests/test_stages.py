import json

from pyspark.sql import functions as F

from cuespark.operators import closure, stages

EXPECTED = "issue_id string, file string, idx int, category string, severity string"
REVIEWED = "issue_id string, ord int, file string, idx int, decision string, decision_reason string, evidence_level string, evidence_summary string, replacement string, corrected string, suggest string, current string, review_method string, review_required boolean"


def review(issue_id, word, ord=1, idx=1, reason="r", level="script_confirmed", summary="台本 p1", replacement="new", suggest="s", current="old", method="", required=False, file=""):
    return (issue_id, ord, file, idx, word, reason, level, summary, replacement, None, suggest, current, method, required)


def closed(spark, rows, n=3, category="semantic"):
    expected = spark.createDataFrame([(f"i{k}", "f", k, category, "high") for k in range(1, n + 1)], EXPECTED)
    reviewed = spark.createDataFrame(rows, REVIEWED)
    return closure.items(expected, reviewed), reviewed


BASE = [review("i1", "accept"), review("i2", "reject", idx=2), review("i3", "defer", idx=3, method="listen", required=True)]


def test_closure_of_a_sound_review(spark):
    items, reviewed = closed(spark, BASE)
    got = {r.issue_id: (r.status, r.apply_allowed, r.errors) for r in items.collect()}
    assert got == {"i1": ("ready_to_apply", True, []), "i2": ("rejected", False, []), "i3": ("deferred", False, [])}
    total = closure.summary(items).collect()[0]
    assert (total.result, total.total, total.ready_to_apply, total.rejected, total.deferred, total.manual_review) == ("pass", 3, 1, 1, 1, 1)
    assert [(r.issue_id, r.review_method) for r in closure.manual_queue(items).collect()] == [("i3", "listen")]
    allowed = spark.createDataFrame([review("i1", "accept", file="f")], REVIEWED)
    edited = spark.createDataFrame([review("i1", "accept", file="f", replacement="edited"), review("i9", "accept"), review("i2", "yes", idx=2)], REVIEWED)
    assert [r.refusal for r in closure.authorised(allowed, items).collect()] == [None]
    assert {r.issue_id: r.refusal for r in closure.authorised(edited, items).collect()} == {"i1": "other_replacement", "i9": "not_in_closure", "i2": "not_authorised"}


def test_closure_finds_each_fault(spark):
    rows = [
        review("i1", "accept", level="insufficient"), review("i3", "accept", idx=3, summary="seems right"), review("i4", "defer", idx=4), review("i5", "perhaps", idx=5), review("i6", "reject", idx=6, reason=" "),
        review("i7", "accept", idx=7), review("i8", "accept", idx=7), review("i9", "reject", ord=1, idx=9), review("i9", "reject", ord=2, idx=9), review("x", "accept"), review("i10", "accept", idx=10, replacement="", level="odd"),
    ]
    items, _ = closed(spark, rows, 10)
    got = {r.issue_id: (r.status, sorted(r.errors)) for r in items.collect()}
    assert got == {
        "i1": ("invalid", ["no_evidence", "unconfirmed_high_risk"]), "i2": ("unresolved", ["missing_decision"]), "i3": ("deferred", []), "i4": ("deferred", ["no_review_method", "review_not_required"]), "i5": ("invalid", ["bad_decision"]),
        "i6": ("invalid", ["no_reason"]), "i7": ("invalid", ["several_for_one_cue"]), "i8": ("invalid", ["several_for_one_cue"]), "i9": ("rejected", ["repeated_review"]), "x": ("unknown", ["unknown_item"]),
        "i10": ("invalid", ["bad_evidence_level", "no_replacement", "unconfirmed_high_risk"]),
    }
    total = closure.summary(items).collect()[0]
    assert (total.result, total.total, total.unknown) == ("fail", 10, 1)
    assert closed(spark, [], 0)[0].count() == 0


def asked(spark, n=5):
    rows = spark.createDataFrame([("f", k, (k - 1) // 2, k * 10, f"t{k}") for k in range(1, n + 1)], "file string, pos long, chunk long, i long, text string")
    return stages.requests(rows.select("file", "pos", "chunk", F.struct("i", "text").alias("item")), 1)


def test_requests_hold_their_surroundings(spark):
    got = {r.chunk: r for r in asked(spark).collect()}
    middle = json.loads(got[1].request)
    assert got[1].targets == [30, 40] and [x["i"] for x in middle["context_before"]] == [20] and [x["i"] for x in middle["context_after"]] == [50]
    assert json.loads(got[0].request)["context_before"] == [] and json.loads(got[2].request)["context_after"] == []


def test_replies_become_rows_and_gaps_are_told(spark):
    def model(request):
        items = json.loads(request)["target_items"]
        if any(x["i"] == 50 for x in items):
            raise ValueError("no memory")
        extra = [{"i": 999, "zh": "stray"}]
        return "```json\n" + json.dumps([{"i": str(x["i"]), "zh": f" z{x['i']} ", "flags": ["long_line", "odd"]} for x in items if x["i"] != 40] + extra) + "\n```"

    ask = asked(spark)
    replied = stages.ask(ask, model, attempts=2, wait_s=0.01)
    assert {r.chunk: r.error for r in replied.collect()} == {0: None, 1: None, 2: "ValueError: no memory"}
    rows = stages.translations(replied)
    assert sorted((r.i, r.text, r.flags) for r in rows.collect()) == [(i, f"z{i}", ["long_line"]) for i in (10, 20, 30)]
    assert sorted(r.i for r in stages.incomplete(ask, rows).collect()) == [40, 50]
    assert [r.chunk for r in stages.complete_chunks(ask, rows).collect()] == [0]


def test_findings(spark):
    reply = json.dumps([{"i": 10, "problem": "p", "suggest": "s"}, {"i": 11, "problem": "p", "suggest": "s"}, {"i": 20, "problem": " ", "suggest": "s"}])
    rows = stages.findings(asked(spark, 2).withColumns({"reply": F.lit(reply), "error": F.lit(None).cast("string")}))
    assert [(r.i, r.problem, r.suggest, r.stage) for r in rows.collect()] == [(10, "p", "s", "light")]


def test_cache_asks_only_the_rest(spark):
    signed = stages.signed(asked(spark), model="m")
    first = signed.where("chunk = 0").select("signature", F.lit("ok").alias("status"), F.lit("[]").alias("reply"))
    cache = first.unionByName(signed.where("chunk = 1").select("signature", F.lit("failed").alias("status"), F.lit("x").alias("reply")))
    got = {r.chunk: (r.cached, r.reply) for r in stages.with_cache(signed, cache, lambda t: "new").collect()}
    assert got == {0: (True, "[]"), 1: (False, "new"), 2: (False, "new")}
    assert stages.signed(asked(spark), model="n").join(signed, "signature").count() == 0


def test_groups_are_reused_whole(spark):
    groups = spark.createDataFrame([("f", 0, 1), ("f", 0, 2), ("f", 1, 3), ("f", 1, 4)], "file string, chunk long, i long")
    items = spark.createDataFrame([("f", 1), ("f", 2), ("f", 3)], "file string, i long")
    assert sorted(r.i for r in stages.reusable_groups(groups, items).collect()) == [1, 2]


def test_probe_verdicts(spark):
    schema = "model string, ord int, style string, no_thinking boolean, http_code int, elapsed_s double, content string, thinks boolean"
    ok = lambda m, k, style="plain", quiet=False, s=1.0, text="hi", thinks=False: (m, k, style, quiet, None, s, text, thinks)
    bad = lambda m, k, code, quiet=False: (m, k, "plain", quiet, code, None, None, None)
    rows = [
        ok("good", 1), ok("good", 2, "json", True, text=" {} "), bad("auth", 1, 401), bad("gone", 1, 404), bad("gone", 2, 500), bad("load", 1, 503), bad("odd", 1, 400), ok("quiet", 1), bad("quiet", 2, 400, True),
        ok("slow", 1, s=13.0), ok("slow", 2, s=20.0), ok("once", 1, s=13.0), ok("empty", 1, text=" "), ok("json", 1, "json", text="{"), ok("loud", 1, quiet=True, thinks=True),
    ]
    got = {r.model: r.verdict for r in stages.probe_verdict(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"good": "ok_for_translation", "auth": "auth_failed", "gone": "model_not_found", "load": "model_load_failed", "odd": "backend_http_error", "quiet": "no_thinking_payload_rejected", "slow": "too_slow_reasoning_model", "once": "ok_for_translation", "empty": "too_slow_reasoning_model", "json": "too_slow_reasoning_model", "loud": "no_thinking_not_effective"}


def test_overlay_and_timing(spark):
    layer = lambda *rows: spark.createDataFrame(list(rows), "setting string, value string")
    got = {r.setting: (r.value, r.layer) for r in stages.overlay([layer(("a", "1"), ("b", None)), layer(("a", "2"), ("b", "3")), layer(("c", "4"))]).collect()}
    assert got == {"a": ("1", 0), "b": ("3", 1), "c": ("4", 2)}
    times = spark.createDataFrame([("f", 1.0, True, 1), ("f", 2.0, False, 3), ("f", 4.0, False, 1), ("g", 1.0, True, 1)], "file string, seconds double, cached boolean, attempts int")
    assert sorted(tuple(r) for r in stages.timing(times).collect()) == [("f", 3, 7.0, 3.0, 1, 1), ("g", 1, 1.0, None, 1, 0)]


def test_preflight(spark):
    schema = "run string, confirmed boolean, confirmation_source string, confirmation_text string, confirmed_items array<string>, questions_presented boolean, questionnaire string, questionnaire_sha256 string, quality_mode string, output_format string, scope string, selected_dirs array<string>, selected_files array<string>, scope_summary string, wav_choice_required boolean, wav_strategy string, wav_report string, stages map<string,struct<backend:string,model:string,base_url:string>>"
    import hashlib

    digest = hashlib.sha256(b"q").hexdigest()
    parts = {"asr": ("local", "large-v3", None), "translate": ("api", "chat", "http://x"), "qc": ("off", "none", None)}
    good = ["ok", True, "user", None, ["scope"], True, "q", digest, "draft", "vtt", "all", None, None, "two folders", False, None, None, parts]
    other = ["bad", None, "auto", None, None, True, "changed", digest, "best", "vtt", "selected_dirs", [], None, None, True, None, None, {**parts, "asr": ("off", "m", None), "translate": ("api", "Whisper", " ")}]
    empty = ["none", *[None] * 17]
    rows = stages.preflight(spark.createDataFrame([tuple(good), tuple(other), tuple(empty)], schema), ["scope"], ["user"]).collect()
    found = {}
    for r in rows:
        found.setdefault(r.run, set()).add(r.error)
    assert "ok" not in found
    assert found["bad"] == {"not_confirmed", "bad_confirmation_source", "unconfirmed:scope", "questionnaire_changed", "bad_quality_mode", "no_selected_dirs", "no_wav_strategy", "no_wav_report", "unconfirmed:wav_only_asr_strategy", "asr:off", "translate:no_base_url", "translate:not_a_chat_model"}
    assert {"no_questionnaire", "bad_scope", "asr:no_backend", "qc:no_model"} <= found["none"]
