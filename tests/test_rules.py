import json
import random
import re

import pytest
from pyspark.sql import functions as F

from cuespark.functions import patterns
from cuespark.operators import readability, rules
from cuespark.sources import cue_files, json_files


def by_hand(texts, table):
    return sorted((k, n, m[0]) for k, t in enumerate(texts) for n, p in table for m in re.compile(p, re.IGNORECASE).finditer(t))


def found(spark, texts, table):
    df = spark.createDataFrame([(k, 1, t) for k, t in enumerate(texts)], "file long, pos long, content string")
    return sorted((r.file, r.rule, r.matched) for r in rules.findings(df, table).collect())


def test_matches_of_any_script_and_case(spark):
    texts = ["É ＡＢＣ Ж x　y", "é ａｂｃ ж X Y", "STRASSE straße ſtop Kelvin İI ıi", "ΑΣ ας ασ Σ", "感谢您的观看 JSON", "", "aaa\nbbb", "x" * 50_000 + "é"]
    table = [("a", "é"), ("b", "ａｂｃ"), ("c", "ж"), ("d", "[ａ-ｚ]+"), ("e", r"x\sy"), ("f", r"\bж"), ("g", "(?P<n>s)top"), ("h", "kelvin"), ("i", "is?"), ("j", "σ$|ας"), ("k", "straSSe|STRASSE"), ("l", "感谢(?:您的)?观看|谢谢观看"), ("m", "json"), ("n", "x*é"), ("o", ""), ("p", "(?<=a)a+(?=\n)"), ("q", "^b|^a"), ("r", "(?:ab|a){2,}"), ("s", "i̇?")]
    want = by_hand(texts, table)
    assert found(spark, texts, table) == want and {n for _, n, _ in want} >= set("abcdefghjlmnop")
    assert found(spark, texts, []) == []
    nulls = spark.createDataFrame([(1, 1, None), (None, None, "É")], "file long, pos long, content string")
    assert [tuple(r) for r in readability.rule_findings(nulls, [("a", "é")]).collect()] == [(None, None, "a", "É")]


@pytest.mark.parametrize("seed", range(6))
def test_literals_lose_no_match(seed):
    """Patterns at random: a text that matches always holds a literal of the pattern."""
    rng = random.Random(seed)
    letters = "abIiıİsſSkKσςΣé"

    def some(depth):
        kind = rng.randrange(9 if depth else 2)
        if kind < 2:
            return "".join(rng.choice(letters) for _ in range(rng.randint(1, 3)))
        if kind == 2:
            return f"(?:{some(depth - 1)}|{some(depth - 1)})"
        if kind == 3:
            return f"({some(depth - 1)}){rng.choice(['*', '?', '+', '{2}', '{0,2}', '+?', '++'])}"
        if kind == 4:
            return f"[{some(0)}]"
        if kind == 5:
            return rng.choice(["^", r"\b", "$", "(?=a)", "(?!b)", "(?<=s)", "."])
        return some(depth - 1) + some(depth - 1)

    matched = 0
    for _ in range(1500):
        p = some(3)
        text = "".join(rng.choice(letters + " ") for _ in range(12))
        need = patterns.literals(p)
        if re.search(p, text, re.IGNORECASE):
            matched += 1
            assert need is None or any(x in patterns.folded(text) for x in need), (p, text, need)
    assert matched > 200


def test_only_rules_that_may_match_are_run():
    many = [f"word{i}[a-z]+" for i in range(500)] + [r"\d+"]
    m = patterns.Matcher(many)
    assert m.to_run("nothing of it") == [500] and set(m.to_run("WORD77x and word3")) == {7, 77, 3, 500}
    assert patterns.literals("(?:alpha|beta)+x?") == {"alpha", "beta"} and patterns.literals("a?b*") is None


def test_rule_table_to_findings(spark):
    ok = {"name": " n ", "pattern": "É+", "problem": "p", "suggestion": "s"}
    read = lambda *tables: json_files.rules(spark.createDataFrame([(f"t{k}", json.dumps({"version": 1, "patterns": t})) for k, t in enumerate(tables)], "file string, value string"))
    texts = spark.createDataFrame([("a.srt", 3, None, "ééé"), ("b.txt", None, 7, "no É")], "file string, idx long, line long, content string")
    got = sorted(tuple(r) for r in rules.findings(texts, read([ok], [{**ok, "name": "m", "pattern": "(?P<x>n)o"}])).collect())
    assert got == [("a.srt", 3, None, "n", "ééé", "p", "s", "t0"), ("b.txt", None, 7, "m", "no", "p", "s", "t1"), ("b.txt", None, 7, "n", "É", "p", "s", "t0")]
    broken = read([ok, {**ok, "name": "x", "pattern": "("}, {**ok, "problem": " "}, {"name": "y"}, {**ok, "name": "z", "pattern": "(?P<n>x)"}])
    assert sorted((r.k, r.error) for r in json_files.rule_errors(broken).collect()) == [(1, "invalid_regex"), (2, "duplicate_name"), (2, "missing:problem"), (3, "missing:pattern"), (3, "missing:problem"), (3, "missing:suggestion")]
    with pytest.raises(ValueError, match="invalid_regex"):
        rules.findings(texts, broken)
    assert rules.findings(texts, read([])).count() == 0
    told = spark.createDataFrame([("谢谢观看 json",)], "content string")
    assert sorted((r.rule, r.matched) for r in rules.findings(told).collect()) == [("asr_thanks", "谢谢观看"), ("model_artifact", "json")]


BLANKS = ["", " ", "\t", "　", "\x0c", "\x0b", "\x85", "\xa0", " ", " ", "\x1c", " 　\t"]


def cues_by_hand(text):
    """idx, start, end, content by lines; None if the file is not well formed."""
    lines, out, at = text.replace("\r\n", "\n").replace("\r", "\n").split("\n"), [], 0
    stamp = lambda t: re.match(r"^(\d{1,2}):(\d{2}):(\d{2})[,.](\d{1,3})$", t)
    ms = lambda m: ((int(m[1]) * 60 + int(m[2])) * 60 + int(m[3])) * 1000 + int(m[4].ljust(3, "0"))
    while at < len(lines):
        if not lines[at].strip():
            at += 1
            continue
        block = []
        while at < len(lines) and lines[at].strip():
            block.append(lines[at])
            at += 1
        sides = [s.split()[:1] for s in block[1].split("-->", 1)] if len(block) > 1 else []
        if not block[0].strip().isdigit() or len(sides) < 2 or not all(s and stamp(s[0]) for s in sides):
            return None
        out.append((int(block[0].strip()), *[ms(stamp(s[0])) for s in sides], "\n".join(block[2:])))
    return out


def test_blank_lines_of_any_kind_end_a_cue(spark):
    rng = random.Random(2)
    texts = []
    for b in BLANKS:
        texts += [f"{b}\n1\n00:00:01,000 --> 00:00:02,000\nA{b}\n{b}\n{b}\n2\r\n 00:00:03.5\t-->00:00:04,25 x:1\r\n{b}B\nC\n{b}", f"1\n{b}\n00:00:01,000 --> 00:00:02,000\nA", f"{b}1{b}\n{b}00:00:01,000{b} --> 00:00:02,000{b}\n"]
    pieces = ["1", "2", "\n", "\n", "\n", "00:00:01,000 --> 00:00:02,000", "00:00:01,000 x --> 00:00:02,000 y", "00:00:01,000 --> 00:00:02,000y", "text", *BLANKS]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randint(3, 14))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "file long, value string")
    got = {}
    for r in cue_files.parse_srt_files(df).orderBy("file", "pos").collect():
        got.setdefault(r.file, []).append(r.error or (r.idx, r.start_ms, r.end_ms, r.content))
    for k, t in enumerate(texts):
        want = cues_by_hand(t)
        assert got.get(k, []) == (["parse_error"] if want is None else want), (t, want)
    assert df.where(F.col("file") < 3).count() == 3
