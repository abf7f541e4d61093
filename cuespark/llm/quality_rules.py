"""Quality rules combined by weak supervision, with DataFrame functions alone.

Each rule votes good (1), bad (-1) or abstains (0) on a document.  Nobody says how
far each rule can be trusted: expectation-maximisation over the votes of the whole
corpus estimates, for each rule, how often it is right on good and on bad
documents, and the share of good documents.  A document is kept by its posterior
probability of being good, not because it passes every rule.

What EM needs is the number of documents with each combination of votes.  With R
rules there are at most 3**R combinations, whatever the corpus, so the statistics
are one aggregated table of proven size; EM is a fold over it in one row.

Defined cases: a null or empty text has no words, lines or symbols and is
``base_failed``; a null ``doc_id`` is carried along; repeated rows are judged one by
one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

SPACE = r"[\x20\x09-\x0D]+"
#: Frequent function words of the languages that are expected.
STOP_WORDS = (
    "the of and to in is that for with on as it by this was are be from or at "
    "der die und das den von zu mit sich des ist im nicht ein eine auf für "
    "de la le et les des en un une est que pour dans qui par sur pas "
    "el los las del y se por con una para su al como más"
).split()
WINDOW = 8
EM_STEPS = 40
#: What EM starts from: the share of good documents, and how often a rule that votes is right.
START_GOOD, START_RIGHT_GOOD, START_RIGHT_BAD = 0.8, 0.99, 0.3
#: Documents that the start counts for in each estimate.
SMOOTHING = 10.0


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(windows: Column) -> Column:
    """Words in windows whose hash is found twice or more; ``windows`` in order of position."""

    def covered(pairs: Column) -> Column:
        same = lambda p, i: (F.get(pairs, i - 1)["h"] == p["h"]) | (F.get(pairs, i + 1)["h"] == p["h"])
        places = F.array_sort(F.transform(F.filter(pairs, lambda p, i: F.coalesce(same(p, i), F.lit(False))), lambda p: p["i"]))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        step = lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"))
        return F.aggregate(places, start, step, lambda a: a["n"])

    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(let(pairs, covered))


def features(docs: DataFrame, carried: str = "doc_id") -> DataFrame:
    """A column that is carried and the counts that the rules judge, from whole texts in one pass."""
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))
    base = docs.select(carried, text.alias("t"), words.alias("w"), F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    n = F.size("w")
    windows = F.when(n < WINDOW, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col("w"), i, WINDOW)))
    )
    base = base.withColumn("h", windows)
    count = lambda pattern: F.regexp_count("t", F.lit(pattern))
    return base.select(
        carried,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("h")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("lines", lambda line: line.rlike(r"[.!?:;…\"»)\]'][\x20\x09-\x0D]*$"))).cast("long").alias("n_ended_lines"),
        F.size(F.array_intersect("w", F.array(*[F.lit(x) for x in sorted(set(STOP_WORDS))]))).cast("long").alias("n_stop_words"),
        count(r"\p{Lu}{3,}").cast("long").alias("n_shouted"),
        count(r"[!?]{2,}").cast("long").alias("n_shouts"),
    )


def _rules() -> dict[str, Column]:
    """Votes of each rule; ratios are per word or per line."""
    c, n = F.col, F.col("n_words")
    vote = lambda bad, good: F.when(bad, -1).when(good, 1).otherwise(0)
    chars = c("word_chars")
    return {
        "length": vote(n < 20, n >= 50),
        "word_length": vote((chars < 3 * n) | (chars > 12 * n), (2 * chars >= 7 * n) & (chars <= 10 * n)),
        "symbols": vote(c("n_symbols") > 0.1 * n, c("n_symbols") < 0.03 * n),
        "symbol_density": vote(c("n_symbols") > 0.3 * n, c("n_symbols") < 0.01 * n),
        "dup_lines": vote(c("n_dup_lines") > 0.3 * c("n_lines"), c("n_dup_lines") < 0.1 * c("n_lines")),
        "repeats": vote(c("n_repeat_words") > 0.3 * n, c("n_repeat_words") < 0.1 * n),
        "stop_words": vote(c("n_stop_words") < 2, c("n_stop_words") >= 3),
        "shouting": vote(c("n_shouted") + c("n_shouts") > 0.2 * n, c("n_shouted") + c("n_shouts") < 0.05 * n),
        "endings": vote(c("n_ended_lines") < 0.2 * c("n_lines"), c("n_ended_lines") > 0.6 * c("n_lines")),
    }


RULES = ("length", "word_length", "symbols", "symbol_density", "dup_lines", "repeats", "stop_words", "shouting", "endings")


def _posterior(p: Column, votes: list[Column]) -> Column:
    """Probability of good, given parameters p(good, rg[], rb[]): a rule that abstains says nothing."""

    def score(prior: Column, right: str, sign: int) -> Column:
        terms = [F.when(v == 0, 0.0).when(v == sign, F.log(p[right][i])).otherwise(F.log(1 - p[right][i])) for i, v in enumerate(votes)]
        return F.log(prior) + reduce(lambda a, b: a + b, terms)

    return 1 / (1 + F.exp(score(1 - p["good"], "rb", -1) - score(p["good"], "rg", 1)))


def _parameters(patterns: Column, steps: int = EM_STEPS) -> Column:
    """EM over an array of (v array of votes, n documents): struct(good, rg, rb)."""
    kind = "struct<good:double,rg:array<double>,rb:array<double>>"
    k = len(RULES)
    start = F.struct(F.lit(START_GOOD).alias("good"), F.array_repeat(F.lit(START_RIGHT_GOOD), k).alias("rg"), F.array_repeat(F.lit(START_RIGHT_BAD), k).alias("rb")).cast(kind)

    def step(p: Column, _: Column) -> Column:
        weighed = F.transform(patterns, lambda x: F.struct(x["v"].alias("v"), x["n"].cast("double").alias("n"), _posterior(p, [x["v"][i] for i in range(k)]).alias("q")))

        def estimate(rows: Column) -> Column:
            total = lambda f: F.aggregate(rows, F.lit(0.0), lambda a, x: a + f(x))
            right = lambda i, sign, q, first: (total(lambda x: F.when(x["v"][i] == sign, x["n"] * q(x)).otherwise(0.0)) + SMOOTHING * first) / (total(lambda x: F.when(x["v"][i] != 0, x["n"] * q(x)).otherwise(0.0)) + SMOOTHING)
            inside = lambda x: F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), x))
            good, bad = (lambda x: x["q"]), (lambda x: 1 - x["q"])
            return F.struct(
                inside((total(lambda x: x["n"] * x["q"]) + SMOOTHING * START_GOOD) / (total(lambda x: x["n"]) + SMOOTHING)).alias("good"),
                F.array(*[inside(right(i, 1, good, START_RIGHT_GOOD)) for i in range(k)]).alias("rg"),
                F.array(*[inside(right(i, -1, bad, START_RIGHT_BAD)) for i in range(k)]).alias("rb"),
            ).cast(kind)

        return let(weighed, estimate)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)


def _judged(docs: DataFrame, carried: str, threshold: float) -> DataFrame:
    """The carried column, counts, base_failed, p_good and kept."""
    rules = {name: _rules()[name] for name in RULES}
    votes = F.array(*rules.values())
    place = reduce(lambda a, v: a * 3 + (v + 1), rules.values(), F.lit(0))
    work = Workspace(docs.sparkSession, "quality")
    table = work.table(features(docs, carried).withColumn("pattern", place).withColumn("v", votes), "features")
    # At most 3**len(RULES) rows; one row each for EM and for the verdicts.
    counts = table.groupBy("pattern").agg(F.first("v").alias("v"), F.count("*").alias("n"))
    fitted = counts.agg(F.array_sort(F.collect_list(F.struct("pattern", "v", "n"))).alias("all")).select("all", _parameters(F.col("all")).alias("p"))
    verdicts = fitted.select("p", F.explode("all").alias("x")).select(F.col("x.pattern").alias("pattern"), _posterior(F.col("p"), [F.col("x.v")[i] for i in range(len(RULES))]).alias("p_good"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (
        table.join(F.broadcast(verdicts), "pattern")
        .withColumn("base_failed", failed)
        .select(carried, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "p_good", (~F.col("base_failed") & (F.col("p_good") >= threshold)).alias("kept"))
    )


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Counts, votes' posterior and verdict, a row for each row of ``docs`` (doc_id, text).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, p_good, kept.
    """
    return _judged(docs, "doc_id", threshold)


def filtered(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows that are kept, with all their columns; each row is judged by itself, whatever its id."""
    rows = docs.select("text", F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    return _judged(rows, "row", threshold).where("kept").select("row.*")


def op10_quality_rules(spark, sf_dir):
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
