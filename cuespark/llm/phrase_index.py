"""Exact phrase and proximity matches from a positional inverted index, with DataFrame functions alone.

The index holds a posting (row, term, pos) for every training word that any test phrase
uses, sorted by term within each file, and a head for every row; it is written once and
stays where the texts lie, so that no word moves.  A phrase begins with the postings
of its rarest term, by postings in the whole corpus, less its offset: the places where
the phrase can start.  They are intersected with the next rarest term's postings, and
what is left with all others.  For an intersection a bitmap of the places asked for
goes to the postings and only those that pass it move.  With ``slop``, each term may stand so many
words from its place.

Small sides are broadcast if they have been counted to be within SMALL rows; beyond it
they are joined by a shuffle, where the postings of a term are dealt to SALTS groups.

Defined cases: null text has no words; rows are matched one by one, also those of one id
or without one; phrases of equal words are searched once and reported for each of their
items; rows of one item_id are one item, and an item without id is the item ''; a phrase
without words matches nothing; empty tables give no matches; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace, marked

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a window of an item.
WINDOW = 10
#: Rows that a broadcast side may have.
SMALL = 200_000
SALTS = 64


def words(text: Column) -> Column:
    """Words of a text, A-Z as a-z; none of null."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(low, BREAK), lambda w: w != "")


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item, words): runs of ``size`` words of items (item_id, text), or all words of an item of fewer."""
    said = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (size - 1)))
    return said.select("item", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, size))).alias("words"))


def _met(rows: DataFrame, small: DataFrame, on: str, key: Column) -> DataFrame:
    """Inner join with a side that is broadcast only if it is small; else rows of one value go to SALTS groups by ``key``."""
    if small.count() <= SMALL:
        return rows.join(F.broadcast(small), on)
    dealt = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")).join(dealt.hint("merge"), [on, "_salt"]).drop("_salt")


class Index:
    """Postings of the words of ``docs`` (doc_id, text) that stand in ``phrases`` (item, words)."""

    def __init__(self, docs: DataFrame, phrases: DataFrame, work: Workspace | None = None):
        self.work = work = work or Workspace(docs.sparkSession, "phrases")
        # A phrase's place in its written table is its number, and a term's likewise.
        phrases = work.table(phrases, "items")
        numbered = work.table(phrases.select("words").distinct().withColumn("phrase", F.monotonically_increasing_id()), "phrases")
        self.items = phrases.join(numbered, "words").select("phrase", "item").distinct()
        terms = work.table(numbered.select(F.explode("words").alias("word")).distinct().withColumn("term", F.monotonically_increasing_id()), "terms")
        spread = numbered.select("phrase", F.size("words").alias("length"), F.posexplode("words").alias("offset", "word"))
        # The first of a row's words, '', is its head: it has no term, and the row's words as its place.
        said = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("w"))
        each = said.select("row", "doc_id", F.size("w").alias("n"), F.posexplode(F.concat(F.array(F.lit("")), F.col("w"))).alias("at", "word"))
        heads = terms.select("word", "term").unionByName(terms.sparkSession.range(1).select(F.lit("").alias("word"), F.lit(None).cast("long").alias("term")))
        found = _met(each, heads, "word", F.col("row"))
        head = F.col("at") == 0
        postings = found.select("term", "row", F.when(head, F.col("n")).otherwise(F.col("at") - 1).alias("pos"), F.when(head, F.col("doc_id")).alias("doc_id"))
        table = work.table(postings.sortWithinPartitions("term"), "postings")
        self.postings = table.where("term IS NOT NULL").select("term", "row", "pos")
        self.rows = table.where("term IS NULL").select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))
        counts = self.postings.groupBy("term").agg(F.count("*").alias("n"))
        held = spread.join(terms, "word").join(counts, "term", "left")
        by_rarity = F.row_number().over(Window.partitionBy("phrase").orderBy(F.coalesce("n", F.lit(0)), "offset"))
        self.plan = work.table(held.select("phrase", "length", "term", "offset", by_rarity.alias("rank")), "plan")

    def _asked(self, found: DataFrame, plan: DataFrame, slop: int, name: str) -> DataFrame:
        """found (phrase, row, start, low, high) with ``hits``, offsets of ``plan`` that stand where they should, and the places low to high that they span."""
        wide = F.sequence(F.col("start") + F.col("offset") - slop, F.col("start") + F.col("offset") + slop)
        at = F.explode(wide).alias("pos") if slop else (F.col("start") + F.col("offset")).alias("pos")
        asked = self.work.table(_met(found, plan, "phrase", F.col("row")).select("phrase", "row", "start", "low", "high", "offset", "term", at), f"asked-{name}")
        place = F.xxhash64("row", "pos", "term").alias("place")
        told = marked(self.postings.select("term", "row", "pos", place), asked.select(place), "place").where("hit").drop("hit", "place")
        hit = asked.join(told.hint("merge"), ["row", "pos", "term"])
        met = hit.groupBy("phrase", "row", "start").agg(F.count_distinct("offset").alias("hits"), F.least(F.min("low"), F.min("pos")).alias("low"), F.greatest(F.max("high"), F.max("pos")).alias("high"))
        return met

    def matches(self, slop: int = 0) -> DataFrame:
        """(phrase, row, start, low, high): where a phrase would start, by its rarest term, and the first and last place of its words."""
        plan = self.plan
        rarest = plan.where("rank = 1").select("term", "phrase", "offset")
        begun = _met(self.postings, rarest, "term", F.col("row")).select("phrase", "row", (F.col("pos") - F.col("offset")).alias("start"), F.col("pos").alias("low"), F.col("pos").alias("high"))
        begun = begun.where(F.col("start") >= -slop)
        alone = plan.where("length = 1").select("phrase")
        second, rest = (plan.where(test).select("phrase", "term", "offset") for test in ("rank = 2", "rank > 2"))
        found = self.work.table(begun, "begun")
        paired = self.work.table(self._asked(found, second, slop, "second").drop("hits"), "paired")
        pairs = plan.where("length = 2").select("phrase").distinct()
        want = plan.where("rank = 1 AND length > 2").select("phrase", (F.col("length") - 2).alias("want"))
        whole = self._asked(paired, rest, slop, "rest").join(want, "phrase").where("hits = want").drop("hits", "want")
        return found.join(alone, "phrase", "left_semi").unionByName(paired.join(pairs, "phrase", "left_semi")).unionByName(whole)


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (their ids), a row for each row of ``docs``: words within windows of items."""
    index = Index(docs, windows(items, size))
    found = index.work.table(index.matches(), "found")
    spans = found.select("row", F.col("low").alias("first"), (F.col("high") + 1).alias("end")).distinct()
    before = F.max("end").over(Window.partitionBy("row").orderBy("first", "end").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("first"), F.coalesce(before, F.lit(0))))
    hit = spans.select("row", fresh.alias("n")).groupBy("row").agg(F.sum("n").alias("n_hit"))
    named = found.select("row", "phrase").distinct().join(index.items, "phrase").select("row", "item").distinct()
    named = named.groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    nothing = F.array().cast("array<string>")
    told = index.rows.join(hit, "row", "left").join(named, "row", "left")
    return told.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", nothing).alias("items"))


def op12_decontamination(spark, sf_dir):
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    found = contamination(read("documents").select("doc_id", "text"), read("benchmark").select("item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_SAID = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{BREAK}'), lambda w: w <> '')"
SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_SAID} AS w FROM documents),
b AS (SELECT item_id, {_SAID} AS w FROM benchmark),
wins AS MATERIALIZED (
    SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[i : i + least(len(w), {WINDOW}) - 1], ' ') AS phrase
    FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1)) AS i FROM b WHERE len(w) > 0)
), grams AS (
    SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS phrase
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)
), hits AS MATERIALIZED (SELECT doc_id, item_id, i, n FROM grams JOIN wins USING (n, phrase)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
