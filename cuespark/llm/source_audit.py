"""How far the sources of a language diverge in what they say: chi-square-like sums over all pairs, exactly.

Every group (lang, source) gives each kept term of its language a smoothed share p.  The
divergence of a group from another is a sum over all V kept terms, most of which neither
has.  So a pair starts with V times the value f of two counts of zero, and corrections
are added where a count is not zero:

* terms that the group has, as if the other had none: by the group's histogram of counts;
* terms that the other has, as if the group had none: likewise;
* terms that both have: the postings of a term meet, and emit what the two corrections
  before miss.

Terms are counted in the tasks that read the texts and only sums move; no text does.

Defined cases: null text, lang and source count as ''; rows are documents, repeated ones
too; a group without terms has shares of zero counts; a language without kept terms gives
pairs of value 0; one with one source gives no pairs; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace

LEAST_DOCUMENTS = 3
UNIT = 1_000_000_000
TOP = 200
#: Counts that a task holds before it gives them away.
HELD = 300_000
#: Letters and all bytes of other scripts stay, A-Z as a-z; all other bytes end a term.
_FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs, summed within tasks; a row without term for each group."""

    def counted(batches):
        n: dict[tuple, Counter] = {}
        seen: dict[tuple, Counter] = {}

        def given():
            for (lang, source), counts in n.items():
                terms = list(counts)
                columns = {"lang": [lang] * len(terms), "source": [source] * len(terms), "term": [t.decode() if t else None for t in terms], "n": [counts[t] for t in terms], "docs": [seen[lang, source][t] for t in terms]}
                yield pa.RecordBatch.from_arrays([pa.array(columns[c], kind) for c, kind in kinds], [c for c, _ in kinds])
            n.clear()
            seen.clear()

        kinds = [("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())]
        held = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
                terms = text.translate(_FOLDED).split()
                group = lang, source
                if group not in n:
                    n[group], seen[group] = Counter(), Counter()
                    n[group][b""] = seen[group][b""] = 0
                before = len(n[group])
                n[group].update(terms)
                seen[group].update(set(terms))
                held += len(n[group]) - before
                if held > HELD:
                    yield from given()
                    held = 0
        yield from given()

    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    read = docs.select(said("lang").alias("lang"), said("source").alias("source"), said("text").cast("binary").alias("text"))
    return read.mapInArrow(counted, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / (total + kept)); decimals, as the product may pass a long."""
    whole = lambda c: c.cast("decimal(28,0)")
    return 1 + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * whole(count + 1), whole(total + kept))


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


class Audit:
    """Kept terms and shares of the groups of ``docs`` (text, lang, source)."""

    def __init__(self, docs: DataFrame, least: int = LEAST_DOCUMENTS):
        work = Workspace(docs.sparkSession, "audit")
        counts = work.table(term_counts(docs), "counts")
        kept = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least).drop("docs")
        kept = work.table(kept, "kept")
        self.postings = work.table(counts.where("term IS NOT NULL").drop("docs").join(kept, ["lang", "term"]), "postings")
        langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
        totals = self.postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = counts.where("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        zero = F.when(F.col("v") > 0, _share(F.lit(0), F.col("total"), F.col("v")))
        groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "v", "lang_total")])
        #: lang, source, total, v, lang_total, zero: the share of a count of zero, null where no term is kept.
        self.groups = work.table(groups.withColumn("zero", zero), "groups")
        #: lang, source, term, n, p, zero.
        sized = self.postings.join(self.groups, ["lang", "source"])
        self.shares = work.table(sized.select("lang", "source", "term", "n", _share(F.col("n"), F.col("total"), F.col("v")).alias("p"), "zero", _share(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("lang_p")), "shares")

    def pairs(self) -> DataFrame:
        """lang, source, item (another source), value."""
        two = self.groups.select("lang", "source", "zero", "v").join(self.groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("item_zero")), "lang").where("source <> item")
        times = lambda n, value: (n.cast("decimal(38,0)") * value).cast("decimal(38,0)")
        nothing = _f(F.col("zero"), F.col("item_zero"))
        base = two.select("lang", "source", "item", F.coalesce(times(F.col("v"), nothing), F.lit(0)).alias("value"))
        # A group's counts are few: n distinct ones need n * n / 2 words.
        spread = self.shares.groupBy("lang", "source", "p").agg(F.count("*").alias("terms"))
        own = two.join(spread, ["lang", "source"]).select("lang", "source", "item", times(F.col("terms"), _f(F.col("p"), F.col("item_zero")) - nothing).alias("value"))
        theirs = two.join(spread.withColumnsRenamed({"source": "item"}), ["lang", "item"]).select("lang", "source", "item", times(F.col("terms"), _f(F.col("zero"), F.col("p")) - nothing).alias("value"))
        a, b = self.shares.select("lang", "term", "source", "p", "zero"), self.shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("zero").alias("item_zero"))
        missed = _f(F.col("p"), F.col("q")) - _f(F.col("p"), F.col("item_zero")) - _f(F.col("zero"), F.col("q")) + nothing
        both = a.join(b, ["lang", "term"]).where("source <> item").select("lang", "source", "item", missed.alias("value")).where("value <> 0").groupBy("lang", "source", "item").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
        rows = base.unionByName(own).unionByName(theirs).unionByName(both)
        return rows.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))

    def terms(self, top: int = TOP) -> DataFrame:
        """lang, source, item (a term that the group has more of than its language), value, rank up to ``top``."""
        rows = self.shares.where("p > lang_p").select("lang", "source", F.col("term").alias("item"), _f(F.col("p"), F.col("lang_p")).alias("value"))
        return ranked(rows).where(F.col("rank") <= top)


def ranked(rows: DataFrame) -> DataFrame:
    """Adds rank: by value, the largest first, then item."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def op13_source_audit(spark, sf_dir):
    audit = Audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text"))
    part = lambda rows, name: rows.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")
    return part(ranked(audit.pairs()), "pair").unionByName(part(audit.terms(), "term"))


_A_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
SQL = rf"""
WITH d AS MATERIALIZED (
    SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), {_A_Z}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), t AS MATERIALIZED (SELECT row, lang, source, unnest(w) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*)::HUGEINT AS lang_n FROM t GROUP BY ALL HAVING count(DISTINCT row) >= {LEAST_DOCUMENTS}),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(lang_n)::HUGEINT AS total FROM kept GROUP BY lang),
n AS MATERIALIZED (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN n USING (lang, source) GROUP BY ALL),
p AS MATERIALIZED (
    SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n, 1 + {UNIT}::HUGEINT * (coalesce(n.n, 0) + 1) // (g.total + l.v) AS p,
        1 + {UNIT}::HUGEINT * (k.lang_n + 1) // (l.total + l.v) AS lang_p
    FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term
), sums AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), found AS (
    SELECT lang, source, 'pair' AS part, item, value FROM pairs
    UNION ALL SELECT lang, source, 'term', term, (p - lang_p) * (p - lang_p) // lang_p FROM p WHERE n > 0 AND p > lang_p
), ranks AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranks WHERE part = 'pair' OR rank <= {TOP}
"""
