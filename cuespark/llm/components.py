"""Connected components by alternating large-star and small-star steps.

Defined cases: an edge of a node to itself, a repeated or a turned one adds nothing; a
node that no edge to another names is not returned; no edges give no rows; ends are not null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def components(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """node, root (least node of its component) of every node of ``edges`` (a long, b long).

    Each step is an aggregation with partial sums and a join on one end of the
    edges; its result is written to the shared folder.  Steps end when nothing
    changes: every node then points to its root.
    """
    state = lambda t: t.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    # a > b in all of what follows
    current = work.table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    before, k = state(current), 0
    while before[0]:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.hint("merge"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        k += 1
        current = work.table(small, f"{name}-{k}")
        after = state(current)
        work.drop(f"{name}-{k - 1}")
        if after == before:
            break
        before = after
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
