"""Chunks of cues, with the context around them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuespark.dist import ship
from cuespark.functions.text import trimmed
from cuespark.operators import carried

_W = lambda: Window.partitionBy("file").orderBy("pos")
# Signs that end a sentence.
ENDS = r"[。！？….!?]$"
# Presets and profiles of models by class, as (size, least, most, target, hard).
PRESETS = {"safe": (12, 6, 24, 900, 1300), "fast": (18, 8, 32, 1400, 2200), "turbo": (24, 10, 40, 1800, 2600)}


def fixed(cues: DataFrame, size: int) -> DataFrame:
    return cues.select("file", "pos", F.floor((F.row_number().over(_W()) - 1) / size).cast("long").alias("chunk"))


def dynamic(cues: DataFrame, size: int = 12, least: int = 6, most: int = 24, target: int = 900, hard: int = 1300, risk_limit: int = 5, sentence: int = 18, gap_ms: int | None = None) -> DataFrame:
    """Greedy chunks of cues (file, pos, chars, risk, content): file, pos, chunk and why the chunk was closed.

    Whether a chunk closes depends on what it holds: a fold over a file's rows in order,
    whose state is what is in the open chunk and where chunks began; rows find their
    chunk by a running count.  With ``gap_ms`` a hole in time (start_ms, end_ms) is a
    place to close at too; without, only the end of a sentence is.  Long files are
    folded range by range (``_of_long_files``).
    """
    text = trimmed(F.col("content"))
    ends = text.rlike(ENDS) & (F.length(text) >= sentence)
    end_ms = F.col("end_ms") if gap_ms is not None else F.lit(None).cast("long")
    seen = carried.with_previous(carried.ranged(cues, "pos"), ["pos"], F.struct(ends.alias("ends"), end_ms.alias("end_ms")), "_last")
    gap = (F.col("start_ms") - F.col("_last.end_ms") >= gap_ms) if gap_ms is not None else F.lit(False)
    told = seen.select("file", F.col("pos").cast("long").alias("pos"), F.col("chars").cast("long").alias("chars"), F.col("risk").cast("long").alias("risk"), (F.coalesce("_last.ends", F.lit(False)) | F.coalesce(gap, F.lit(False))).alias("boundary"), "_range", "_split")
    limits = (size, least, most, target, hard, risk_limit)
    out = _of_files(told.where("NOT _split"), *limits)
    long = told.where("_split")
    return out if long.isEmpty() else out.unionByName(_of_long_files(long, *limits))


def _of_files(told: DataFrame, size: int, least: int, most: int, target: int, hard: int, risk_limit: int) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("pos", "chars", "risk", "boundary")))
    kind = "struct<n:long,chars:long,risk:long,closed:string,cuts:array<struct<pos:long,why:string>>>"
    start = F.expr(f"CAST(named_struct('n', 0L, 'chars', 0L, 'risk', 0L, 'closed', '', 'cuts', array()) AS {kind})")

    def step(a, x):
        natural = (a["closed"] == "") & (a["n"] >= least) & (a["n"] > 0) & (a["chars"] >= target) & x["boundary"]
        cut = (a["closed"] != "") | natural
        n = F.when(cut, 1).otherwise(a["n"] + 1)
        chars = F.when(cut, x["chars"]).otherwise(a["chars"] + x["chars"])
        risk = F.when(cut, x["risk"]).otherwise(a["risk"] + x["risk"])
        closed = F.when(n >= most, "max_chunk_size").when((n >= least) & (chars >= hard), "hard_chars").when((n >= least) & (risk >= risk_limit), "risk_density").when((n >= size) & (chars >= target), "target_chars").otherwise("")
        why = F.when(natural, "semantic_gap_or_sentence").otherwise(a["closed"])
        cuts = F.when(cut, F.concat(a["cuts"], F.array(F.struct(x["pos"].cast("long").alias("pos"), why.alias("why"))))).otherwise(a["cuts"])
        return F.struct(n.alias("n"), chars.alias("chars"), risk.alias("risk"), closed.alias("closed"), cuts.alias("cuts")).cast(kind)

    last = lambda a: F.struct(a["cuts"].alias("cuts"), F.when(a["closed"] == "", "end").otherwise(a["closed"]).alias("last"))
    folded = told.groupBy("file").agg(F.aggregate(rows, start, step, last).alias("x")).select("file", "x.*")
    # the k-th cut begins chunk k and tells why chunk k - 1 was closed
    why = folded.select("file", F.posexplode(F.concat(F.transform("cuts", lambda c: c["why"]), F.array("last"))).alias("k", "reason")).select("file", F.col("k").cast("long").alias("chunk"), "reason")
    begins = folded.select("file", F.explode("cuts").alias("c")).select("file", F.col("c.pos").alias("pos"), F.lit(1).cast("long").alias("_cut"))
    placed = told.select("file", "pos").join(begins, ["file", "pos"], "left").withColumn("chunk", F.coalesce(F.sum("_cut").over(_W()), F.lit(0)))
    return placed.join(why, ["file", "chunk"]).select("file", "pos", "chunk", "reason")


def _chunk_from(i: int, rows: list[tuple], size: int, least: int, most: int, target: int, hard: int, risk_limit: int) -> tuple[int, str]:
    """Rows (pos, chars, risk, boundary) of the chunk that begins at row i, and why it closes; ``end`` where rows end before."""
    n = chars = risk = 0
    for _, c, r, boundary in rows[i : i + most + 1]:
        if n and n >= least and chars >= target and boundary:
            return n, "semantic_gap_or_sentence"
        n, chars, risk = n + 1, chars + c, risk + r
        if n >= most:
            return n, "max_chunk_size"
        if n >= least and chars >= hard:
            return n, "hard_chars"
        if n >= least and risk >= risk_limit:
            return n, "risk_density"
        if n >= size and chars >= target:
            return n, "target_chars"
    return n, "end"


def _of_long_files(told: DataFrame, size: int, least: int, most: int, target: int, hard: int, risk_limit: int) -> DataFrame:
    """Chunks of files in ranges.

    A chunk has ``most`` rows at most, so the first row of a range that begins one is among
    its first ``most``.  Each range, with that many rows that follow it, tells for each of
    them where the last chunk that it begins ends in the next range, and how many it
    begins.  These short tables are followed from range to range, and each range then
    deals its rows out by the one that applies.
    """
    ship(told.sparkSession)
    limits = (size, least, most, target, hard, risk_limit)
    row = F.struct("pos", "chars", "risk", "boundary")
    here = Window.partitionBy("file", "_range").orderBy("pos")
    heads = told.withColumn("_k", F.row_number().over(here)).where(F.col("_k") <= most + 1).groupBy("file", "_range").agg(F.array_sort(F.collect_list(row)).alias("head"))
    after = Window.partitionBy("file").orderBy("_range").rowsBetween(1, Window.unboundedFollowing)
    follow = heads.select("file", "_range", F.slice(F.flatten(F.collect_list("head").over(after)), 1, most + 1).alias("follow"))
    file = f"file {told.schema['file'].dataType.simpleString()}"

    def walked(part: pd.DataFrame, more) -> tuple[list[tuple], list[tuple[int, str]]]:
        part = part.sort_values("pos")
        rows = list(part[["pos", "chars", "risk", "boundary"]].itertuples(index=False, name=None))
        whole = rows + [(x["pos"], x["chars"], x["risk"], x["boundary"]) for x in more]
        return rows, [_chunk_from(i, whole, *limits) for i in range(len(rows))]

    def tables(key, part: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
        rows, chunks = walked(part, more["follow"].iloc[0])
        n = len(rows)
        exits, begun = list(range(n + most)), [0] * (n + most)  # a row at or past the end begins nothing here
        exits = [i - n if i >= n else 0 for i in exits]
        for i in range(n - 1, -1, -1):
            to = i + chunks[i][0]
            exits[i], begun[i] = exits[to], begun[to] + 1
        return pd.DataFrame({"file": [key[0]], "_range": [key[1]], "exits": [exits[:most]], "begun": [begun[:most]]})

    by = ["file", "_range"]
    known = told.groupBy(*by).cogroup(follow.toDF("_f", "_r", "follow").groupBy("_f", "_r")).applyInPandas(tables, f"{file}, _range int, exits array<long>, begun array<long>")
    steps = F.array_sort(F.collect_list(F.struct("_range", "exits", "begun")))
    kind = "struct<at:long,base:long,out:array<struct<r:int,entry:long,base:long>>>"

    def step(a, x):
        out = F.concat(a["out"], F.array(F.struct(x["_range"].alias("r"), a["at"].alias("entry"), a["base"].alias("base"))))
        return F.struct(F.element_at(x["exits"], (a["at"] + 1).cast("int")).alias("at"), (a["base"] + F.element_at(x["begun"], (a["at"] + 1).cast("int"))).alias("base"), out.alias("out")).cast(kind)

    start = F.expr(f"CAST(named_struct('at', 0L, 'base', 0L, 'out', array()) AS {kind})")
    entries = known.groupBy("file").agg(F.aggregate(steps, start, step, lambda a: a["out"]).alias("out")).select("file", F.explode("out").alias("x")).select("file", F.col("x.r").alias("_range"), "x.entry", "x.base")

    def dealt(key, part: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
        rows, chunks = walked(part, more["follow"].iloc[0])
        entry, chunk = int(more["entry"].iloc[0]), int(more["base"].iloc[0]) - 1
        out, i = [(r[0], chunk, None) for r in rows[:entry]], entry
        while i < len(rows):
            n, why = chunks[i]
            chunk += 1
            out += [(r[0], chunk, why if k == 0 else None) for k, r in enumerate(rows[i : i + n])]
            i += n
        return pd.DataFrame(out, columns=["pos", "chunk", "reason"]).assign(file=key[0])[["file", "pos", "chunk", "reason"]]

    placed = told.groupBy(*by).cogroup(follow.join(entries, by).toDF("_f", "_r", "follow", "entry", "base").groupBy("_f", "_r")).applyInPandas(dealt, f"{file}, pos long, chunk long, reason string")
    why = placed.where("reason IS NOT NULL").select("file", "chunk", "reason")
    return placed.drop("reason").join(why, ["file", "chunk"]).select("file", "pos", "chunk", "reason")


def summary(chunked: DataFrame) -> DataFrame:
    """A row for each chunk of rows (file, chunk, pos, idx, chars, risk, reason): first and last index, indexes, counts and sums."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("pos", "idx"))), lambda x: x["idx"])
    return chunked.groupBy("file", "chunk").agg(
        F.min_by("idx", "pos").alias("start_i"), F.max_by("idx", "pos").alias("end_i"), rows.alias("target_indexes"), F.count("*").alias("count"), F.sum("chars").alias("chars"), F.sum("risk").alias("risk_score"), F.first("reason").alias("reason")
    )


def halo(cues: DataFrame, n: int = 2) -> DataFrame:
    """Positions of the n rows before and after each, as text."""
    w = _W()
    joined = lambda lo, hi: F.array_join(F.collect_list("pos").over(w.rowsBetween(lo, hi)), ",")
    return cues.select("file", "pos", joined(-n, -1).alias("before"), joined(1, n).alias("after"))


def contexts(chunked: DataFrame, n: int = 2) -> DataFrame:
    """Indexes (before, after) of the n rows before the first and after the last of each chunk of rows (file, pos, idx, chunk)."""
    w = _W()
    near = chunked.withColumns({"before": F.collect_list("idx").over(w.rowsBetween(-n, -1)), "after": F.collect_list("idx").over(w.rowsBetween(1, n))})
    return near.groupBy("file", "chunk").agg(F.min_by("before", "pos").alias("before"), F.max_by("after", "pos").alias("after"))


def dilated_groups(flagged: DataFrame, reach: int = 1, most: int = 8) -> DataFrame:
    """Rows within ``reach`` of a flagged one (file, pos, flag), in runs of neighbours of at most ``most``."""
    w = _W()
    chosen = flagged.withColumn("near", F.max(F.col("flag").cast("int")).over(w.rowsBetween(-reach, reach))).where("near = 1")
    islands = chosen.withColumn("island", F.col("pos") - F.row_number().over(w))
    rank = F.row_number().over(Window.partitionBy("file", "island").orderBy("pos")) - 1
    return islands.select("file", "pos", F.col("island").cast("long").alias("island"), F.floor(rank / most).cast("long").alias("part"))
