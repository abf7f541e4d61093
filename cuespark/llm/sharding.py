"""Resharding by minimum-cost flow.

From the shards that rows lie in now and the capacities of the new shards, a flow
of least cost says which blocks of rows stay and which move, such that every new
shard is full and the fewest bytes move; only the files of shards that lose or
gain rows are rewritten.

A block is the rows of one old shard whose sizes fall in one class (four classes to
a doubling).  Flow runs in rows; a row costs nothing where it lies and its block's
mean size elsewhere.  As a move costs the same to any shard, moves go through one
pool node: the network has an arc or two for each block and shard, whatever the
number of rows.  The block table is what reaches the driver: at most
old shards x SIZE_CLASSES rows.

Ranks within blocks and shards are formed in two levels (hash buckets, then rows of
a bucket), so that no shard or source is ordered in one task.

Defined cases: a null text has size 1; null and repeated doc_ids and repeated rows
are rows like any other; with fewer rows than shards some shards stay empty; an
empty table gives an empty result; other columns are ignored by ``assign`` and kept
by ``rewrite``.
"""

from __future__ import annotations

import heapq
import uuid
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace

SIZE_CLASSES = 4 * 64
#: Rows of a hash bucket, about, within which one task ranks.
ROWS_PER_BUCKET = 20_000


class FlowNetwork:
    """Minimum-cost flow by successive shortest paths with potentials; integers only."""

    def __init__(self):
        self.to, self.left, self.cost = [], [], []
        self.arcs: dict = defaultdict(list)

    def add(self, a, b, capacity: int, cost: int = 0) -> int:
        self.arcs[a].append(len(self.to))
        self.arcs[b].append(len(self.to) + 1)
        self.to += [b, a]
        self.left += [capacity, 0]
        self.cost += [cost, -cost]
        return len(self.to) - 2

    def flow(self, arc: int) -> int:
        return self.left[arc + 1]

    def push(self, *arcs: int) -> int:
        """Send as much as fits along arcs that form a path of cost 0."""
        most = min(self.left[a] for a in arcs)
        for a in arcs:
            self.left[a] -= most
            self.left[a ^ 1] += most
        return most

    def solve(self, source, sink) -> int:
        """Send all that fits; costs must not be negative.  Returns the cost."""
        total, height = 0, defaultdict(int)
        while True:
            dist, came, done = {source: 0}, {}, set()
            heap, order = [(0, 0, source)], 0
            while heap:
                d, _, a = heapq.heappop(heap)
                if a in done:
                    continue
                done.add(a)
                for e in self.arcs[a]:
                    if self.left[e] > 0 and (new := d + self.cost[e] + height[a] - height[self.to[e]]) < dist.get(self.to[e], 1 << 62):
                        dist[self.to[e]], came[self.to[e]] = new, e
                        order += 1
                        heapq.heappush(heap, (new, order, self.to[e]))
            if sink not in dist:
                return total
            far = max(dist.values())
            for a in list(self.arcs):
                height[a] += dist.get(a, far)
            path, a = [], sink
            while a != source:
                path.append(came[a])
                a = self.to[came[a] ^ 1]
            most = min(self.left[e] for e in path)
            for e in path:
                self.left[e] -= most
                self.left[e ^ 1] += most
                total += most * self.cost[e]


def plan(blocks: list[tuple[int, int, int, int]], n_new: int) -> list[tuple[int, int, int, int, int]]:
    """blocks: (old shard, size class, rows, bytes).  Transfers (old shard, class, lo, hi, new shard): ranks lo to hi - 1 of the block go there.

    Counts of the new shards differ by one at most; of all such plans on whole
    blocks' mean sizes, this moves the fewest bytes.
    """
    total = sum(b[2] for b in blocks)
    floor, more = divmod(total, n_new)
    net, stay, away, filled = FlowNetwork(), {}, {}, {}
    full = {j: net.add(("new", j), "sink", floor) for j in range(n_new)}
    extra = {j: net.add(("new", j), "extra", 1) for j in range(n_new)}
    net.add("extra", "sink", more)
    enter = {j: net.add("pool", ("new", j), total) for j in range(n_new)}
    for old, c, rows, size in blocks:
        filled[old, c] = net.add("source", (old, c), rows)
        away[old, c] = net.add((old, c), "pool", rows, max(1, size // rows))
        if 0 <= old < n_new:
            stay[old, c] = net.add((old, c), ("new", old), rows)
    # Large rows first to where they lie: paths of cost 0, part of a cheapest flow once the rest is augmented.
    for old, c, *_ in sorted(blocks, key=lambda b: -b[1]):
        if (old, c) in stay:
            net.push(filled[old, c], stay[old, c], full[old])
    net.solve("source", "sink")
    room = {j: net.flow(enter[j]) for j in range(n_new)}
    out, j = [], 0
    for old, c, rows, _ in sorted(blocks):
        at = net.flow(stay[old, c]) if (old, c) in stay else 0
        if at:
            out.append((old, c, 0, at, old))
        moves = net.flow(away[old, c])
        while moves:
            while not room[j]:
                j += 1
            n = min(moves, room[j])
            out.append((old, c, at, at + n, j))
            at, moves, room[j] = at + n, moves - n, room[j] - n
    return out


def _ranked(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Adds ``name``: a gapless rank from 0 among the rows of ``keys``, ordered by (bucket, order)."""
    sizes = df.groupBy(*keys, "bucket").count()
    before = sizes.select(*keys, "bucket", (F.sum("count").over(Window.partitionBy(*keys).orderBy("bucket")) - F.col("count")).alias("before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy(*order)) - 1
    return df.withColumn("inside", inside).join(before, [*keys, "bucket"]).withColumn(name, (F.col("before") + F.col("inside")).cast("long")).drop("before", "inside")


def _measures() -> tuple[Column, Column]:
    text = F.coalesce(F.col("text"), F.lit(""))
    return (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")


def assign(docs: DataFrame, old_shard: Column, n_new: int) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): doc_id, size, text_crc32, old_shard, shard, slot.

    Law ``rows``: counts of the shards are at most one apart.
    """
    work = Workspace(docs.sparkSession, "reshard")
    rows = work.table(docs.select("doc_id", *_measures(), old_shard.cast("int").alias("old_shard")), "rows")
    rows = rows.withColumn("cls", F.least(F.lit(SIZE_CLASSES - 1), F.floor(4 * F.log2("size"))).cast("int"))
    blocks = [(r[0], r[1], r[2], r[3]) for r in rows.groupBy("old_shard", "cls").agg(F.count("*"), F.sum("size")).collect()]
    moves = plan(blocks, n_new)
    buckets = max(16, sum(b[2] for b in blocks) // ROWS_PER_BUCKET)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(buckets)).cast("int"))
    order = ["doc_id", "text_crc32", "size"]
    spans = docs.sparkSession.createDataFrame(moves, "old_shard int, cls int, lo long, hi long, shard int").groupBy("old_shard", "cls").agg(F.collect_list(F.struct("lo", "hi", "shard")).alias("spans"))
    placed = (
        _ranked(rows, ["old_shard", "cls"], order, "rank")
        .join(F.broadcast(spans) if len(moves) <= SMALL else spans, ["old_shard", "cls"])
        .withColumn("shard", F.filter("spans", lambda s: (s["lo"] <= F.col("rank")) & (F.col("rank") < s["hi"]))[0]["shard"])
    )
    placed = work.table(placed.select(*order, "old_shard", "shard", "bucket"), "placed")
    work.drop("rows")
    return _ranked(placed, ["shard"], order, "slot").select("doc_id", "size", "text_crc32", "old_shard", "shard", "slot")


def rewrite(target: str, moved: DataFrame, docs: DataFrame, shard_col: str = "shard") -> list[int]:
    """Rewrite the shards of ``target`` (Parquet by ``shard_col``) that gain or lose rows, and no other file; returns them.

    ``moved``: rows of ``assign`` over the rows of target.  ``docs``: those rows.  A row's
    identity is its old shard, doc_id, size and crc32 and, among rows that agree in
    these, its number: the k-th of docs goes where the k-th of ``moved`` does.  A call that is
    cut off, at whatever step, loses no row: ``complete`` finishes or undoes it.
    """
    spark = docs.sparkSession
    if _staged(spark, target):
        raise ValueError(f"an earlier rewrite of {target} was cut off: complete() it and plan again")
    crossing = moved.where("shard <> old_shard").groupBy("old_shard", "shard").count().collect()
    affected = sorted({r["old_shard"] for r in crossing} | {r["shard"] for r in crossing})
    if not affected:
        return affected
    kind = docs.drop(shard_col).schema
    keys = ["doc_id", "size", "text_crc32"]
    lying = docs.where(F.col(shard_col).isin(affected)).select("doc_id", *_measures(), F.col(shard_col).cast("int").alias("old_shard"), F.lit(1).alias("side"), F.lit(None).cast("int").alias("to"), F.struct(*kind.names).alias("row"))
    places = moved.where(F.col("old_shard").isin(affected)).select(*keys, "old_shard", F.lit(0).alias("side"), F.col("shard").cast("int").alias("to"), F.lit(None).cast(kind).alias("row"))
    both = places.unionByName(lying).withColumn("hash", F.xxhash64(*keys)).repartition("old_shard", "hash")  # the one exchange: the windows agree with it
    both = both.withColumn("k", F.row_number().over(Window.partitionBy("old_shard", "hash", "side").orderBy(*keys)))
    before = Window.partitionBy("old_shard", "hash").orderBy(*keys, "k", "side")
    known = F.lag(F.struct(*keys, "k", "side")).over(before).eqNullSafe(F.struct(*keys, "k", F.lit(0).alias("side")))
    paired = both.withColumns({"known": known, "to": F.lag("to").over(before)}).where("side = 1")
    shard = F.when(F.col("known"), F.col("to")).otherwise(F.raise_error(F.lit("a row of the target has no place")).cast("int"))
    staged = f"{target}/{_STAGED}{uuid.uuid4().hex[:12]}"  # not seen by readers; all is written before any of the target goes
    paired.select("row.*", shard.alias(shard_col)).write.option("compression", "zstd").partitionBy(shard_col).parquet(staged)
    files, path = _files(spark, target)
    plan_of = "\n".join(f"{shard_col}={k} {int(files.exists(path(f'{staged}/{shard_col}={k}')))}" for k in affected)
    out = files.create(path(f"{staged}/{_PLAN}.part"))
    out.write(plan_of.encode())
    out.close()
    files.rename(path(f"{staged}/{_PLAN}.part"), path(f"{staged}/{_PLAN}"))
    complete(spark, target)
    return affected


_STAGED, _PLAN = "_rewrite-", "_plan"


def _files(spark, target: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(target).getFileSystem(spark._jsc.hadoopConfiguration()), path


def _staged(spark, target: str) -> list[str]:
    files, path = _files(spark, target)
    return sorted(f.getPath().toString() for f in files.listStatus(path(target)) if f.getPath().getName().startswith(_STAGED)) if files.exists(path(target)) else []


def complete(spark, target: str) -> int:
    """Finish what a rewrite of ``target`` that was cut off has begun; to be called before it is read again.  Returns how many were found.

    A rewrite whose new files are all written has a plan (a shard's folder, and whether it
    has rows in a line): old folders move into the staged one, new ones take their place,
    and only then the old ones go.  Each step is done if it has not been, so any number
    of calls may be cut off.  A rewrite without a plan has changed nothing and goes.
    """
    files, path = _files(spark, target)

    def moved(a: str, b: str) -> None:
        if not files.rename(path(a), path(b)):
            raise OSError(f"{a} could not be moved")

    found = _staged(spark, target)
    for staged in found:
        if files.exists(path(f"{staged}/{_PLAN}")):
            files.mkdirs(path(f"{staged}/_old"))
            lines = spark._jvm.org.apache.hadoop.io.Text()
            into = files.open(path(f"{staged}/{_PLAN}"))
            size = int(files.getFileStatus(path(f"{staged}/{_PLAN}")).getLen())
            lines.readWithKnownLength(into, size)
            into.close()
            for line in lines.toString().split("\n"):
                name, some = line.rsplit(" ", 1)
                here, new, old = f"{target}/{name}", f"{staged}/{name}", f"{staged}/_old/{name}"
                waits = files.exists(path(new))
                if (waits or some == "0") and files.exists(path(here)) and not files.exists(path(old)):
                    moved(here, old)
                if waits:
                    moved(new, here)
        files.delete(path(staged), True)
    if found:
        spark.catalog.refreshByPath(target)
    return len(found)


#: Transfers that are broadcast, at most; a block's own are a join on its shard and class beyond it.
SMALL = 200_000
N_SHARDS = 8


def op1_sharding(spark, sf_dir):
    """Documents lie by source, which is uneven; they are dealt evenly to shards 0 to 7, and the files of those that change are rewritten."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    by_source = F.pmod(F.crc32(F.coalesce(F.col("source"), F.lit("")).cast("binary")), F.lit(N_SHARDS)).cast("int")
    work = Workspace(spark, "shards")
    docs = docs.withColumn("shard", by_source)
    docs.write.option("compression", "zstd").partitionBy("shard").parquet(work.path("target"))
    lying = work.read("target", docs.schema)
    moved = work.table(assign(lying, F.col("shard"), N_SHARDS), "moved")
    rewrite(work.path("target"), moved, lying)
    return moved.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")
