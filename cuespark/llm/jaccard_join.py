"""N-gram Jaccard join by chosen paths.

Documents are sets of word shingles.  In each of RUNS runs a set takes the path of
each shingle whose hash for that run is below 1 / (THRESHOLD * size): so two sets
that are similar enough are expected to share a path, and miss it with a
probability below 1/e a run.  Sets that share a path form a bucket; a bucket of more
than BUCKET sets is split further on shingles sampled for the next level, with
SPLIT times that rate, to DEPTH levels, unless a sample shows that its sets are all
alike, which no split would part.  Buckets are then brute-forced on sketches, a task
holding BUCKET sets at most: a bucket that is still larger is dealt in parts of half
that, each with the same few leaders, so that what is alike in all parts is linked
through them; the sets that are not linked to most of their bucket are then held
against every part of it.
RUNS is the least number of runs for which a pair at the threshold is lost, even at
full depth, with a probability below 1 - RECALL.

What brute force finds are candidates.  It leaves a spanning forest of a bucket's
close sets, not their pairs: a set that has been reached is not compared again, so
a bucket of copies takes time in proportion to its size.  Candidates are joined
into components, and within a component every pair is counted exactly, in blocks, so
a pair that its own paths missed is still found if both are near a third set.

Copies (equal sets) are one set with a multiplicity.  Sets are known by a 128-bit
digest of their shingles' 64-bit hashes, and texts that are read again by their md5:
two of n sets are taken for one with a chance below n*n / 2**129, and a pair's overlap
is off by a shingle with a chance of its size in shingles / 2**63.  The result has a row for each
document: the class of documents that links connect, and the number of documents
that it is linked to, copies included.

Words are runs of other than white space, A-Z in lower case; a text of fewer words
than a shingle has one shingle, of all of them.

Defined cases: null, empty and blank texts have no shingles, no links and a class of
their own (class_id is their doc_id); repeated rows and ids are linked like any
copies; null ids get the least id of their class, if there is one; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .substring_dedup import Hashes, _mix
from .workspace import Workspace, marked, without

WORDS, THRESHOLD = 5, 0.8
RECALL, DEPTH, SPLIT = 0.9999, 3, 2.5
#: Chance that a pair at the threshold shares a path at the first level, and goes on together at each next.
_FIRST, _NEXT = 1 - math.exp(-1), 1 - math.exp(-SPLIT * THRESHOLD)
RUNS = math.ceil(math.log(1 - RECALL) / math.log(1 - _FIRST * _NEXT ** (DEPTH - 1)))
BUCKET = 8_000
#: Bytes of a sketch; those that are compared first, and how many of them must agree (a pair at the threshold: all but 4 in a million).
SKETCH, GLANCE, GLANCE_LEAST = 128, 16, 5
#: Estimate of the similarity that makes a candidate: 5 standard errors below the threshold.
NEAR = 0.6
#: A large bucket is dense, and not split further, if half of the pairs of a sample of its sets agree so far.
SAMPLE, DENSE = 16, 0.5
#: Shingles and sets of a block of exact counting.
BLOCK_SHINGLES, BLOCK_SETS = 2_000_000, 2_000

_RANDOM = np.random.default_rng(77)
_SKETCH_BY = _RANDOM.integers(1, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_RUN_BY = _RANDOM.integers(1, 1 << 63, (DEPTH, RUNS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def shingles(text: bytes, k: int = WORDS) -> np.ndarray:
    """The set of hashes of k words in a row, in ascending order."""
    data = _LOWER[np.frombuffer(text, np.uint8)]
    inside = ~_SPACE[data]
    edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    starts, stops = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    words = Hashes(data).of(starts, stops)
    k = min(k, len(words))
    n, out = len(words) - k + 1, np.full(len(words) - k + 1, np.uint64(k))
    for j in range(k):
        out = _mix(out * np.uint64(0xD6E8FEB86659FD93) + words[j : j + n])
    return np.unique(out)


def paths(found: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs and shingles of the paths that a set takes at a level."""
    rate = (1 if level == 0 else SPLIT) / (THRESHOLD * len(found))
    if rate >= 1:
        runs, which = np.divmod(np.arange(RUNS * len(found)), len(found))
    else:
        runs, which = np.nonzero(_mix(found[None, :] * _RUN_BY[level][:, None]) < np.uint64(int(rate * 2**64)))
    return runs, _mix(found[which] ^ _RUN_BY[level][runs])


def sketch(found: np.ndarray) -> np.ndarray:
    least = np.full(SKETCH, np.uint64(0xFFFFFFFFFFFFFFFF))
    for a in range(0, len(found), 4096):
        np.minimum(least, (found[a : a + 4096, None] * _SKETCH_BY).min(0), out=least)
    return (_mix(least) >> np.uint64(56)).astype(np.uint8)


SIGNED = "doc_id long, text_key binary, key binary, size int, sketch binary, paths array<struct<run:int,tok:long>>"


def _sign(batches):
    for batch in batches:
        rows = {k: [] for k in ("key", "size", "sketch")}
        offsets, runs, tokens = [0], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            found = shingles(text)
            rows["key"].append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
            rows["size"].append(len(found))
            rows["sketch"].append(sketch(found).tobytes() if len(found) else None)
            if len(found):
                r, t = paths(found, 0)
                runs.append(r.astype(np.int32))
                tokens.append(t.view(np.int64))
            offsets.append(offsets[-1] + (len(r) if len(found) else 0))
        taken = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(np.concatenate(runs)), pa.array(np.concatenate(tokens))], names=["run", "tok"]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), batch.column("text_key"), pa.array(rows["key"], pa.binary()), pa.array(rows["size"], pa.int32()), pa.array(rows["sketch"], pa.binary()), taken],
            names=["doc_id", "text_key", "key", "size", "sketch", "paths"],
        )


def _onward(level: int):
    """Paths of a further level, for the sets in large buckets alone."""

    def run(batches):
        for batch in batches:
            rids, runs, tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
            for rid, text in zip(batch.column("rid").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                r, t = paths(shingles(text), level)
                rids.append(np.full(len(r), rid))
                runs.append(r.astype(np.int32))
                tokens.append(t.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (rids, runs, tokens)], names=["rid", "run", "tok"])

    return run


def _forest(n: int, pairs) -> list[tuple[int, int]]:
    """Edges of a spanning forest, each tree a star around its least node."""
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i, j in pairs:
        i, j = root(i), root(j)
        if i != j:
            parent[max(i, j)] = min(i, j)
    return [(i, r) for i in range(n) if (r := root(i)) != i]


def bucket_edges(ids: np.ndarray, sizes: np.ndarray, sketches: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a bucket's near sets."""
    order = np.lexsort((ids, sizes))
    ids, sizes, sketches = ids[order], sizes[order], sketches[order]
    edges, left = [], np.arange(len(ids))  # left: not reached yet, by size
    while len(left) > 1:
        seed, frontier, left = left[0], [left[0]], left[1:]
        while frontier and len(left):
            some, frontier = np.array(frontier[:64]), frontier[64:]
            # sets whose sizes differ too much are never similar enough
            lo, hi = np.searchsorted(sizes[left], [THRESHOLD * sizes[some].min(), sizes[some].max() / THRESHOLD + 1])
            reached = []
            for a in range(lo, hi, 4096):
                near = left[a : min(a + 4096, hi)]
                x, y = np.nonzero((sketches[some, None, :GLANCE] == sketches[near, :GLANCE]).sum(2) >= GLANCE_LEAST)
                for k in range(0, len(x), 8192):
                    good = (sketches[some[x[k : k + 8192]]] == sketches[near[y[k : k + 8192]]]).sum(1) >= NEAR * SKETCH
                    reached.append(near[y[k : k + 8192][good]])
            new = np.unique(np.concatenate(reached)) if reached else np.zeros(0, np.int64)
            if len(new):
                edges += [(int(ids[k]), int(ids[seed])) for k in new]
                left = left[~np.isin(left, new)]
                frontier += new.tolist()
    return edges


def _density(batches):
    for batch in batches:
        dense = []
        for row in batch.column("sample").to_pylist():
            sketches = np.frombuffer(b"".join(x["sketch"] for x in row), np.uint8).reshape(-1, SKETCH)
            agree = (sketches[:, None] == sketches).mean(2)
            dense.append(bool(len(row) > 1 and (agree[np.triu_indices(len(row), 1)] >= DENSE).mean() >= 0.5))
        yield pa.RecordBatch.from_arrays([batch.column("bucket"), pa.array(dense, pa.bool_())], names=["bucket", "dense"])


def _brute_force(batches):
    """Over rows (bucket, rid, size, sketch) in the order of buckets: candidate edges."""
    held, last = [], None
    edges: set = set()

    def settle(rows):
        sketches = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(-1, SKETCH)
        edges.update(bucket_edges(np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), sketches))

    def out():
        if edges:
            found = list(edges)
            edges.clear()
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in found], pa.int64()), pa.array([e[1] for e in found], pa.int64())], names=["a", "b"])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("bucket", "rid", "size", "sketch")]
        buckets = batch.column("bucket").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
        for a, b in zip(cuts, cuts[1:]):
            rows = list(zip(*(c[a:b] for c in columns)))
            if held and rows and rows[0][0] == last:
                held += rows
            else:
                if len(held) > 1:
                    settle(held)
                held = rows
            last = held[0][0] if held else None
        if len(edges) > 50_000:
            yield from out()
    if len(held) > 1:
        settle(held)
    yield from out()


def _crowds(rows: DataFrame, work: Workspace, most: int) -> DataFrame:
    """Candidate edges in buckets of over ``most`` sets: rows (bucket, rid, count, size, sketch)."""
    half = max(1, most // 2)
    force = lambda cells: cells.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_brute_force, "a long, b long").distinct()
    split = lambda n: F.greatest(F.lit(1), F.ceil(n / half)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    deal = lambda n: F.pmod(F.xxhash64("rid", F.lit(5)), n).cast("int")
    h, what = F.xxhash64("rid"), ["rid", "size", "sketch"]
    rows = work.table(rows.withColumn("parts", split(F.col("count"))).withColumn("part", deal(F.col("parts"))), "crowds")
    picks = [F.min(F.when(F.pmod(h, F.lit(SAMPLE)) == i, F.struct(h.alias("h"), *what))) for i in range(SAMPLE)]
    leaders = rows.groupBy("bucket", "parts").agg(F.array_compact(F.array(*picks)).alias("picks"))
    leaders = leaders.select("bucket", F.explode("picks").alias("x"), "parts").select("bucket", each(F.col("parts")).alias("part"), *[F.col(f"x.{c}") for c in what])
    cell = lambda *names: F.xxhash64(*names).alias("bucket")
    first = work.table(force(rows.select("bucket", "part", *what).unionByName(leaders).select(cell("bucket", "part"), *what).distinct()), "crowd-edges")
    linked = components(first, work, "crowd")
    rooted = work.table(rows.join(linked.select(F.col("node").alias("rid"), "root").hint("merge"), "rid", "left").withColumn("root", F.coalesce("root", "rid")), "rooted")
    sizes = rooted.groupBy("bucket", "root").count()
    main = sizes.groupBy("bucket").agg(F.max(F.struct("count", "root")).alias("m"), F.sum("count").alias("all")).select("bucket", F.col("m.root").alias("main"), split(F.col("all") - F.col("m.count")).alias("blocks"), (F.col("all") > F.col("m.count")).alias("some"))
    told = work.table(rooted.join(main.where("some").hint("merge"), "bucket"), "told")
    if told.isEmpty():
        return first
    rest = told.where("root <> main").withColumn("block", deal(F.col("blocks"))).select("bucket", "block", each(F.col("parts")).alias("part"), *what)
    members = told.select("bucket", each(F.col("blocks")).alias("block"), "part", *what)
    return first.unionByName(force(members.unionByName(rest).select(cell("bucket", "part", "block"), *what).distinct()))


def _with_shingles(batches):
    for batch in batches:
        found = [shingles(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("root"), batch.column("rid"), batch.column("times"), batch.column("blocks"), pa.array([f.tobytes() for f in found], pa.binary())], names=["root", "rid", "times", "blocks", "shingles"])


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, word, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    inter = np.zeros((n, n), np.float32)
    keep = counts[word] > 1
    owner, word = owner[keep], word[keep]
    names, word = np.unique(word, return_inverse=True)
    order = np.argsort(word, kind="stable")
    owner, word = owner[order], word[order]
    for a in range(0, len(names), 2048):  # 2048 shingles at a time
        lo, hi = np.searchsorted(word, [a, a + 2048])
        table = np.zeros((n, 2048), np.float32)
        table[owner[lo:hi], word[lo:hi] - a] = 1
        rows = np.unique(owner[lo:hi])
        part = table[rows]
        inter[np.ix_(rows, rows)] += part @ part.T
    return inter


def _count(batches):
    """Over rows in the order of (root, i, j): links of each set, and a forest of them."""
    held, last = [], None

    def settle(rows):
        _, i, j = last
        sets = [np.frombuffer(r[4], np.uint64) for r in rows]
        size = np.array([len(s) for s in sets], np.float64)
        inter = _shared(sets)
        near = inter >= THRESHOLD * (size[:, None] + size - inter) - 1e-6
        np.fill_diagonal(near, False)
        if i != j:
            block = np.array([r[5] for r in rows])
            near &= block[:, None] != block
        times = np.array([r[2] for r in rows], np.int64)
        links = near @ times
        ids = [r[1] for r in rows]
        a, b = np.nonzero(np.triu(near, 1))
        return [(ids[k], int(links[k]), None) for k in np.flatnonzero(links)] + [(ids[x], 0, ids[y]) for x, y in _forest(len(ids), zip(a.tolist(), b.tolist()))]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["rid", "links", "other"])

    done = []
    for batch in batches:
        for root, i, j, rid, times, data, block in zip(*(batch.column(c).to_pylist() for c in ("root", "i", "j", "rid", "times", "shingles", "block"))):
            if (root, i, j) != last:
                if len(held) > 1:
                    done += settle(held)
                held, last = [], (root, i, j)
            held.append((root, rid, times, None, data, block))
        if len(done) > 20_000:
            yield batch_of(done)
            done = []
    if len(held) > 1:
        done += settle(held)
    if done:
        yield batch_of(done)


def _sources(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """``keys`` with the text of each text_key; only such texts move."""
    found = marked(texts, keys, "text_key").where("hit").groupBy("text_key").agg(F.first("text").alias("text"))
    return keys.hint("merge").join(found, "text_key")


def classes(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """doc_id, class_id, class_size, n_links: a row for each row of ``docs`` (doc_id, text)."""
    work = Workspace(docs.sparkSession, "jaccard")
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("binary").alias("text_key"))
    signed = work.table(texts.mapInArrow(_sign, SIGNED), "signed")
    first = lambda *names: [F.first(n).alias(n) for n in names]
    sets = work.table(signed.where("size > 0").groupBy("key").agg(*first("text_key", "size", "sketch", "paths"), F.count("*").alias("times"), F.min("doc_id").alias("least_id")).withColumn("rid", F.monotonically_increasing_id()), "sets")

    # Buckets: those that are small enough, level by level.
    level = sets.select("rid", F.explode("paths").alias("p")).select("rid", "p.run", F.col("p.tok").alias("bucket"))
    ready = crowds = None
    sketches = sets.select("rid", "size", "sketch")
    for depth in range(DEPTH):
        counts = work.table(level.groupBy("bucket").count().where("count > 1"), f"counts-{depth}")
        level = work.table(level.join(counts.hint("merge"), "bucket"), f"level-{depth}")
        done = level.where(F.col("count") <= bucket)
        big = level.where(F.col("count") > bucket)
        if depth < DEPTH - 1 and not big.isEmpty():
            h = F.xxhash64("rid")
            picks = [F.min(F.when(F.pmod(h, F.lit(SAMPLE)) == i, F.struct(h.alias("h"), "sketch"))) for i in range(SAMPLE)]
            sample = big.join(sketches.hint("merge"), "rid").groupBy("bucket").agg(F.array_compact(F.array(*picks)).alias("sample"))
            dense = work.table(sample.mapInArrow(_density, "bucket long, dense boolean").where("dense").select("bucket"), f"dense-{depth}")
            alike = big.join(dense, "bucket", "left_semi").select("bucket", "rid", "count")
            crowds = alike if crowds is None else crowds.unionByName(alike)
            big = big.join(dense, "bucket", "left_anti")
        elif depth == DEPTH - 1:
            alike = big.select("bucket", "rid", "count")
            crowds = alike if crowds is None else crowds.unionByName(alike)
        ready = done.select("bucket", "rid") if ready is None else ready.unionByName(done.select("bucket", "rid"))
        if depth == DEPTH - 1 or big.isEmpty():
            break
        wanted = work.table(big.select("rid").distinct().join(sets.select("rid", "text_key").hint("merge"), "rid"), f"wanted-{depth}")
        onward = _sources(texts, wanted).mapInArrow(_onward(depth + 1), "rid long, run int, tok long")
        level = big.drop("count").join(onward, ["rid", "run"]).select("rid", "run", F.xxhash64("bucket", "tok").alias("bucket"))
    rows = ready.join(sketches.hint("merge"), "rid")
    found = work.table(rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_brute_force, "a long, b long").distinct(), "candidates")
    if crowds is not None and not crowds.isEmpty():
        found = found.unionByName(_crowds(crowds.join(sketches.hint("merge"), "rid"), work, bucket))
    work.drop(*(f"{n}-{d}" for n in ("level", "counts", "dense", "wanted") for d in range(DEPTH)))
    near = work.table(components(found, work, "near"), "near")

    # Exact counts within components, in pairs of blocks.
    members = near.join(sets.select("rid", "size", "times", "text_key").hint("merge"), near["node"] == F.col("rid")).select("root", "rid", "size", "times", "text_key")
    blocks = members.groupBy("root").agg(F.greatest(F.ceil(F.sum("size") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_SETS)).cast("int").alias("blocks"))
    members = work.table(members.join(blocks.hint("merge"), "root"), "members")
    held = work.table(_sources(texts, members).select("root", "rid", "times", "blocks", "text").mapInArrow(_with_shingles, "root long, rid long, times long, blocks int, shingles binary"), "held")
    block = F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int")
    pairs = held.withColumn("block", block).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("root", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"), "rid", "times", "shingles", "block")
    counted = work.table(pairs.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(_count, "rid long, links long, other long"), "counted")
    work.drop("held", "members", "near", "candidates")
    linked = work.table(components(counted.where("other IS NOT NULL").select(F.col("rid").alias("a"), F.col("other").alias("b")), work, "linked"), "linked")

    links = counted.groupBy("rid").agg(F.sum("links").alias("links"))
    whole = sets.select("rid", "key", "times", "least_id").join(linked.withColumnRenamed("node", "rid").hint("merge"), "rid", "left").join(links.hint("merge"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    groups = whole.groupBy("root").agg(F.min("least_id").alias("class_id"), F.sum("times").alias("class_size"))
    by_key = work.table(whole.join(groups.hint("merge"), "root").select("key", "class_id", "class_size", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links")), "classes")
    work.drop("counted", "linked", "sets")
    known = signed.select("doc_id", "key").where("key IS NOT NULL").join(by_key.hint("merge"), "key").select("doc_id", "class_id", "class_size", "n_links")
    blank = signed.where("key IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links"))
    return known.unionByName(blank)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents of which one of each class stays, with all their columns: the row with the least doc_id (null ids last), whatever rows share an id."""
    work = Workspace(docs.sparkSession, "one-of-each")
    rows = work.table(docs.select(F.monotonically_increasing_id().alias("id"), F.struct(*[F.col(c) for c in docs.columns]).alias("row")), "rows")
    found = classes(rows.select(F.col("id").alias("doc_id"), F.col("row.text").alias("text"))).where("class_size > 1").select(F.col("doc_id").alias("id"), "class_id")
    members = work.table(found.hint("merge").join(rows.select("id", F.col("row.doc_id").alias("doc_id")), "id"), "members")
    stays = members.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id")).alias("first")).select(F.col("first.id").alias("id"))
    return without(rows, work.table(members.select("id").join(stays.hint("merge"), "id", "left_anti"), "gone"), "id").select("row.*")


def op7_jaccard_join(spark, sf_dir):
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = f"""
WITH RECURSIVE a AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT r, unnest(list_distinct(list_transform(range(1, greatest(2, len(w) - {WORDS} + 2)), lambda i: hash(array_to_string(w[i:i + {WORDS - 1}], ' '))))) AS g FROM a WHERE len(w) > 0),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT x.r AS a, y.r AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.r <> y.r GROUP BY ALL),
l AS MATERIALIZED (SELECT p.a, p.b FROM p JOIN n u ON u.r = p.a JOIN n v ON v.r = p.b WHERE 10 * p.c >= 8 * (u.n + v.n - p.c)),
reach AS (SELECT r, r AS m FROM a UNION SELECT reach.r, l.b FROM reach JOIN l ON l.a = reach.m),
c AS (SELECT reach.r, min(t.doc_id) AS class_id, count(*) AS class_size FROM reach JOIN a t ON t.r = reach.m GROUP BY reach.r)
SELECT a.doc_id, c.class_id, c.class_size::BIGINT AS class_size, (SELECT count(*) FROM l WHERE l.a = a.r)::BIGINT AS n_links FROM a JOIN c ON c.r = a.r
"""
