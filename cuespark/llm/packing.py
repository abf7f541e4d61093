"""Best-fit packing by minimum bin slack.

Documents become pieces of at most ``capacity`` tokens; pieces are packed into as few
sequences as can be.  Per sequence, the longest piece left is set and a bitset
subset-sum dynamic program over the lengths that are left finds the fullest
combination that still fits; its pieces are taken out, and the combination is used
again as often as the lengths last.

Pieces of one length are alike, so what is solved is the histogram of lengths: at
most ``capacity`` rows, whatever the corpus, and each combination uses up a length
at least once, so there are few.  Pieces then find their place by their rank among
those of their length; ranks are formed in two levels, so that a length that a
third of all pieces has is not ranked in one task.

Defined cases: null text counts as empty and gives one piece, the end id; repeated
rows and ids are packed like others; only documents over the capacity are cut; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tokens import END, in_batches, shared_encoder, tokenizer_path
from .workspace import Workspace

CAPACITY = 4096
ROWS_PER_BUCKET = 20_000


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """The multiset of lengths with the largest sum of at most ``room``: length -> times.

    ``lengths``: those in ``counts``, falling.  Bit s of a set says that sum s can be
    reached; sets are kept after each copy of a length, to find the way back.
    """
    within = (1 << (room + 1)) - 1
    reached, steps, full = 1, [], 1 << room
    for x in lengths:
        if x > room:
            continue
        for _ in range(min(counts[x], room // x)):
            new = (reached | reached << x) & within
            if new == reached:
                break
            steps.append((x, reached))
            reached = new
        if reached & full:
            break
    best, chosen = reached.bit_length() - 1, {}
    for x, before in reversed(steps):
        if not before >> best & 1:
            chosen[x] = chosen.get(x, 0) + 1
            best -= x
    return chosen


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Combinations (length -> times) and how many sequences have each."""
    counts = dict(histogram)
    lengths = sorted(counts, reverse=True)
    out = []
    while lengths:
        longest = lengths[0]
        counts[longest] -= 1
        chosen = fullest(counts, lengths, capacity - longest)
        counts[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(counts[x] // n for x, n in chosen.items())
        for x, n in chosen.items():
            counts[x] -= n * times
        if any(not counts[x] for x in chosen):
            lengths = [x for x in lengths if counts[x]]
        out.append((chosen, times))
    return out


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenised documents, each with its end id, cut where they are longer than ``capacity``."""
    path = path or tokenizer_path()
    end = np.array([END], "<u4").tobytes()

    def run(batches):
        encoder = shared_encoder(path)
        for batch in batches:
            texts, ids = batch.column("text").fill_null("").to_pylist(), batch.column("doc_id").cast(pa.int64()).to_pylist()
            for a, b in in_batches(texts):
                rows = []
                for doc_id, found in zip(ids[a:b], encoder.encode(texts[a:b])):
                    data = np.frombuffer(found, "<u2").astype("<u4").tobytes() + end
                    n = len(data) // 4
                    rows += [(doc_id, k, at, min(capacity, n - at), zlib.crc32(data[4 * at : 4 * (at + capacity)])) for k, at in enumerate(range(0, n, capacity))]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32)."""
    work = Workspace(found.sparkSession, "packing")
    table = work.table(found, "pieces")
    histogram = {r[0]: r[1] for r in table.groupBy("length").count().collect()}
    # place[length]: ranks from first[k] on lie in sequences from base[k] on, `times` of them in each, at at[k]
    place: dict[int, list[tuple[int, int, int, int]]] = {x: [] for x in histogram}
    used, sequence = dict.fromkeys(histogram, 0), 0
    for chosen, sequences in plan(histogram, capacity):
        at = 0
        for x, times in sorted(chosen.items(), reverse=True):
            place[x].append((used[x], sequence, times, at))
            used[x] += times * sequences
            at += x * times
        sequence += sequences
    tables = {x: tuple(np.array(c, np.int64) for c in zip(*rows)) for x, rows in place.items()}

    buckets = max(16, sum(histogram.values()) // ROWS_PER_BUCKET)
    order = ["doc_id", "piece", "start", "ids_crc32"]
    dealt = table.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy("length", "bucket").count()
    before = sizes.select("length", "bucket", (F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*order)) - 1
    ranked = dealt.withColumn("inside", inside).join(before, ["length", "bucket"]).select(*table.columns, (F.col("inside") + F.col("before")).cast("long").alias("rank"))

    columns = table.columns

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence_id, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                rows = np.flatnonzero(length == x)
                first, base, times, at = tables[int(x)]
                k = np.searchsorted(first, rank[rows], "right") - 1
                turn, slot = np.divmod(rank[rows] - first[k], times[k])
                sequence_id[rows], offset[rows] = base[k] + turn, at[k] + slot * x
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(sequence_id), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    return ranked.mapInArrow(run, PIECES + ", sequence_id long, offset long")


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    return pack(pieces(docs, path, capacity), capacity)


def op2_packing(spark, sf_dir):
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
