"""Product quantisation of vectors into codes of a byte a part, in whole numbers.

Vectors are scaled and floored to integers and cut into equal consecutive parts.  Each
part's codebook begins as that part of the first vectors; a round assigns every part to
the nearest entry and moves each entry to the floored mean of its parts.  Blocks of
vectors are kept column by column, as NumPy arrays in a table of the shared folder, so
that distances accumulate dimension by dimension.  A round is one ``treeAggregate``: a
task adds its blocks into a tensor of integer sums and one of counts, and tensors of
fixed size (vector length x entries), not vectors, meet in the reduction tree.  All
sums are whole numbers, so results are the same in any order and after lost tasks.

Defined cases: rows whose vector is null or holds null, NaN or infinite components are
dropped; vectors shorter than the longest one, or than a whole number of parts, count
as followed by zeros; the codebook begins with the least ids, rows of one id in the
order of their vectors, rows without an id last, and has fewer entries if there are
fewer vectors; repeated rows are coded one by one; components of any finite size are
exact (beyond 2**24 they are Python integers); an error beyond a long is the
largest long; rows without a label share one ``label_error``; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workspace import Workspace

SCALE = 256
PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Vectors whose distances to all entries of a part are held at once.
AT_ONCE = 4096
#: Below this, sums of squared differences of up to 2**13 components fit 64 bits.
NARROW = 1 << 24
LONGEST = (1 << 63) - 1
#: A label's rows are joined to its sum in so many groups.
SALTS = 32
_BLOCK = "n int, wide boolean, kind string, data binary"


def _whole(x: float) -> int:
    """floor(SCALE * x), exactly."""
    return int(x) * SCALE if abs(x) >= 1 << 52 else math.floor(x * SCALE)


def _usable(vectors: DataFrame, vector: str) -> DataFrame:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))
    return vectors.where(F.col(vector).isNotNull() & F.forall(vector, finite))


def _columns(block: Row, dims: int) -> np.ndarray:
    """A block's integers, a row for each dimension."""
    if block["wide"]:
        floats = np.frombuffer(block["data"], np.float64)
        whole = np.empty(len(floats), object)
        whole[:] = [_whole(x) for x in floats]
        return whole.reshape(dims, block["n"])
    return np.frombuffer(block["data"], block["kind"]).reshape(dims, block["n"])


def blocks(vectors: DataFrame, dims: int, vector: str, carried: list[str]) -> DataFrame:
    """Vectors as columnar blocks, each with its rows' carried columns as arrays."""
    fields = vectors.select(*carried).schema.fields
    schema = T.StructType(T._parse_datatype_string(_BLOCK).fields + [T.StructField(f.name, T.ArrayType(f.dataType)) for f in fields])

    def packed(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            lists = batch.column("_vector")
            lengths = np.diff(lists.offsets.to_numpy())
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            rows = np.zeros((n, dims))
            rows[np.repeat(np.arange(n), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
            floats = np.ascontiguousarray(rows.T)
            wide = bool(np.abs(floats).max(initial=0) * SCALE >= NARROW)
            if not wide:
                floats = np.floor(floats * SCALE)
                most = np.abs(floats).max(initial=0)
            kind = "<f8" if wide else "<i2" if most < 1 << 15 else "<i4"
            out = {"n": pa.array([n], pa.int32()), "wide": pa.array([wide]), "kind": [kind], "data": pa.array([floats.astype(kind).tobytes()], pa.binary())}
            for f in fields:
                column = batch.column(f.name)
                out[f.name] = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), column)
            yield pa.RecordBatch.from_pydict(out)

    return vectors.select(F.col(vector).cast("array<double>").alias("_vector"), *carried).mapInArrow(packed, schema)


def nearest(columns: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a block and books (part, entry, position): codes (part, vector), and errors summed over parts."""
    parts, entries, width = books.shape
    exact = np.int64 if columns.dtype != object and books.dtype != object else object
    n = columns.shape[1]
    codes, errors = np.zeros((parts, n), np.uint8), np.zeros(n, exact)
    for first in range(0, n, AT_ONCE):
        here = slice(first, first + AT_ONCE)
        for p in range(parts):
            far = np.zeros((entries, len(errors[here])), exact)
            for d in range(width):
                apart = columns[p * width + d, here].astype(exact)[None, :] - books[p, :, d, None]
                far += apart * apart
            code = far.argmin(0)
            codes[p, here] = code
            errors[here] += far[code, np.arange(far.shape[1])]
    return codes, errors


def _round(table: DataFrame, books: np.ndarray) -> np.ndarray:
    """Books after one round."""
    parts, entries, width = books.shape
    sent = table.sparkSession.sparkContext.broadcast(books)

    def add(total, block):
        sums, counts = total
        columns = _columns(block, parts * width)
        if columns.dtype == object and sums.dtype != object:
            sums = sums.astype(object)
        codes, _ = nearest(columns, sent.value)
        for p in range(parts):
            np.add.at(counts[p], codes[p], 1)
            for d in range(width):
                np.add.at(sums[p, :, d], codes[p], columns[p * width + d])
        return sums, counts

    zero = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
    sums, counts = table.select("n", "wide", "kind", "data").rdd.treeAggregate(zero, add, lambda a, b: (a[0] + b[0], a[1] + b[1]))
    sent.unpersist()
    moved = sums // np.maximum(counts, 1)[:, :, None].astype(sums.dtype)
    return _fitting(np.where(counts[:, :, None] > 0, moved, books))


def _fitting(books: np.ndarray) -> np.ndarray:
    """As 64-bit integers if distances to them surely fit."""
    return books.astype(np.int64) if all(abs(x) < NARROW for x in books.flat) else books.astype(object)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id: str = "vec_id", vector: str = "embedding", carried: tuple[str, ...] = ("label",)) -> tuple[DataFrame, np.ndarray]:
    """A table (id, carried columns, slot, code binary of a byte a part, error long), and the books (part, entry, position)."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte a part")
    usable = _usable(vectors, vector)
    longest = usable.agg(F.max(F.size(vector))).first()[0] or 0
    width = -(-longest // parts)
    dims = width * parts
    work = Workspace(vectors.sparkSession, "vector-codes")
    kept = [id, *carried]
    table = work.table(blocks(usable, dims, vector, kept), "blocks")
    first = usable.orderBy(F.col(id).asc_nulls_last(), vector).select(vector).limit(entries).collect()
    start = [[_whole(x) for x in r[0]] + [0] * (dims - len(r[0])) for r in first]
    whole = np.empty((len(start), dims), object)
    if start and dims:
        whole[:] = start
    books = _fitting(whole.reshape(len(start), parts, width).transpose(1, 0, 2))
    for _ in range(rounds if start else 0):
        books = _round(table, books)
    fields = vectors.select(*kept).schema.fields
    schema = T.StructType(fields + T._parse_datatype_string("slot int, code binary, error long").fields)

    def coded(batches):
        for batch in batches:
            for i, block in enumerate(batch.select(["n", "wide", "kind", "data"]).to_pylist()):
                codes, errors = nearest(_columns(block, dims), books)
                flat = np.ascontiguousarray(codes.T).tobytes()
                out = {f.name: batch.column(f.name).slice(i, 1).flatten() for f in fields}
                out["slot"] = pa.array(np.arange(block["n"]) % SALTS, pa.int32())
                out["code"] = pa.array([flat[k * parts : (k + 1) * parts] for k in range(block["n"])], pa.binary())
                out["error"] = pa.array([min(int(e), LONGEST) for e in errors], pa.int64())
                yield pa.RecordBatch.from_pydict(out)

    return work.table(table.mapInArrow(coded, schema), "codes"), books


def decoded(code: bytes, books: np.ndarray) -> list[float]:
    """The vector that a code stands for."""
    return [float(x) / SCALE for p, k in enumerate(code) for x in books[p, k]]


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in books.flat).encode()).hexdigest()


def with_label_errors(codes: DataFrame, label: str = "label") -> DataFrame:
    """Adds label_error, the error summed over rows of the label; sums are made before rows move, and a label's rows join in SALTS groups."""
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("long")
    sums = codes.groupBy(F.col(label).alias("_label")).agg(total.alias("label_error")).withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return codes.join(sums, (F.col("slot") == F.col("_slot")) & F.col(label).eqNullSafe(F.col("_label"))).drop("_slot", "_label")


def op11_vector_codes(spark, sf_dir):
    codes, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return with_label_errors(codes).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _assigned(books: str) -> str:
    """Least distance * 64 + entry of each vector's part."""
    return f"""SELECT vec_id, part, min(far * {ENTRIES} + entry) AS best FROM (
        SELECT v.vec_id, v.part, b.entry, sum((v.x - b.x) * (v.x - b.x)) AS far
        FROM v JOIN {books} b ON v.part = b.part AND v.pos = b.pos GROUP BY ALL) GROUP BY ALL"""


def _moved(books: str, assigned: str) -> str:
    return f"""SELECT b.part, b.entry, b.pos, coalesce(m.x, b.x) AS x FROM {books} b LEFT JOIN (
        SELECT v.part, a.best % {ENTRIES} AS entry, v.pos, floor(sum(v.x)::DOUBLE / count(*))::HUGEINT AS x
        FROM v JOIN {assigned} a USING (vec_id, part) GROUP BY ALL) m USING (part, entry, pos)"""


SQL = f"""
WITH kept AS (
    SELECT vec_id, label, embedding AS e, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS MATERIALIZED (
    SELECT vec_id, place, i // (n // {PARTS}) AS part, i % (n // {PARTS}) AS pos, floor({SCALE} * x::DOUBLE)::HUGEINT AS x
    FROM (SELECT vec_id, place, len(e) AS n, unnest(e) AS x, unnest(range(len(e))) AS i FROM kept)
), b0 AS MATERIALIZED (SELECT part, place AS entry, pos, x FROM v WHERE place < {ENTRIES}),
a0 AS MATERIALIZED ({_assigned("b0")}), b1 AS MATERIALIZED ({_moved("b0", "a0")}),
a1 AS MATERIALIZED ({_assigned("b1")}), b2 AS MATERIALIZED ({_moved("b1", "a1")}),
a2 AS MATERIALIZED ({_assigned("b2")}),
coded AS (
    SELECT vec_id, string_agg(printf('%02x', (best % {ENTRIES})::BIGINT), '' ORDER BY part) AS code, sum(best // {ENTRIES})::BIGINT AS error FROM a2 GROUP BY vec_id
), digest AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id) CROSS JOIN digest
"""
