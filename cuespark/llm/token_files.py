"""Token files coded by a static range asymmetric numeral system.

A file holds the ids of whole documents in ascending doc_id order:

    magic and version; ids, blocks, documents, lanes, precision, block length
    frequency table: the ids that occur and their frequencies, shared by all blocks
    directory of documents: doc_id (and whether it is null), ids of each
    block index: words, checkpoints and crc32 of each block
    blocks

A block codes its ids in ``LANES`` interleaved states of 64 bits that share one
stream of 32-bit words: id t belongs to lane t % LANES.  Each block can be decoded
by itself, and so can each stretch of CHECKPOINT steps within it, from the states
and the place in the stream that its checkpoint holds.  The checksum is over the
block's ids.

Files are rows of a Parquet table in the shared folder (part, segment, n_ids, data),
so that any store that Spark writes to will do.  Parts are ranges of doc_id in
order; a part's segments are files of about SEGMENT ids, which bounds what a task
holds whatever a range's size.  Frequencies are counted over all ids of a file.

Defined cases: null text counts as empty and has its end id alone; null ids come
first; rows of one doc_id follow each other in the order of their texts; an empty
table gives no files and an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tokens import END, in_batches, shared_encoder, tokenizer_path
from .workspace import Workspace

MAGIC, VERSION = b"RANS", 1
LANES = 2048
PRECISION = 20
#: Steps of all lanes between checkpoints; ids of a block; ids of a file, about.
CHECKPOINT = 128
BLOCK = 256 * LANES
SEGMENT = 2 << 20
_LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<4sHHIIIIII")


def frequencies(counts: np.ndarray, precision: int = PRECISION) -> np.ndarray:
    """Frequencies of ids that sum to 2**precision, at least 1 for each id that occurs."""
    total, n = 1 << precision, int(counts.sum())
    if np.count_nonzero(counts) > total:
        raise ValueError("more ids than the precision can tell apart")
    freq = np.where(counts > 0, np.maximum(1, counts * total // max(1, n)), 0).astype(np.int64)
    excess = int(freq.sum()) - total
    order = np.argsort(-freq, kind="stable")
    if excess < 0:
        freq[order[0]] -= excess
    k = 0
    while excess > 0:  # the largest give what the rare ones were raised by
        i = order[k % len(order)]
        take = min(excess, int(freq[i]) // 2)
        freq[i] -= take
        excess -= take
        k += 1
    return freq


def encode_block(ids: np.ndarray, freq: np.ndarray, start: np.ndarray, lanes: int = LANES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stream of words, and of each checkpoint the states and the place in the stream."""
    steps = -(-len(ids) // lanes)
    shift, keep = np.uint64(PRECISION), np.uint64(63 - PRECISION)
    x = np.full(lanes, _LOW, np.uint64)
    words, states, places, written = [], [], [], 0
    f_all, c_all = freq[ids].astype(np.uint64), start[ids].astype(np.uint64)
    for s in range(steps - 1, -1, -1):
        f, c = f_all[s * lanes : (s + 1) * lanes], c_all[s * lanes : (s + 1) * lanes]
        y = x[: len(f)]
        full = y >= (f << keep)
        if full.any():
            out = np.flatnonzero(full)
            words.append(y[out].astype(np.uint32)[::-1])
            written += len(out)
            y[out] >>= np.uint64(32)
        q = y // f
        x[: len(f)] = (q << shift) + (y - q * f) + c
        if s % CHECKPOINT == 0:
            states.append(x.copy())
            places.append(written)
    stream = np.concatenate(words)[::-1] if words else np.zeros(0, np.uint32)
    return stream.astype("<u4"), np.array(states[::-1], "<u8").reshape(-1, lanes), written - np.array(places[::-1], "<i8")


def decode_stretch(stream: np.ndarray, state: np.ndarray, at: int, n: int, freq: np.ndarray, start: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """The n ids that follow a checkpoint."""
    lanes = len(state)
    x, out = state.astype(np.uint64), np.empty(n, np.int32)
    mask, shift = np.uint64((1 << PRECISION) - 1), np.uint64(PRECISION)
    for a in range(0, n, lanes):
        m = min(lanes, n - a)
        y = x[:m]
        slot = y & mask
        ids = symbol[slot]
        out[a : a + m] = ids
        y = freq[ids] * (y >> shift) + slot - start[ids]
        low = np.flatnonzero(y < _LOW)
        if len(low):
            y[low] = (y[low] << np.uint64(32)) | stream[at : at + len(low)]
            at += len(low)
        x[:m] = y
    return out


def write_file(doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A file of these documents, whose ids follow each other in ``ids``."""
    counts = np.bincount(ids, minlength=1)
    freq = frequencies(counts)
    start = np.concatenate([[0], np.cumsum(freq)[:-1]])
    used = np.flatnonzero(freq)
    blocks, index = [], []
    for a in range(0, len(ids), BLOCK):
        part = ids[a : a + BLOCK]
        stream, states, places = encode_block(part, freq, start)
        index.append(struct.pack("<III", len(stream), len(places), zlib.crc32(part.astype("<u4").tobytes())))
        blocks += [places.tobytes(), states.tobytes(), stream.tobytes()]
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    names = np.array([d or 0 for d in doc_ids], "<i8")
    head = _HEAD.pack(MAGIC, VERSION, PRECISION, len(ids), len(index), len(doc_ids), LANES, BLOCK, len(used))
    body = [head, used.astype("<u4").tobytes(), freq[used].astype("<u4").tobytes(), nulls.tobytes(), names.tobytes(), lengths.astype("<u4").tobytes(), *index, *blocks]
    return b"".join(body)


class TokenFile:
    """A file that has been read; its blocks and stretches can be decoded in any order."""

    def __init__(self, data: bytes):
        magic, version, precision, self.n_ids, n_blocks, n_docs, self.lanes, self.block, n_used = _HEAD.unpack_from(data)
        if (magic, version, precision) != (MAGIC, VERSION, PRECISION):
            raise ValueError("not a token file of this version")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, n, at)
            at += found.nbytes
            return found

        used, freq = take("<u4", n_used), take("<u4", n_used)
        self.freq = np.zeros(int(used[-1]) + 1 if n_used else 1, np.uint64)
        self.freq[used] = freq
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(used.astype(np.int32), freq)
        nulls, names = take("u1", n_docs), take("<i8", n_docs)
        self.doc_ids = [None if n else int(d) for n, d in zip(nulls, names)]
        self.lengths = take("<u4", n_docs).astype(np.int64)
        self.index = [struct.unpack_from("<III", data, at + 12 * k) for k in range(n_blocks)]
        at += 12 * n_blocks
        self.blocks = [(take("<i8", points), take("<u8", points * self.lanes).reshape(points, self.lanes), take("<u4", words)) for words, points, _ in self.index]

    def stretch(self, block: int, k: int) -> np.ndarray:
        """Ids from checkpoint k of a block to the next."""
        places, states, stream = self.blocks[block]
        size = min(self.block, self.n_ids - block * self.block)
        step = CHECKPOINT * self.lanes
        return decode_stretch(stream, states[k], int(places[k]), min(step, size - k * step), self.freq, self.start, self.symbol)

    def ids(self) -> np.ndarray:
        """All ids; raises if a block's checksum differs."""
        out = []
        for b, (_, points, crc) in enumerate(self.index):
            places, states, stream = self.blocks[b]
            part = decode_stretch(stream, states[0], int(places[0]), min(self.block, self.n_ids - b * self.block), self.freq, self.start, self.symbol)
            if zlib.crc32(part.astype("<u4").tobytes()) != crc:
                raise ValueError(f"block {b}: the checksum differs")
            out.append(part)
        return np.concatenate(out) if out else np.zeros(0, np.int32)


FILES = "part int, segment int, n_ids long, data binary"


def write(docs: DataFrame, work: Workspace, path: str | None = None, segment: int = SEGMENT) -> DataFrame:
    """Token files of all rows of ``docs`` (doc_id, text), as a written table."""
    path = path or tokenizer_path()

    def run(batches):
        encoder, part = shared_encoder(path), TaskContext.get().partitionId()
        names, found, held, number = [], [], 0, 0

        def flush():
            nonlocal names, found, held, number
            lengths = np.array([len(x) // 2 for x in found], np.int64)
            ids = np.frombuffer(b"".join(found), "<u2").astype(np.int32)
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "segment": pa.array([number], pa.int32()), "n_ids": pa.array([len(ids)], pa.int64()), "data": pa.array([write_file(names, lengths, ids)], pa.binary())})
            names, found, held, number = [], [], 0, number + 1
            return row

        end = END.to_bytes(2, "little")
        for batch in batches:
            texts, ids = batch.column("text").fill_null("").to_pylist(), batch.column("doc_id").cast(pa.int64()).to_pylist()
            for a, b in in_batches(texts):
                for doc_id, x in zip(ids[a:b], encoder.encode(texts[a:b])):
                    names.append(doc_id)
                    found.append(x + end)
                    held += len(x) // 2 + 1
                    if held >= segment:
                        yield flush()
        if names:
            yield flush()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return work.table(ordered.mapInArrow(run, FILES), "files", "none")


def read(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    # A row for each file, of numbers alone: two levels, parts and the segments of a part.
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    inside = files.select("part", "segment", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("segment")) - F.col("n_ids")).alias("inside"))
    starts = inside.join(before, "part").select("part", "segment", (F.col("part_start") + F.col("inside")).alias("file_start"))

    def run(batches):
        for batch in batches:
            for part, number, data in zip(batch.column("part"), batch.column("segment"), batch.column("data")):
                file = TokenFile(data.as_buffer().to_pybytes())
                raw = file.ids().astype("<u4").tobytes()
                stops = np.cumsum(file.lengths)
                first = stops - file.lengths
                n = len(stops)
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([part.as_py()] * n, pa.int32()),
                        "segment": pa.array([number.as_py()] * n, pa.int32()),
                        "doc_id": pa.array(file.doc_ids, pa.int64()),
                        "local": pa.array(first, pa.int64()),
                        "n_tokens": pa.array(file.lengths, pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first.tolist(), stops.tolist())], pa.int64()),
                    }
                )

    decoded = files.select("part", "segment", "data").mapInArrow(run, "part int, segment int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return decoded.join(starts, ["part", "segment"]).select("doc_id", (F.col("file_start") + F.col("local")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read(write(docs, Workspace(spark, "token-files")))
