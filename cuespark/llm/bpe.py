"""Byte-pair encoding by a contiguous rank array, and decoding.

A short word is a list of part boundaries with, beside each, the rank of merging the
two parts that follow it.  The list is scanned for its least rank, the boundary
between those two parts is deleted, the ranks of its neighbours are refreshed, and
so on until nothing merges.  Lists of so few entries are scanned faster than any
queue is kept.  A word of more than LONG parts, where scans would take quadratic
time, keeps the same boundaries and ranks, with the ranks also in a heap.

Defined cases: null text counts as empty and gives no ids; repeated rows and ids
are encoded one by one; texts of any length are encoded whole; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tokens import byte_characters, in_batches, shared_encoder, tokenizer_path

LONG = 200
_NONE = 1 << 60


class RankArrayWords:
    """Encodes words; ``tokenizer`` gives vocabulary and merges."""

    def __init__(self, tokenizer):
        model = json.loads(tokenizer.to_str())["model"]
        self.ids = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        merges = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.ranks = {(a, b): k for k, (a, b) in enumerate(merges)}
        self.characters = byte_characters()

    def parts(self, word: str) -> list[str]:
        shown = [self.characters[b] for b in word.encode()]
        if not shown:
            return []
        shown[-1] += self.suffix
        return self._merge_long(shown) if len(shown) > LONG else self._merge(shown)

    def _merge(self, parts: list[str]) -> list[str]:
        rank = self.ranks.get
        # ranks[i]: of merging parts i and i + 1
        ranks = [rank(pair, _NONE) for pair in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            i = ranks.index(least)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), _NONE)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), _NONE)
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        rank, n = self.ranks.get, len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := rank((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p in parts if p]

    def __call__(self, word: str) -> bytes:
        return b"".join([self.ids[p].to_bytes(2, "little") for p in self.parts(word)])


class Decoder:
    """Ids to text, special tokens included: the tokens with a space between, as the tokenizer has no decoder."""

    def __init__(self, tokenizer):
        if tokenizer.decoder is not None:
            raise ValueError("a tokenizer with a decoder of its own")
        self.tokens = [b""] * tokenizer.get_vocab_size()
        for token, i in tokenizer.get_vocab().items():
            self.tokens[i] = token.encode()

    def decode(self, ids: list[int]) -> bytes:
        return b" ".join(map(self.tokens.__getitem__, ids))


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (binary, two bytes an id, little-endian), decoded text; a row for each row of ``docs`` (doc_id, text)."""
    path = path or tokenizer_path()

    def run(batches):
        encoder = shared_encoder(path, RankArrayWords)
        decoder = Decoder(encoder.tokenizer)
        for batch in batches:
            texts, ids = batch.column("text").fill_null("").to_pylist(), batch.column("doc_id").cast(pa.int64())
            for a, b in in_batches(texts):
                found = encoder.encode(texts[a:b])
                yield pa.RecordBatch.from_pydict({"doc_id": ids[a:b], "ids": pa.array(found, pa.binary()), "decoded": pa.array([decoder.decode(np.frombuffer(x, "<u2").tolist()) for x in found], pa.binary()).cast(pa.string())})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, as ``encoded`` would give them, without moving ids and texts."""
    path = path or tokenizer_path()

    def run(batches):
        encoder = shared_encoder(path, RankArrayWords)
        decoder = Decoder(encoder.tokenizer)
        for batch in batches:
            texts, ids = batch.column("text").fill_null("").to_pylist(), batch.column("doc_id").cast(pa.int64())
            for a, b in in_batches(texts):
                found = [np.frombuffer(x, "<u2") for x in encoder.encode(texts[a:b])]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": ids[a:b],
                        "n_tokens": pa.array([len(x) for x in found], pa.int64()),
                        "ids_sha256": [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in found],
                        "decoded_sha256": [hashlib.sha256(decoder.decode(x.tolist())).hexdigest() for x in found],
                    }
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark, sf_dir):
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
