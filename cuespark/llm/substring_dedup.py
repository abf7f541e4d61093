"""Removal of long strings that stand in more than one place, by suffix arrays.

Every byte is removed that a string of ``length`` bytes covers which also starts
anywhere else, in the same text or another.

The work is divided by content.  In each string one gram (GRAM of its bytes in
RATIO) is its anchor, the first of those with the least hash, so equal strings have
equal anchors.  The strings of a text that share an anchor follow each other and
form a stretch.  Hashes of anchors and stretches are shuffled first: a stretch whose
anchor is met nowhere else has no repeats.  Of the others, stretches with equal
hashes form a class, and the bytes of one of a class, or two if it has several, go
to the task of their anchor.

There, what stands right of the anchor and, read backwards, what stands left of it
are put in order by a suffix array (suffix_groups) over symbols of SYMBOL bytes, of
each as many as decide its order.
Neighbours in it tell how many bytes they share, so runs of neighbours that share
enough on both sides hold equal strings: all bytes are compared, also those of
stretches that are equal as a whole.  What is found for the one or two of a class
holds for all of it; that rests on the class's 64-bit hash besides the anchor's, and
on the md5 of texts, by which copies are known: among g stretches of an anchor, two
different ones are taken for one with a chance below g*g / 2**65.

Stretches of an anchor that very many classes have are cut into parts by where in
their strings the anchor stands, and go to groups by the part and by the content
that all strings of it hold around the anchor; equal strings agree in both.  The
parts are then treated like stretches.  Where a group of parts is still too large,
it is cut into single strings, of which a group holds one class.

Passages of so many words that also stand elsewhere, of any length in bytes, are told
beside that (passages) and not taken out: their anchor is the one of their grams of
words with the least hash, stretches that are equal as a whole go by a hash, and of
others that share an anchor the windows are compared by md5.

Defined cases: null text counts as empty; texts of less than ``length`` bytes and
empty texts are left as they are; copies of a text are repeats of each other;
repeated rows are rows like any other; an empty table gives an empty result; other
columns are carried in a struct and cannot clash.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .suffix_groups import suffix_array
from .workspace import Workspace, marked

LENGTH = 400
#: Words of a passage that counts wherever else it stands.
PASSAGE_WORDS = 51
#: An anchor has GRAM bytes of RATIO of a string.
GRAM, RATIO = 8, 25
#: Bytes of a symbol of the suffix arrays.
SYMBOL = 16
#: Bytes of one suffix array, about; texts are cut into stretches PART bytes at a time.
BATCH, PART = 1 << 20, 8 << 20
#: Stretches of an anchor (or parts in a group) that one suffix array takes, at most.
PER_TASK = 8_000
#: Bytes of texts that are hashed at a time, about; what is computed for them stays in a processor's cache.
CHUNK = 1 << 16
#: Windows of words that are hashed at a time.
WINDOWS = 1 << 20
#: Places of the anchor that a part spans, where there are more: first so many, then one.
WIDTHS = (16, 1)

#: Bytes that part words.
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_powers = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 16)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _powers[k] = np.cumprod(np.full(size, base, np.uint64), dtype=np.uint64)
    return _powers[0], _powers[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Hashes:
    """Hashes of any substrings of a byte string."""

    def __init__(self, data: np.ndarray):
        up, self.down = _power(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return _mix((self.sums[stops] - self.sums[starts]) * self.down[starts])

    def every(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return _mix((self.sums[length:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def least_places(hashes: np.ndarray, span: int) -> np.ndarray:
    """For each run of ``span`` hashes the place of the least, the first of those that tie."""
    n = len(hashes) - span + 1
    low = np.uint64((1 << max(24, len(hashes).bit_length())) - 1)
    keys = np.full(-(-len(hashes) // span) * span, np.uint64(0xFFFFFFFFFFFFFFFF))
    np.bitwise_and(hashes, ~low, out=keys[: len(hashes)])
    keys[: len(hashes)] |= np.arange(len(hashes), dtype=np.uint64)
    rows = keys.reshape(-1, span)
    to_end = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    from_start = np.minimum.accumulate(rows, axis=1).ravel()
    return (np.minimum(to_end[:n], from_start[span - 1 : span - 1 + n]) & low).astype(np.int64)


def gram_of(length: int) -> int:
    return max(1, length * GRAM // RATIO)


def chunks(texts: list[bytes]):
    """First and end of runs of texts of CHUNK bytes, about."""
    first = size = 0
    for k, text in enumerate(texts):
        if size and size + len(text) > CHUNK:
            yield first, k
            first, size = k, 0
        size += len(text)
    if texts:
        yield first, len(texts)


def stretches(texts: list[bytes], length: int = LENGTH):
    """Arrays of texts' stretches: number of the text, anchor hash, content hash, first string's start, strings, anchor's place in the first."""
    out, gram = [], gram_of(length)
    pieces = [(k, at, text[at : at + PART + length - 1]) for k, text in enumerate(texts) for at in range(0, len(text) - length + 1, PART)]
    for a, b in chunks([data for _, _, data in pieces]):
        some = pieces[a:b]
        ends = np.cumsum([len(data) for _, _, data in some])
        opens = np.append(0, ends[:-1])
        hashes = Hashes(np.frombuffer(b"".join(data for _, _, data in some), np.uint8))
        grams = hashes.every(gram)
        place = least_places(grams, length - gram + 1)
        edge = np.ones(len(place) + 1, bool)
        np.not_equal(place[1:], place[:-1], out=edge[1:-1])
        edge[opens] = edge[ends - length + 1] = True
        edges = np.flatnonzero(edge)
        first, n = edges[:-1], np.diff(edges)
        piece = np.searchsorted(ends, first, "right")
        inside = first + length <= ends[piece]  # others reach from a piece into the next
        first, n, piece = first[inside], n[inside], piece[inside]
        offset = place[first] - first
        content = _mix(hashes.of(first, first + n - 1 + length) ^ _mix(n.astype(np.uint64) << np.uint64(32) ^ offset.astype(np.uint64)))
        number, begins = np.array([(k, at) for k, at, _ in some]).T
        out.append((number[piece], grams[place[first]].view(np.int64), content.view(np.int64), first - opens[piece] + begins[piece], n, offset))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 6


def deciding(symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many symbols of each row decide its order: up to the first that one and the same rest follows wherever it stands."""
    end = int(symbols.max(initial=0)) + 1
    at = np.arange(symbols.shape[1]) < sizes[:, None]
    here = symbols[at]
    then = np.append(here[1:], end)
    then[np.cumsum(sizes[sizes > 0]) - 1] = end
    after = np.full(end + 2, end + 1)  # the symbol that always follows, the end, or one for several
    after[here] = then
    after[here[after[here] != then]] = end + 1
    after[end] = end
    while (further := after[after]).tobytes() != after.tobytes():
        after = further
    known = np.zeros(symbols.shape, bool)
    known[at] = after[here] == end
    return np.where(known.any(1), known.argmax(1) + 1, sizes)


def ordered(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The order of byte strings by a suffix array over all of them, and how many bytes neighbours in it share.

    Strings are filled up with zeros to whole symbols; what is shared may reach into that.
    The array takes of each as many symbols as decide its order.
    """
    sizes = np.array([-(-len(x) // SYMBOL) for x in strings])
    width = max(1, int(sizes.max()))
    table = np.frombuffer(b"".join(x.ljust(width * SYMBOL, b"\0") for x in strings), np.uint8).reshape(len(strings), -1)
    words = table.view(">u8").reshape(len(strings), width, -1)
    symbols = np.zeros(words.shape[:2], np.int64)
    for k in range(words.shape[2]):  # the rank of a symbol's bytes among all: equal for equal bytes only
        names, rank = np.unique(words[:, :, k], return_inverse=True)
        symbols = np.unique(symbols * len(names) + rank.reshape(symbols.shape), return_inverse=True)[1].reshape(symbols.shape)
    ends = np.arange(len(strings))  # an end of its own for each string, before all symbols
    rows = np.concatenate([symbols + len(strings), ends[:, None]], axis=1)
    taken = deciding(symbols, sizes)
    rows[ends, taken] = ends
    starts = np.cumsum(taken + 1) - taken - 1
    order_of = np.empty(int((taken + 1).sum()), np.int64)
    order_of[suffix_array(rows[np.arange(width + 1) <= taken[:, None]])] = np.arange(len(order_of))
    order = np.argsort(order_of[starts])
    differ = table[order[1:]] != table[order[:-1]]
    shared = np.where(differ.any(1), differ.argmax(1), width * SYMBOL)
    return order, np.minimum(shared, SYMBOL * np.minimum(sizes[order[1:]], sizes[order[:-1]]))


def repeated(rows: list[tuple[int, int, bytes]], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """Of each row (strings, place of the anchor in the first, bytes): runs (first, strings) of its strings that another row holds too."""
    n, o = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    left, left_shared = ordered([r[2][: r[1]][::-1] for r in rows])
    right, right_shared = ordered([r[2][r[1] :] for r in rows])
    hits: list[tuple[np.ndarray, np.ndarray]] = []
    before, after = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    for k in range(int((o - n).min()) + 1, int(o.max()) + 1):  # strings with k bytes before the anchor
        those = np.flatnonzero((o >= k) & (o - n < k))
        if len(those) > 1:
            before[left[1:]] = np.cumsum(left_shared < k)
            after[right[1:]] = np.cumsum(right_shared < length - k)
            group = before[those] * len(rows) + after[those]
            by = np.argsort(group)
            same = np.zeros(len(by) + 1, bool)
            same[1:-1] = group[by[1:]] == group[by[:-1]]
            met = those[by[same[1:] | same[:-1]]]
            hits.append((met, o[met] - k))
    out: list[list[tuple[int, int]]] = [[] for _ in rows]
    if hits:
        row, at = (np.concatenate(x) for x in zip(*hits))
        by = np.lexsort((at, row))
        row, at = row[by], at[by]
        edge = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(at, prepend=-2) != 1))
        for a, size in zip(edge, np.diff(edge, append=len(row))):
            out[row[a]].append((int(at[a]), int(size)))
    return out


STRETCH = "key binary, m long, d long, s int, n int, o int"
#: Parts know their stretch's class and where in it they begin.
PARTS = STRETCH + ", cm long, cd long, at int"


def _stretch_rows(keys: pa.Array, columns, **more) -> pa.RecordBatch:
    m, d, s, n, o = columns
    return pa.RecordBatch.from_pydict({"key": keys, "m": m, "d": d, "s": s.astype(np.int32), "n": n.astype(np.int32), "o": o.astype(np.int32)} | more)


def _finder(length: int):
    def run(batches):
        for batch in batches:
            number, *columns = stretches(batch.column("text").cast(pa.binary()).to_pylist(), length)
            if len(number):
                yield _stretch_rows(batch.column("key").take(pa.array(number)), columns)

    return run


SLICED = ("m long, d long, again boolean, n int, o int, data binary", (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary()))


def _slicer(length: int):
    """Bytes of the stretches that are asked for."""

    def run(batches):
        for batch in batches:
            rows = []
            for text, asked in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("asked").to_pylist()):
                rows += [(x["m"], x["d"], x["again"], x["n"], x["o"], text[x["s"] : x["s"] + x["n"] - 1 + length]) for x in asked]
            for a in range(0, len(rows), 4000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 4000]), SLICED[1])], names=["m", "d", "again", "n", "o", "data"])

    return run


def parts(data: bytes, s: int, n: int, o: int, width: int, length: int):
    """Like ``stretches`` without the number, of one stretch: its parts of ``width`` places of the anchor; the hash is that of what all strings of the part would hold."""
    hashes = Hashes(np.frombuffer(data, np.uint8, n - 1 + length, s))
    low = np.arange((o - n + 1) // width, o // width + 1) * width
    high = np.minimum(low + width - 1, length - gram_of(length))
    top = np.minimum(high, o)  # the anchor stands a byte nearer with each string
    size = top - np.maximum(low, o - n + 1) + 1
    first = o - top
    around = _mix(hashes.of(o - low, o - high + length) ^ _mix(low.astype(np.uint64)))
    content = _mix(hashes.of(first, first + size - 1 + length) ^ _mix(size.astype(np.uint64) << np.uint64(32) ^ top.astype(np.uint64)))
    return around.view(np.int64), content.view(np.int64), first + s, size, top


def _cutter(width: int, length: int):
    def run(batches):
        for batch in batches:
            keys, columns, more = [], [], {"cm": [], "cd": [], "at": []}
            for key, text, asked in zip(batch.column("key").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("asked").to_pylist()):
                for x in asked:
                    columns.append(parts(text, x["s"], x["n"], x["o"], width, length))
                    size = len(columns[-1][0])
                    keys += [key] * size
                    more["cm"] += [x["cm"]] * size
                    more["cd"] += [x["cd"]] * size
                    more["at"] += (columns[-1][2] - x["s"] + x["at"]).tolist()
            if columns:
                yield _stretch_rows(pa.array(keys, pa.binary()), (np.concatenate(c) for c in zip(*columns)), cm=pa.array(more["cm"], pa.int64()), cd=pa.array(more["cd"], pa.int64()), at=pa.array(more["at"], pa.int32()))

    return run


def _comparer(length: int):
    """Over rows in the order of m: of each class, runs of strings that are met twice."""

    def run(batches):
        held, size, last = [], 0, None

        def flush():
            found = repeated([h[3:] for h in held], length) if len(held) > 1 else []
            rows = [(m, d, a, k) for (m, d, again, *_), runs in zip(held, found) if not again for a, k in runs]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["m", "d", "a", "k"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("m", "d", "again", "n", "o", "data"))):
                if size >= BATCH and row[0] != last:
                    yield from flush()
                    held, size = [], 0
                last = row[0]
                held.append(row)
                size += len(row[5])
        yield from flush()

    return run


def spans(docs: DataFrame, work: Workspace, length: int = LENGTH) -> DataFrame:
    """key (digest of a text's bytes), spans: array of (s, n), runs of strings that also stand elsewhere."""
    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text")).where(F.octet_length("text") >= length).select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"), "text")

    def with_text(some: DataFrame, name: str) -> DataFrame:
        asked = work.table(some.groupBy("key").agg(F.collect_list(F.struct(*[c for c in some.columns if c != "key"])).alias("asked")), name)
        sources = marked(texts, asked, "key").where("hit").groupBy("key").agg(F.first("text").alias("text"))
        return asked.hint("merge").join(sources, "key").select("key", "text", "asked")

    found, runs, made = texts.mapInArrow(_finder(length), STRETCH), [], []
    for step, width in enumerate((*WIDTHS, None)):
        found = work.table(found, f"stretches{step}")
        anchors = work.table(found.groupBy("m").agg(F.count("*").alias("times")).where("times > 1"), f"anchors{step}")
        again = work.table(found.join(anchors.hint("merge"), "m"), f"again{step}")
        work.drop(f"stretches{step}", f"anchors{step}")
        if step == 0:
            met = again
            again = again.withColumns({"cm": F.col("m"), "cd": F.col("d"), "at": F.lit(0)})
        one = F.struct("key", "s", "n", "o", "cm", "cd", "at")
        classes = work.table(again.groupBy("m", "d").agg(F.count("*").alias("c"), F.min(one).alias("first"), F.max(one).alias("last"), F.max("times").alias("times")), f"classes{step}")
        sent = classes.select("m", "d", "times", F.explode(F.when(F.col("c") > 1, F.array(F.struct(F.lit(False).alias("again"), "first.*"), F.struct(F.lit(True).alias("again"), "last.*"))).otherwise(F.array(F.struct(F.lit(False).alias("again"), "first.*")))).alias("x")).select("m", "d", "times", "x.*")
        made += [f"{name}{step}" for name in ("again", "classes", "crowded", "asked", "compared", "cut")]
        crowded = None
        if width:  # groups of single strings hold one class
            crowded = work.table(classes.where(F.col("times") > PER_TASK).groupBy("m").agg(F.sum(F.least("c", F.lit(2))).alias("rows")).where(F.col("rows") > PER_TASK).select("m"), f"crowded{step}")
            crowded = None if crowded.isEmpty() else crowded
        few = sent.join(crowded, "m", "left_anti") if crowded else sent
        sliced = with_text(few.select("key", "m", "d", "again", "s", "n", "o"), f"asked{step}").mapInArrow(_slicer(length), SLICED[0])
        compared = work.table(sliced.repartition("m").sortWithinPartitions("m").mapInArrow(_comparer(length), "m long, d long, a int, k int"), f"compared{step}")
        if step:
            compared = again.join(compared.hint("merge"), ["m", "d"]).select(F.col("cm").alias("m"), F.col("cd").alias("d"), (F.col("at") + F.col("a")).alias("a"), "k").distinct()
        runs.append(compared)
        if not crowded:
            break
        found = with_text(sent.join(crowded, "m", "left_semi").select("key", "s", "n", "o", "cm", "cd", "at"), f"cut{step}").mapInArrow(_cutter(width, length), PARTS)
    hits = met.join(reduce(DataFrame.unionByName, runs).hint("merge"), ["m", "d"]).select("key", (F.col("s") + F.col("a")).alias("s"), F.col("k").alias("n"))
    out = work.table(hits.distinct().groupBy("key").agg(F.collect_list(F.struct("s", "n")).alias("spans")), "spans")
    work.drop(*made)
    return out


def _words(text: bytes) -> np.ndarray:
    """Start and end of each word."""
    space = np.ones(len(text) + 2, bool)
    np.take(_SPACE, np.frombuffer(text, np.uint8), out=space[1:-1])
    return np.flatnonzero(space[1:] != space[:-1]).reshape(-1, 2)


def _passage_stretches(n_words: int):
    """Over texts: stretches of windows of ``n_words`` words with one anchor: key, hashes of anchor and content, start, bytes."""
    gram = gram_of(n_words)

    def run(batches):
        for batch in batches:
            texts, out = batch.column("text").cast(pa.binary()).to_pylist(), []
            for a, b in chunks(texts):
                data = b"\n".join(texts[a:b])
                words, opens = _words(data), np.cumsum([0, *(len(t) + 1 for t in texts[a : b - 1])])
                for at in range(0, len(words) - n_words + 1, WINDOWS):
                    starts, stops = words[at : at + WINDOWS + n_words - 1].T.copy()
                    doc, skipped = np.searchsorted(opens, starts, "right") - 1, starts[0]
                    hashes = Hashes(np.frombuffer(data, np.uint8)[skipped : stops[-1]])
                    grams = hashes.of(starts[: len(starts) - gram + 1] - skipped, stops[gram - 1 :] - skipped)
                    place = least_places(grams, n_words - gram + 1)
                    window = np.flatnonzero(doc[: len(place)] == doc[n_words - 1 :])
                    if not len(window):
                        continue
                    new = np.flatnonzero((np.diff(place[window], prepend=-1) != 0) | (np.diff(window, prepend=-2) != 1))
                    first, last = window[new], window[np.append(new[1:], len(window)) - 1]
                    anchor, begin, end = place[first], starts[first], stops[last + n_words - 1]
                    content = _mix(hashes.of(begin - skipped, end - skipped) ^ _mix((anchor - first).astype(np.uint64)))
                    out.append((doc[first] + a, grams[anchor].view(np.int64), content.view(np.int64), begin - opens[doc[first]], end - begin))
            if out:
                number, m, d, s, size = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_pydict({"key": batch.column("key").take(pa.array(number)), "m": m, "d": d, "s": s.astype(np.int32), "size": size.astype(np.int32)})

    return run


def _lists(column: pa.Array) -> tuple[list[tuple[int, int]], list[np.ndarray]]:
    """Of arrays of structs: each row's first and end in the fields of all."""
    ends = np.cumsum([x or 0 for x in pc.list_value_length(column).to_pylist()]).tolist()
    return list(zip([0, *ends], ends)), [field.to_numpy(zero_copy_only=False) for field in column.flatten().flatten()]


def _passage_windows(n_words: int):
    """Over texts with stretches asked for: the windows of these, with the md5 of their bytes."""
    md5 = hashlib.md5

    def run(batches):
        for batch in batches:
            bounds, (begins, sizes, ones) = _lists(batch.column("asked"))
            sums, out = [], []
            for k, (text, (a, b)) in enumerate(zip(batch.column("text").cast(pa.binary()).to_pylist(), bounds)):
                starts, stops = _words(text).T.copy()
                first = np.searchsorted(starts, begins[a:b])
                n = np.searchsorted(stops, begins[a:b] + sizes[a:b], "right") - n_words + 1 - first
                window = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                start, stop = starts[window], stops[window + n_words - 1]
                sums += [md5(text[x:y]).digest() for x, y in zip(start.tolist(), stop.tolist())]
                out.append((np.full(len(window), k), start.astype(np.int32), (stop - start).astype(np.int32), np.repeat(ones[a:b], n)))
            if out:
                number, s, size, one = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_pydict({"key": batch.column("key").take(pa.array(number)), "s": s, "size": size, "one": one, "sum": pa.array(sums, pa.binary())})

    return run


def passages(docs: DataFrame, work: Workspace, n_words: int = PASSAGE_WORDS) -> DataFrame:
    """key, passages: array of (s, size), strings of ``n_words`` words or more that also stand elsewhere, or windows of them.

    A string in stretches that are equal as a whole is met there; of other stretches that
    share an anchor one of each content gives its windows.  Only texts of these move.
    """
    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text")).select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"), "text")
    found = work.table(texts.mapInArrow(_passage_stretches(n_words), "key binary, m long, d long, s int, size int"), "passage-stretches")
    anchors = work.table(found.groupBy("m").agg(F.count("*").alias("times")).where("times > 1").select("m"), "passage-anchors")
    again = work.table(marked(found, anchors, "m").where("hit").drop("hit"), "passage-again")
    work.drop("passage-stretches")
    classes = work.table(again.groupBy("m", "d").agg(F.count("*").alias("c"), F.min(F.struct("key", "s", "size")).alias("x")), "passage-classes")
    several = classes.groupBy("m").agg(F.count("*").alias("n")).where("n > 1").select("m")
    asked = classes.join(several.hint("merge"), "m", "left_semi").groupBy("x.key").agg(F.collect_list(F.struct("x.s", "x.size", (F.col("c") == 1).alias("one"))).alias("asked"))
    asked = work.table(asked, "passage-asked")
    sources = marked(texts, asked, "key").where("hit").groupBy("key").agg(F.first("text").alias("text"))
    windows = work.table(asked.hint("merge").join(sources, "key").select("key", "text", "asked").mapInArrow(_passage_windows(n_words), "key binary, s int, size int, one boolean, sum binary"), "passage-windows")
    met = windows.groupBy("sum").agg(F.count("*").alias("times")).where("times > 1").select("sum")
    parts = windows.where("one").join(met.hint("merge"), "sum").select("key", "s", "size")
    whole = again.join(classes.where("c > 1").select("m", "d").hint("merge"), ["m", "d"], "left_semi").select("key", "s", "size")
    out = work.table(whole.unionByName(parts).distinct().groupBy("key").agg(F.collect_list(F.struct("s", "size")).alias("passages")), "passages")
    work.drop(*[f"passage-{name}" for name in ("anchors", "again", "classes", "asked", "windows")])
    return out


def _short_windows(length: int, n_words: int):
    """Of each text the windows of so many words that take fewer bytes: key, s, size, and the md5 of their bytes."""

    def run(batches):
        for batch in batches:
            keys, starts, sizes, sums = [], [], [], []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                inside = ~_SPACE[np.frombuffer(text, np.uint8)]
                edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
                if len(edges) < n_words:
                    continue
                first, last = edges[: len(edges) - n_words + 1, 0], edges[n_words - 1 :, 1]
                for s, e in zip(*(x[last - first < length].tolist() for x in (first, last))):
                    keys.append(key)
                    starts.append(s)
                    sizes.append(e - s)
                    sums.append(hashlib.md5(text[s:e]).digest())
                if len(keys) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(sums, pa.binary())], names=["key", "s", "size", "sum"])
                    keys, starts, sizes, sums = [], [], [], []
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(sums, pa.binary())], names=["key", "s", "size", "sum"])

    return run


def short_spans(docs: DataFrame, work: Workspace, length: int, n_words: int) -> DataFrame:
    """key, short: array of (s, size), windows of ``n_words`` words in fewer than ``length`` bytes that also stand elsewhere.

    They are too short for ``spans`` and few, as they take words of few letters: each
    goes by the md5 of its bytes.
    """
    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text")).select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"), "text")
    found = work.table(texts.mapInArrow(_short_windows(length, n_words), "key binary, s int, size int, sum binary"), "short")
    met = work.table(found.groupBy("sum").agg(F.count("*").alias("times")).where("times > 1").select("sum"), "short-met")
    return found.join(met.hint("merge"), "sum").select("key", "s", "size").distinct().groupBy("key").agg(F.collect_list(F.struct("s", "size")).alias("short"))


def covered(n_bytes: int, *strings: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """True for each byte that a string covers, of starts and sizes."""
    edges = np.zeros(n_bytes + 1, np.int64)
    for starts, sizes in strings:
        if len(starts):
            edges += np.bincount(starts, minlength=n_bytes + 1) - np.bincount(starts + sizes, minlength=n_bytes + 1)
    return np.cumsum(edges[:-1]) > 0


def worded(text: bytes, cover: np.ndarray, least_words: int) -> np.ndarray:
    """The cover without runs of fewer than LENGTH bytes that hold, or touch, fewer words."""
    edges = np.flatnonzero(np.diff(cover.astype(np.int8), prepend=0, append=0))
    for a, b in edges.reshape(-1, 2).tolist():
        if b - a < LENGTH and len(text[a:b].split()) < least_words:
            cover[a:b] = False
    return cover


def _remover(length: int, least_words: int):
    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            (runs, (run_starts, strings)), (shorts, (short_starts, short_sizes)), (told, (told_starts, told_sizes)) = (_lists(batch.column(c)) for c in ("spans", "short", "passages"))
            kept, removed, n_spans, n_told = [], [], [], []
            for text, (a, b), (c, d), (e, f) in zip(texts, runs, shorts, told):
                cover = covered(len(text), (run_starts[a:b], strings[a:b] - 1 + length), (short_starts[c:d], short_sizes[c:d]))
                if least_words:
                    cover = worded(text, cover, least_words)
                kept.append(np.frombuffer(text, np.uint8)[~cover].tobytes() if b > a or d > c else text)
                removed.append(int(np.count_nonzero(cover)))
                n_spans.append(int(np.count_nonzero(cover[1:] & ~cover[:-1])) + int(cover[:1].sum()))
                n_told.append(int(np.count_nonzero(covered(len(text), (told_starts[e:f], told_sizes[e:f])))) if f > e else 0)
            yield pa.RecordBatch.from_pydict(
                {
                    "row": batch.column("row"),
                    "n_bytes": pa.array(map(len, texts), pa.int64()),
                    "n_removed": pa.array(removed, pa.int64()),
                    "n_spans": pa.array(n_spans, pa.int64()),
                    "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                    "kept": pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()),
                    "n_passage_bytes": pa.array(n_told, pa.int64()),
                }
            )

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, least_words: int = 0, passage_words: int = 0) -> DataFrame:
    """(row struct of the input's columns but text, n_bytes, n_removed, n_spans, kept_sha256, kept, n_passage_bytes).

    With ``least_words``, runs of fewer words stay, unless they have LENGTH bytes, as
    writing without spaces may, and runs of as many words go however short they are.  A
    word that a run cuts counts.  kept_sha256: digest of the bytes that are left; kept: the text they are, without
    characters that were cut in two.  n_passage_bytes: bytes of the text in strings of
    ``passage_words`` words, if given, that also stand elsewhere; these are not taken out
    for it.  Only texts with repeats move.
    """
    work = Workspace(docs.sparkSession, "repeats")
    found = spans(docs, work, length).withColumn("short", F.lit(None).cast("array<struct<s:int,size:int>>"))
    if least_words:
        few = short_spans(docs, work, length, least_words)
        found = work.table(found.drop("short").join(few, "key", "full_outer"), "all-spans")
    found = found.withColumn("passages", F.lit(None).cast("array<struct<s:int,size:int>>"))
    if passage_words:
        found = work.table(found.drop("passages").join(passages(docs, work, passage_words), "key", "full_outer"), "spans-and-passages")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("row"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("key"))
    rows = marked(rows, found, "key")
    clean = rows.where("NOT hit").select("row", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), F.col("text").alias("kept"), F.lit(0).cast("long").alias("n_passage_bytes"))
    hit = rows.where("hit").join(found.hint("merge"), "key", "left").select("row", "text", "spans", "short", "passages")
    kind = rows.schema["row"].dataType.simpleString()
    return clean.unionByName(hit.mapInArrow(_remover(length, least_words), f"row {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string, n_passage_bytes long"))


def without_repeats(docs: DataFrame, length: int = LENGTH, least_words: int = 0) -> DataFrame:
    """The documents with repeated strings taken out, with all their columns; those of which nothing but white space is left go."""
    left = remove_repeats(docs, length, least_words).where(r"kept RLIKE '[^\\x20\\x09-\\x0D]'")
    new = {"text": F.col("kept"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return left.select(*[new[c].alias(c) if new.get(c) is not None else F.col(f"row.{c}") for c in docs.columns])


def op8_suffix_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, passage_words=PASSAGE_WORDS).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("kept").alias("text"), "n_passage_bytes")
