import contextlib
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cuespark.llm import bpe, components, exact_dedup, html_extraction, jaccard_join, license_scan, license_texts, packing, quality_rules, registry, sharding, substring_dedup, suffix_groups, token_files, tokens, workspace
from cuespark.llm.workspace import Workspace, marked, prepare

LONG = "the word of a long line that goes on and on " * 400
ODD = [
    (1, "the cat and the dog", "x"), (2, None, "y"), (3, "", None), (4, "the cat and the dog", "x"), (4, "the cat and the dog", "x"), (None, "no id here", "z"),
    (5, LONG, "x"), (6, LONG + "tail", "x"), (7, "  \n\t ", "x"), (8, "Ünïcödé 中文 🙂 <|endoftext|> don't", "x"), (9, "Released under the MIT License.", "x"),
]
SCHEMA = "doc_id long, text string, source string, hit string, digest int, bucket int, key string, row int"


@pytest.fixture(scope="module")
def odd(spark):
    prepare(spark)
    return spark.createDataFrame([(*r, "h", 1, 2, "k", 3) for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def by_id(df, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


@pytest.mark.parametrize("apply", [
    quality_rules.judge, quality_rules.filtered, exact_dedup.deduplicate, exact_dedup.distinct_documents, lambda d: sharding.assign(d, F.lit(0), 3), license_scan.scan,
    bpe.digests, bpe.encoded, packing.packed, lambda d: token_files.read(token_files.write(d, Workspace(d.sparkSession, "t"))), substring_dedup.remove_repeats, substring_dedup.without_repeats, jaccard_join.classes, jaccard_join.one_of_each,
])
def test_empty_tables(none, apply):
    assert apply(none).count() == 0


def test_sql_agrees(spark, sf_dir):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    for name, sql in registry.oracle_sql().items():
        df = registry.queries()[name](spark, sf_dir)
        cols = sorted(df.columns)
        result = con.execute(sql)
        names = [x[0] for x in result.description]
        assert sorted(names) == cols, name
        assert sorted(str(tuple(r[names.index(c)] for c in cols)) for r in result.fetchall()) == sorted(str(tuple(r[c] for c in cols)) for r in df.collect()), name


def counts(text):
    words = [w for w in text.replace("\t", " ").replace("\n", " ").split(" ") if w]
    lines = [x for x in text.split("\n") if x.strip(" \t")]
    seen, cover = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            cover |= {i + k for i in places for k in range(8)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)


def test_quality_counts(spark, sf_dir, odd):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = by_id(quality_rules.judge(docs), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    for i, t in texts.items():
        want = counts(t)
        assert got[i][:5] == want
        assert got[i][5] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (got[i][5] and got[i][6])
    out = quality_rules.judge(odd)
    assert out.count() == len(ODD)
    assert by_id(out, "n_words", "base_failed")[2] == (0, True)
    assert quality_rules.filtered(odd).columns == odd.columns


def test_quality_em_by_hand(spark, sf_dir):
    """Expectation-maximisation over votes, document by document, against the query's posterior and verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rules = {name: quality_rules._rules()[name] for name in quality_rules.RULES}
    rows = quality_rules.features(docs).select("doc_id", F.array(*rules.values()).alias("v")).collect()
    votes = np.array([r.v for r in rows], np.float64)
    good, rg, rb = quality_rules.START_GOOD, np.full(votes.shape[1], quality_rules.START_RIGHT_GOOD), np.full(votes.shape[1], quality_rules.START_RIGHT_BAD)

    def posterior():
        g = np.log(good) + (np.log(rg) * (votes == 1) + np.log(1 - rg) * (votes == -1)).sum(1)
        b = np.log(1 - good) + (np.log(rb) * (votes == -1) + np.log(1 - rb) * (votes == 1)).sum(1)
        return 1 / (1 + np.exp(b - g))

    s, inside = quality_rules.SMOOTHING, lambda x: np.clip(x, 1e-4, 1 - 1e-4)
    for _ in range(quality_rules.EM_STEPS):
        q = posterior()
        told = votes != 0
        good, rg, rb = (
            inside((q.sum() + s * quality_rules.START_GOOD) / (len(q) + s)),
            inside((((votes == 1) * q[:, None]).sum(0) + s * quality_rules.START_RIGHT_GOOD) / ((told * q[:, None]).sum(0) + s)),
            inside((((votes == -1) * (1 - q)[:, None]).sum(0) + s * quality_rules.START_RIGHT_BAD) / ((told * (1 - q)[:, None]).sum(0) + s)),
        )
    got = by_id(quality_rules.judge(docs), "p_good", "base_failed", "kept")
    for r, p in zip(rows, posterior()):
        assert abs(got[r.doc_id][0] - p) < 1e-6
        assert got[r.doc_id][2] == (not got[r.doc_id][1] and got[r.doc_id][0] >= 0.5)


def test_quality_rules_find_junk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality_rules.judge(docs).where("NOT base_failed").join(labels, "doc_id").select("kept", "quality").collect()
    clean, junk = [r.kept for r in rows if r.quality], [r.kept for r in rows if not r.quality]
    assert np.mean(clean) > 0.98 and np.mean(junk) < 0.2


def test_exact_dedup(odd, spark):
    got = {(r.doc.doc_id, r.doc.text): (r.keep_id, r.group_size) for r in exact_dedup.deduplicate(odd).collect()}
    assert got[4, ODD[0][1]] == (1, 3) and got[2, None] == (2, 2) and got[3, ""] == (2, 2) and got[None, "no id here"] == (None, 1)
    assert exact_dedup.distinct_documents(odd).count() == len(ODD) - 3
    # digests that collide: the bytes decide
    docs = spark.createDataFrame([(i, f"t{i % 7}  x") for i in range(60)], "doc_id long, text string")
    weak = exact_dedup.deduplicate(docs, digest=lambda t: F.substring(F.sha2(t, 256), 1, 1), trigger_bytes=1)
    assert {(r.doc.doc_id, r.keep_id) for r in weak.collect()} == {(i, i % 7) for i in range(60)}


def test_exact_dedup_store(odd, spark):
    """A second batch is held against the first, also where digests collide."""
    import uuid

    store = "store-" + uuid.uuid4().hex
    one = spark.createDataFrame([(5, "a  b"), (6, "c"), (7, None)], "doc_id long, text string")
    two = spark.createDataFrame([(1, "a b"), (2, "d"), (3, "d "), (8, "d"), (4, "")], "doc_id long, text string")
    for digest in (exact_dedup.sha256, lambda t: F.lit("same")):
        ask = lambda docs: {(r.doc.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.deduplicate(docs, digest=digest, store=store + str(digest is exact_dedup.sha256)).collect()}  # noqa: B023, E731
        assert ask(one) == {(5, 5, 1, True), (6, 6, 1, True), (7, 7, 1, True)}
        assert ask(two) == {(1, 5, 2, False), (2, 2, 2, True), (3, 3, 1, True), (8, 2, 2, False), (4, 7, 2, False)}
        assert ask(one) == {(5, 5, 3, False), (6, 6, 2, False), (7, 7, 3, False)}


def test_stages_judge_rows_not_ids(spark):
    """Rows that share an id, or have none, are judged one by one."""
    long = "One of the finest words that anyone may use in a text of some length is this one, and it stands here alone. " * 3
    words = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, words), (2, words + " u"), (2, "a unique text that nothing else is like"), (None, words), (3, words), (3, words)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text[:3]) for r in jaccard_join.one_of_each(docs).collect()) == [(1, "w0 "), (2, "a u")]
    docs = spark.createDataFrame([(i, f"{long} {i} of those") for i in range(30)] + [(7, "## $$ %%"), (None, "### $$$"), (None, long)], "doc_id long, text string")
    kept = quality_rules.filtered(docs).collect()
    assert all("##" not in r.text for r in kept) and sum(r.doc_id == 7 for r in kept) == sum(r.doc_id == 8 for r in kept)


def test_runs_are_removed(spark):
    import os

    from cuespark.llm import workspace

    with pytest.raises(ValueError), workspace.collected():
        run = Workspace(spark, "gone")
        run.table(spark.range(3), "x")
        assert os.path.exists(run.root.removeprefix("file://"))
        raise ValueError
    assert not os.path.exists(run.root.removeprefix("file://"))


def test_sharding(odd, spark, tmp_path):
    rows = sharding.assign(odd, F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(3)), 4).collect()
    sizes = [sum(r.shard == k for r in rows) for k in range(4)]
    assert len(rows) == len(ODD) and max(sizes) - min(sizes) <= 1
    for k in range(4):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sizes[k]))
    # the flow against all assignments
    random.seed(5)
    for _ in range(20):
        blocks = [(o, c, n, n * 2**c) for o in range(3) for c in range(3) if (n := random.randint(0, 2))]
        total = sum(b[2] for b in blocks)
        moved = sum((hi - lo) * 2**c for o, c, lo, hi, j in sharding.plan(blocks, 2) if o != j)
        items = [(o, 2**c) for o, c, n, _ in blocks for _ in range(n)]
        best = min((sum(s for (o, s), j in zip(items, a) if o != j) for a in itertools.product((0, 1), repeat=total) if abs(2 * sum(a) - total) <= 1), default=0)
        assert moved == best
    # only the shards that change are rewritten
    target = str(tmp_path / "data")
    docs = spark.range(30).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"), F.when(F.col("id") < 18, 0).when(F.col("id") < 20, 1).otherwise(2).alias("shard"))
    docs.repartition(1).write.partitionBy("shard").parquet(target)
    before = {p.name for p in (tmp_path / "data" / "shard=2").iterdir()}
    plan = sharding.assign(docs, F.col("shard"), 3).cache()
    assert sharding.rewrite(target, plan, spark.read.parquet(target)) == [0, 1]
    assert {p.name for p in (tmp_path / "data" / "shard=2").iterdir()} == before
    assert [r[0] for r in spark.read.parquet(target).groupBy("shard").count().select("count").collect()] == [10, 10, 10]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.tokenizer_path())


def test_bpe(odd, library):
    random.seed(1)
    alphabet = [*"abcdefgXYZÄßİΣς 12'.,!?\t\n\x1c\x85\xa0é½²中文字カ한🙂́’€", "<|endoftext|>", "'s", "<|", "İ"]
    texts = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 60))) for _ in range(800)] + ["a" * 3000, "ab" * 700 + "\x00"]
    for words in (tokens.LibraryWords, bpe.RankArrayWords):
        encoder = tokens.Encoder(tokens.tokenizer_path(), words)
        for text, ids in zip(texts, encoder.encode(texts)):
            assert np.frombuffer(ids, "<u2").tolist() == library.encode(text, add_special_tokens=False).ids
    for row in bpe.encoded(odd).join(odd.select("doc_id", "text"), "doc_id").collect():
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        assert np.frombuffer(row.ids, "<u2").tolist() == ids and row.decoded == library.decode(ids, skip_special_tokens=False)


def test_token_files(odd, spark, library):
    files = token_files.write(odd, Workspace(spark, "t"), segment=3000)
    got = sorted(token_files.read(files).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in ODD), key=lambda i: -1 if i is None else i)
    at = 0
    texts = {r[0]: r[1] for r in ODD}
    for r in got:
        ids = np.array(library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [1], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    rng = np.random.default_rng(1)
    for n in (1, 2047, 2049, token_files.BLOCK + 3):
        ids = np.minimum(49407, rng.pareto(0.8, n) * 20).astype(np.int32)
        data = token_files.write_file([7], np.array([n]), ids)
        file = token_files.TokenFile(data)
        assert (file.ids() == ids).all()
        block = len(file.index) - 1
        k = file.index[block][1] - 1
        at = block * token_files.BLOCK + k * token_files.CHECKPOINT * token_files.LANES
        assert (file.stretch(block, k) == ids[at:]).all()
    broken = bytearray(data)
    broken[len(broken) // 2] ^= 1
    with pytest.raises(ValueError):
        token_files.TokenFile(bytes(broken)).ids()


def test_pieces_against_the_library(spark, sf_dir, odd, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(odd.where("doc_id > 4").select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    want = {}
    for r in docs.collect():
        ids = np.array(library.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        for k, a in enumerate(range(0, len(ids), packing.CAPACITY)):
            part = ids[a : a + packing.CAPACITY]
            want[r.doc_id, k] = (a, len(part), zlib.crc32(part.tobytes()))
    rows = packing.packed(docs).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)


def test_shards_of_the_table(spark, sf_dir):
    prepare(spark)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = sharding.op1_sharding(spark, sf_dir).collect()
    assert len(rows) == len(texts) and {r.law for r in rows} == {"rows"} and all(r.grown_shard is None for r in rows)
    assert all((r.size, r.text_crc32) == (len((t := (texts[r.doc_id] or "").encode())) + 1, zlib.crc32(t)) for r in rows)
    sizes = [sum(r.shard == k for r in rows) for k in range(8)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(r.slot for r in rows if r.shard == k) == list(range(n)) for k, n in enumerate(sizes))


def test_packing(odd):
    rows = packing.packed(odd).collect()
    assert len({r.doc_id for r in rows}) == len({r[0] for r in ODD})
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= packing.CAPACITY
    random.seed(3)
    for _ in range(200):
        room, counts = random.randint(1, 30), {x: random.randint(1, 3) for x in random.sample(range(1, 20), 5)}
        chosen = packing.fullest(counts, sorted(counts, reverse=True), room)
        best = max(s for s in (sum(a * x for a, x in zip(t, counts)) for t in itertools.product(*(range(n + 1) for n in counts.values()))) if s <= room)
        assert sum(x * n for x, n in chosen.items()) == best and all(n <= counts[x] for x, n in chosen.items())


@pytest.mark.parametrize("after", range(8))
def test_rewrite_that_is_cut_off(spark, tmp_path, monkeypatch, after):
    """Cut off after so many renames: every row is there, at its old or its new shard, and a later call completes what has begun."""
    target = str(tmp_path / "t")
    rows = [(i if i % 5 else None, f"text {i % 7} " * (i % 4 + 1), i % 3) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, shard int").write.partitionBy("shard").parquet(target)
    read = lambda: spark.read.schema("doc_id long, text string, shard int").parquet(target)
    moved = Workspace(spark, "m").table(sharding.assign(read(), F.col("shard"), 2), "moved")
    real, left = sharding._files, [after]

    class Failing:
        def __init__(self, files):
            self.files = files

        def __getattr__(self, name):
            if name == "rename":
                left[0] -= 1
                if left[0] < 0:
                    raise ConnectionError("lost")
            return getattr(self.files, name)

    monkeypatch.setattr(sharding, "_files", lambda *a: (Failing(real(*a)[0]), real(*a)[1]))
    cut = False
    try:
        sharding.rewrite(target, moved, read())
    except ConnectionError:
        cut = True
        with pytest.raises(ValueError, match="cut off"):
            monkeypatch.setattr(sharding, "_files", real)
            sharding.rewrite(target, moved, read())
        left[0] = 1
        monkeypatch.setattr(sharding, "_files", lambda *a: (Failing(real(*a)[0]), real(*a)[1]))
        with contextlib.suppress(ConnectionError):  # cut off again
            sharding.complete(spark, target)
    monkeypatch.setattr(sharding, "_files", real)
    sharding.complete(spark, target)
    assert sharding.complete(spark, target) == 0
    spark.catalog.refreshByPath(target)
    got = read().collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted((str(a), b) for a, b, _ in rows)
    shards = itertools.groupby(sorted(r.shard for r in got))
    assert {k: len(list(v)) for k, v in shards} == ({0: 20, 1: 20, 2: 20} if after == 0 else {0: 30, 1: 30})
    assert cut == (after < 6) and not [x for x in (tmp_path / "t").iterdir() if x.name.startswith("_rewrite")]


def test_filters_still_filter_many_keys(spark, monkeypatch):
    """Bits follow the keys: other rows pass one in BITS_PER_KEY at most; with fewer bits than keys nothing is lost."""
    rows = spark.range(60_000).withColumn("key", F.concat(F.lit("k"), F.col("id").cast("string")))
    keys = rows.where("id % 3 = 0").select("key")
    passed = lambda: {r.key for r in marked(rows, keys, "key").where("hit").collect()}
    monkeypatch.setattr(workspace, "LEAST_BITS", 1 << 10)
    hit = passed()
    assert hit >= {r.key for r in keys.collect()} and len(hit) - 20_000 <= 40_000 / workspace.BITS_PER_KEY
    assert workspace.table_bits(20_000) == 1 << 19 and workspace.table_bits(0) == 1 << 10 and workspace.table_bits(10**12) == workspace.MOST_BITS
    monkeypatch.setattr(workspace, "MOST_BITS", 1 << 15)
    assert passed() >= {r.key for r in keys.collect()}
    assert marked(rows, keys.where("false"), "key").where("hit").count() == 0


def test_hot_groups_do_not_move_by_digest(spark, odd, monkeypatch):
    """Groups above the bound are joined by broadcast, the others by digest; the rows are the same."""
    docs = spark.createDataFrame([(i, "hot text" if i % 3 == 0 else f"text {i % 40}") for i in range(300)], "doc_id long, text string")
    told = lambda d: sorted(str(tuple(r)) for r in exact_dedup.deduplicate(d).select("doc.doc_id", "keep_id", "group_size", "kept").collect())
    want = told(docs), told(odd)
    for rows in (0, 20):
        monkeypatch.setattr(exact_dedup, "HOT_ROWS", rows)
        monkeypatch.setattr(exact_dedup, "HOT_GROUPS", 1 << 40)
        assert (told(docs), told(odd)) == want


def test_rewrite_keeps_every_row(spark, tmp_path):
    prepare(spark)
    target = str(tmp_path / "data")
    rows = [(None if i % 3 == 0 else i // 4, None if i % 5 == 0 else f"t{i % 7}", i, i % 8) for i in range(90)]
    docs = spark.createDataFrame(rows + rows[:9], "doc_id long, text string, n int, shard int")
    docs.repartition(2).write.partitionBy("shard").parquet(target)
    moved = sharding.assign(spark.read.parquet(target), F.col("shard"), 4).cache()
    want = sorted(str((r.shard, r.doc_id, r.size, r.text_crc32)) for r in moved.collect())
    assert sharding.rewrite(target, moved, spark.read.parquet(target)) == list(range(8))
    after = spark.read.parquet(target)
    assert sorted(str((r.doc_id, r.text, r.n)) for r in after.collect()) == sorted(str(r[:3]) for r in rows + rows[:9])
    assert sorted(str((r.shard, r.doc_id, r.size, r.text_crc32)) for r in after.select("shard", "doc_id", *sharding._measures()).collect()) == want
    assert sorted(p.name for p in (tmp_path / "data").iterdir() if p.is_dir()) == [f"shard={k}" for k in range(4)]


def test_suffix_array():
    random.seed(2)
    for _ in range(600):
        s = [random.randint(0, random.choice([1, 2, 3, 8])) for _ in range(random.randint(0, 40))]
        assert suffix_groups.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_suffix_arrays_take_what_decides_the_order(monkeypatch):
    r, taken = random.Random(9), []
    monkeypatch.setattr(substring_dedup, "suffix_array", lambda x: taken.append(len(x)) or suffix_groups.suffix_array(x))
    for length, n, alphabet in ((400, 100, bytes(range(97, 123))), (400, 30, b"a"), (40, 9, b"ab"), (24, 10, b"\0a")):
        some = lambda k: bytes(r.choices(alphabet, k=k))
        rows = []
        for _ in range(60):
            o = r.randint(n, length - 10)
            rows += [(n, o, some(n - 1 + length))] * r.randint(1, 3)
            data = bytearray(rows[-1][2])
            data[r.choice((3, -3))] = 98  # shares some strings
            rows += [(n, o, bytes(data)), (n - 4, o - 4, rows[-1][2][4:])] * r.randint(0, 1)
        seen = {}
        for i, (k, o, data) in enumerate(rows):
            for a in range(k):
                seen.setdefault((o - a, data[a : a + length]), []).append((i, a))
        want = {x for places in seen.values() if len(places) > 1 for x in places}
        taken.clear()
        assert {(i, a + j) for i, runs in enumerate(substring_dedup.repeated(rows, length)) for a, k in runs for j in range(k)} == want
        assert alphabet != bytes(range(97, 123)) or sum(taken) < 20 * len(rows)  # whole stretches have 33


def test_texts_are_hashed_together(monkeypatch):
    r, made = random.Random(10), []
    texts = ["", "x" * 399, "x" * 400, *("".join(r.choices("ab ", k=k)) for k in (401, 900, 5000)), "ab " * 300] + ["".join(r.choices("abcdef ", k=700)) for _ in range(60)] * 2
    batch = lambda some: pa.RecordBatch.from_pydict({"key": [t.encode() for t in some], "text": some})
    rows = lambda run, batches: sorted(x for b in run(batches) for x in zip(*(c.to_pylist() for c in b.columns)))
    hashes = substring_dedup.Hashes
    monkeypatch.setattr(substring_dedup, "Hashes", lambda data: made.append(1) or hashes(data))
    for run in (substring_dedup._finder(400), substring_dedup._passage_stretches(51)):
        want = rows(run, [batch([t]) for t in texts])
        made.clear()
        assert rows(run, [batch(texts)]) == want
        assert len(made) < 5
        with monkeypatch.context() as m:
            m.setattr(substring_dedup, "CHUNK", 1000)
            assert rows(run, [batch(texts)]) == want


def brute_cover(texts, length):
    seen = {}
    for i, t in enumerate(texts):
        for s in range(len(t) - length + 1):
            seen.setdefault(t[s : s + length], []).append((i, s))
    out = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, s in places:
                out[i][s : s + length] = True
    return out


def test_passages_of_words_below_400_bytes_by_brute_force(spark):
    r = random.Random(51)
    word = lambda: "".join(r.choice("abcd") for _ in range(r.randint(1, 6)))
    some = lambda n: " ".join(word() for _ in range(n))
    planted, shorter, common = some(60), some(50), some(51)
    texts = [f"{some(20)} {planted} {some(30)}", f"{planted}\n{some(5)}", some(300), some(51), f"{shorter} x", f"y {shorter}", "", None, "ab " * 120, "\u00e9\u00e9 " * 70, " ".join(f"{some(9)} {common}" for _ in range(3))]
    texts += [f"{some(k)} {common}\t{some(3)}" for k in range(30)] + [some(80)] * 3
    places = {}
    for k, t in enumerate(texts):
        words = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())]
        for a, b in zip(words, words[50:]):
            places.setdefault((t or "").encode()[a[0]:b[1]], []).append((k, a[0], b[1]))
    met = [set() for _ in texts]
    for found in places.values():
        for k, a, b in found if len(found) > 1 else []:
            met[k].update(range(a, b))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for windows in (substring_dedup.WINDOWS, 7):
        substring_dedup.WINDOWS, before = windows, substring_dedup.WINDOWS
        try:
            got = {x.row.doc_id: x for x in substring_dedup.remove_repeats(docs, passage_words=51).collect()}
        finally:
            substring_dedup.WINDOWS = before
        assert [got[k].n_passage_bytes for k in range(len(texts))] == [len(m) for m in met]
        assert got[1].n_removed == 0 < got[1].n_passage_bytes == len(planted.encode()) < 400 and got[4].n_passage_bytes == 0


def test_substring_dedup(spark, sf_dir, odd):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(odd.where("doc_id IS NOT NULL").select((F.col("doc_id") + 10**6).alias("doc_id"), "text")).withColumn("n", F.monotonically_increasing_id())
    rows = docs.collect()
    texts = [(r.text or "").encode() for r in rows]
    for length in (substring_dedup.LENGTH, corpus_pipeline.REPEAT_BYTES, 40):
        got = {r.row.n: r for r in substring_dedup.remove_repeats(docs, length).collect()}
        for row, text, cover in zip(rows, texts, brute_cover(texts, length)):
            r = got[row.n]
            assert (r.n_bytes, r.n_removed) == (len(text), int(cover.sum()))
            assert r.n_spans == int((np.diff(cover.astype(int), prepend=0) == 1).sum())
            left = np.frombuffer(text, np.uint8)[~cover].tobytes()
            assert r.kept_sha256 == hashlib.sha256(left).hexdigest() and r.kept == left.decode("utf-8", "ignore")
    assert substring_dedup.without_repeats(odd).columns == odd.columns


def test_repeats_of_few_words_stay(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    words = lambda n: " ".join(word() for _ in range(n))
    few, many, unspaced = words(40), words(51), "".join(word() for _ in range(70))
    texts = [f"{words(30)} {x} {words(30)}" for x in (few, many, unspaced) for _ in range(2)] + [None, "", f"{words(9)} {many}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for least, gone in ((0, {few, many, unspaced}), (51, {many, unspaced})):
        left = {r.row.doc_id: r.kept for r in substring_dedup.remove_repeats(docs, 240, least).collect()}
        assert len(left) == len(texts)
        for i, text in enumerate(texts):
            held = [x for x in (few, many, unspaced) if text and x in text]
            assert all((x in left[i]) == (x not in gone) for x in held)
            assert held or left[i] == (text or "")


def test_frequent_anchors_are_dealt_in_parts(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    want = sorted(map(str, substring_dedup.remove_repeats(docs).collect()))
    monkeypatch.setattr(substring_dedup, "PER_TASK", 1)
    assert sorted(map(str, substring_dedup.remove_repeats(docs).collect())) == want


def test_places_beyond_24_bits():
    hashes = np.random.default_rng(1).integers(0, 1 << 64, (1 << 24) + 5000, dtype=np.uint64)
    assert (substring_dedup.least_places(hashes, 48)[1 << 24 :] == substring_dedup.least_places(hashes[1 << 24 :], 48) + (1 << 24)).all()


def test_an_anchor_of_over_16_mb_in_many_surroundings(spark):
    rng = np.random.default_rng(3)
    letters = lambda n: rng.integers(97, 123, n, dtype=np.uint8).tobytes().decode()
    data, gram = letters(1 << 20), substring_dedup.gram_of(substring_dedup.LENGTH)
    least = int(substring_dedup.Hashes(np.frombuffer(data.encode(), np.uint8)).every(gram).argmin())
    phrase, side, n = data[least : least + gram], substring_dedup.LENGTH - gram, 40_000
    rows = [(i, letters(side), letters(side)) for i in range(n)]
    for i in range(0, n, 8):  # a pair is like before the phrase, a pair in 20 bytes less before it and 20 after it
        rows[i + 1] = (i + 1, rows[i][1], rows[i + 1][2])
        rows[i + 3] = (i + 3, rows[i + 3][1][:20] + rows[i + 2][1][20:], rows[i + 2][2][:20] + rows[i + 3][2][20:])
    docs = spark.createDataFrame([(i, a + phrase + b) for i, a, b in rows], "doc_id long, text string").repartition(8)
    got = {r.row.doc_id: r.n_removed for r in substring_dedup.remove_repeats(docs).collect()}
    assert len(got) == n and all(v >= 400 if k % 8 < 4 else v == 0 for k, v in got.items())
    assert {v for k, v in got.items() if k % 8 < 4} <= set(range(400, 410))  # neighbours may agree by chance


def test_jaccard_join(spark, sf_dir, odd):
    out = by_id(jaccard_join.classes(odd), "class_id", "class_size", "n_links")
    assert out[4] == (1, 3, 2) and out[2] == (2, 1, 0) and out[7] == (7, 1, 0) and out[6][0] == 5
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    want = sorted(map(tuple, jaccard_join.classes(docs).collect()))
    assert sorted(map(tuple, jaccard_join.classes(docs, bucket=3).collect())) == want  # split to the last level
    assert jaccard_join.one_of_each(odd).columns == odd.columns


def test_jaccard_blocks(spark, monkeypatch):
    random.seed(4)
    base = [f"w{i}" for i in range(80)]
    docs = []
    for i in range(60):
        words = list(base)
        words[random.randrange(80)] = f"x{i}"
        docs.append((i, " ".join(words)))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted(map(tuple, jaccard_join.classes(docs).collect()))
    sets = {r.doc_id: set(jaccard_join.shingles(r.text.encode()).tolist()) for r in docs.collect()}
    for doc_id, _, _, links in want:
        assert links == sum(len(sets[doc_id] & s) >= 0.8 * len(sets[doc_id] | s) for j, s in sets.items() if j != doc_id)
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 7)
    assert sorted(map(tuple, jaccard_join.classes(docs).collect())) == want


def test_jaccard_crowds(spark):
    """Buckets beyond what a task may hold lose no link."""
    random.seed(6)
    base, other = [f"w{i}" for i in range(60)], [f"v{i}" for i in range(60)]
    docs = []
    for i in range(240):
        words = list(base if i % 8 else other)
        words[random.randrange(60)] = f"x{i}"
        docs.append((i, " ".join(words[: random.choice([60, 58, 60])] + (["tail"] if i % 5 == 0 else []))))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted(map(tuple, jaccard_join.classes(docs).collect()))
    sets = {r.doc_id: set(jaccard_join.shingles(r.text.encode()).tolist()) for r in docs.collect()}
    for doc_id, _, _, links in want:
        assert links == sum(len(sets[doc_id] & s) >= 0.8 * len(sets[doc_id] | s) for j, s in sets.items() if j != doc_id)
    assert sorted(map(tuple, jaccard_join.classes(docs, bucket=40).collect())) == want
    sketches = spark.createDataFrame([(1, i, 240, len(s), bytearray(jaccard_join.sketch(np.array(sorted(s), np.uint64)).tobytes())) for i, s in sets.items()], "bucket long, rid long, count long, size int, sketch binary")
    for most in (10, 40):
        work = Workspace(spark, "crowds")
        got = {(r.node, r.root) for r in components.components(jaccard_join._crowds(sketches, work, most), work, "got").collect()}
        rows = sketches.orderBy("rid").collect()
        pairs = jaccard_join.bucket_edges(np.array([r.rid for r in rows]), np.array([r.size for r in rows]), np.frombuffer(b"".join(bytes(r.sketch) for r in rows), np.uint8).reshape(-1, jaccard_join.SKETCH))
        assert got == {(r.node, r.root) for r in components.components(spark.createDataFrame(pairs, "a long, b long"), work, "whole").collect()}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 102), (101, 103), (7, 7)]
    got = {(r.node, r.root) for r in components.components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "c"), "x").collect()}
    assert got == {(i, 0) for i in range(41)} | {(i, 100) for i in range(100, 104)}


def test_license_templates():
    automaton = license_scan.TokenAutomaton({"a": "x <<var 1-2>> y <<opt>>z<</opt>> end", "b": "q r"})
    ask = lambda s: automaton.accepted(s.encode().split())
    assert ask("x 1 y end") == {"a"} and ask("so x 1 2 y z end q r") == {"a", "b"}
    assert ask("x y end") == set() and ask("x 1 2 3 y end") == set() and ask("x 1 y z z end") == set()
    either = license_scan.TokenAutomaton({"a": "x <<alt b c|d>> y", "b": "<<opt>><<alt p|q>><</opt>> z"})
    ask = lambda s: either.accepted(s.encode().split())
    assert ask("x b c y") == ask("x d y") == {"a"} and ask("x b y") == ask("x b d y") == ask("x y") == set() and ask("p z") == ask("z") == {"b"}


def test_license_texts(spark):
    """Templates by their own regular expressions, the prefilter included, on texts with and without their parts."""
    import re

    random.seed(8)
    fill = lambda items: " ".join(w for x in items for w in ([fill(random.choice(x))] if isinstance(x, license_scan.Either) else [] if isinstance(x, list) and random.random() < 0.5 else [fill(x)] if isinstance(x, list) else [f"n{k}" for k in range(random.randint(x[1], x[2]))] if isinstance(x, tuple) else [x.decode()]))
    texts = [(0, None), (1, "say hello big world now"), (2, "")]
    for label, template in license_scan.TEMPLATES.items():
        for cut in (False, True):
            words = fill(license_scan.parse(template)).split()
            if cut:
                del words[len(words) // 2]
            texts.append((len(texts), "Before, (c) 2020. " + " ".join(words).title().replace(" By ", " BY, ") + " - after"))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for templates in (license_scan.TEMPLATES, {"x": "hello big world"}, {"any": "<<var 1-2>>"}):
        got = by_id(license_scan.scan(docs, templates), "labels")
        for i, text in texts:
            words = " " + " ".join(re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) + " "
            base = {v for k, v in license_scan.BASE.items() if f" {k} " in words}
            own = {label for label, t in templates.items() if re.search(license_scan._pattern(license_scan.parse(t)) + " ", words)}
            assert got[i] == ",".join(sorted(base | own)), (i, text)


#: As their authors publish them.
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE {} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so"""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GPL = """This program is free software{} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
Foundation{} either version {} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
PARTICULAR PURPOSE.  See the GNU General Public License for more details."""
PUBLISHED = {
    "mit-notice": "This project is released under the terms of the MIT License.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of
        the License at http{}://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is
        distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
        permissions and limitations under the License.""",
    "gpl-2.0": "licensed under the GNU General Public License v2.0", "gpl-3.0": "Licensed under the terms of the GNU General Public License version 3.",
    "gpl-2.0-or-later-notice": _GPL.format(";", ";", 2), "gpl-3.0-or-later-notice": _GPL.format(":", ",", 3), "gpl-redistribution": _GPL.format(":", ",", 3),
    "mpl-2.0-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain
        one at http{}://mozilla.org/MPL/2.0/.""",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "licensed under the Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-nc-4.0": "licensed under CC BY-NC 4.0",
    "cc0-1.0": "released under the CC0 1.0 Universal (CC0 1.0) Public Domain Dedication",
    "mit-text": f"{_GRANT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS.format('AUTHORS OR COPYRIGHT HOLDERS')}",
    "mit-0-text": f"{_GRANT}. {_AS_IS.format('AUTHORS OR COPYRIGHT HOLDERS')}",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
        and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
        WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
        USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-2-clause-text": _BSD.format(""),
    "bsd-3-clause-text": _BSD.format("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software\n   without specific prior written permission.\n"),
    "zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of
        this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely,
        subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use
        this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked
        as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "unlicense-text": f"""This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software,
        either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the
        author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at
        large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to
        this software under copyright law. {_AS_IS.format("AUTHORS")}""",
    "bsl-1.0-text": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this
        license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit
        third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the
        above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the
        Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS
        PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE,
        TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN
        CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "apache-2.0-text": license_texts.APACHE_2_0, "gpl-2.0-text": license_texts.GPL_2_0, "gpl-3.0-text": license_texts.GPL_3_0, "mpl-2.0-text": license_texts.MPL_2_0,
}


@pytest.mark.parametrize("label", license_scan.TEMPLATES)
def test_templates_accept_published_texts(label):
    automaton = license_scan.TokenAutomaton(license_scan.TEMPLATES)
    text = PUBLISHED[label]
    for said in {text.replace("http{}", "http"), text.replace("http{}", "https")}:
        low = f"# Copyright (c) 2020\n{said}\n# more".lower().encode()
        assert label in automaton.accepted(license_scan.WORDS.findall(low)) and license_scan.needed(license_scan.TEMPLATES).search(low)


@pytest.mark.parametrize("label, text", [("apache-2.0-text", license_texts.APACHE_2_0), ("gpl-2.0-text", license_texts.GPL_2_0), ("gpl-3.0-text", license_texts.GPL_3_0), ("mpl-2.0-text", license_texts.MPL_2_0)])
def test_whole_license_texts(label, text):
    automaton = license_scan.TokenAutomaton(license_scan.TEMPLATES)
    accepts = lambda t: label in automaton.accepted(license_scan.WORDS.findall(t.lower().encode()))
    unmarked = re.sub(r"(?m)(?:(?<=\n\n)|\A)[ \t]*(?:(?:\d+\.)+\d*|\(?[a-z]\))(?=\s)", "", text)
    assert unmarked != text and all(map(accepts, (text, unmarked, f"Copyright us\n{text} more", " * ".join(text.split(" ")))))
    words = text.split()
    for k in (len(words) // 3, len(words) // 2):
        word = next(i for i in range(k, len(words)) if words[i].isalpha() and len(words[i]) > 3)
        assert not accepts(" ".join(words[:word] + words[word + 1 :])) and not accepts(" ".join([*words[:word], "other", *words[word:]]))
    assert not accepts(" ".join(words[:-3]))


def test_license_scan(odd):
    got = by_id(license_scan.scan(odd), "n_base", "first_word", "labels", "score")
    assert got[9] == (1, 3, "mit,mit-notice", 1.0) and got[2] == (0, None, "", 0.0)


def test_html(spark):
    pages = [
        (1, "u", "<html><body><nav><a href=x>Home now here</a></nav><article><h1>A &amp; B</h1><p>One <b>tw</b>o\n three.<p>Four words are here.<div class='ad'>Buy this</div><p>Last one.</article><section class=comments><p>nice post</section><footer>&copy; all of us</footer>"),
        (2, None, None), (3, "u", ""), (None, "u", "<p>a<script>var t='</p>x'</script> b</p>"), (3, "u", "text &lt;b&gt; only"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extraction.main_text(df).collect() if r.page_id != 3}
    assert got[1] == "A & B\nOne two three.\nFour words are here.\nLast one." and got[2] == "" and got[None] == "a b"
    assert html_extraction.main_text(df.where("false")).count() == 0


def test_pages_of_the_table(spark, sf_dir):
    import html
    import re

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r.text for r in html_extraction.main_text(pages).collect()}
    for r in pages.collect():
        body = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>|<br>", body))
        assert got[r.page_id] == "\n".join(p for p in parts if p)


def test_pages_without_the_label(spark):
    """Weights of labelled pages find the content of others whose label is hidden; without weights nothing is found."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").where("html IS NOT NULL")
    known = html_extraction.fit(pages.where("page_id % 2 = 0"))
    hidden = pages.where("page_id % 2 = 1")
    want = {r.page_id: r.text for r in html_extraction.main_text(hidden, known).collect()}
    plain = hidden.withColumn("html", F.regexp_replace("html", "(</?)article", "$1div"))
    got = {r.page_id: r.text for r in html_extraction.main_text(plain, known).collect()}
    assert np.mean([got[i] == t for i, t in want.items()]) > 0.95
    assert not any(r.text for r in html_extraction.main_text(hidden, {}).collect())


def test_names_alone_do_not_decide():
    count = html_extraction.Counter()
    html_extraction.count("<nav><a>Home</a></nav><article><h1>A title of it</h1><p>" + "many words of text " * 20 + "</p><p>more of these words</article><footer>Copyright us</footer>", count)
    known = html_extraction.weights(count)
    within = html_extraction.extract("<nav>Home</nav><article><h1>Title</h1><p>" + "some words " * 20 + "<div class='related-work'><p>What others have done before.</p></div></article><div class=ad>Buy</div>", known)
    assert within.startswith("Title\n") and within.endswith("What others have done before.")
    other = html_extraction.extract("<div>Home About Contact</div><div class='share-price-table'><p>" + "prices went up " * 9 + "</p></div><div>Copyright us all rights</div>", known)
    assert other == ("prices went up " * 9).strip()


FURNITURE = {
    "footer": "<footer><p>Copyright 2020 all rights reserved by the company and more.</p></footer>",
    "notice": '<div class="cookie-notice"><p>We use cookies to make this site work as you would expect it to.</p></div>',
    "advert": '<div class="ad"><p>Buy now while it lasts and save more than half of the price today.</p></div>',
    "form": '<form action="/go"><label>Mail</label><p>Subscribe to our newsletter to get all of the news every single day.</p></form>',
    "comments": '<div class="comments"><p>Nice post and I did like what you wrote about it here.</p></div>',
    "comment section": '<section id="comments"><div class="comment"><p>I have never read anything like this before in all my life.</p></div></section>',
    "nav": '<nav><p>All of the pages that you may want to see next are listed here.</p><ul><li><a href="/a">Home</a></li></ul></nav>',
    "related": '<aside class="related"><h3>Related</h3><p>Another story that you may also like to read when you are done.</p></aside>',
    "sidebar": '<div id="right-sidebar"><div><p>' + "Popular stories of the week that everyone has been reading. " * 30 + "</p></div></div>",
    "dialog": '<div role="dialog"><p>Please sign in with your account to read on and to save this page.</p></div>',
    "share": "<p><span class='share'>Share this with all of your friends and family right now please</span></p>",
    "unseen": '<div style="color:red; display: none"><p>This is for machines and no reader ever gets to see any of it.</p></div>',
}
CONTENT = {
    "list": ("<ul><li>A first thing that one has to know about it.</li><li>Second one</li></ul>", "A first thing that one has to know about it.\nSecond one"),
    "links": ('<p>One can read of this in <a href="/x">the long book about all of it</a> and elsewhere too.</p>', "One can read of this in the long book about all of it and elsewhere too."),
    "table": ("<table><tr><td>Some cell of words</td><td>and another cell</td></tr></table>", "Some cell of words\nand another cell"),
    "quote": ("<blockquote>It was said that nothing would ever be as it had been.</blockquote>", "It was said that nothing would ever be as it had been."),
    "heading": ("<h4>What came after</h4>", "What came after"),
}
BEFORE, AFTER = "It all began a long time ago, when few had heard of it and none had seen it yet.", "And so it went on for many years, until the day that nobody had been waiting for came."


@pytest.fixture(scope="module")
def known_weights(spark):
    prepare(spark)
    return html_extraction.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def placed(piece, where):
    paragraphs = [f"<p>{BEFORE}</p>", f"<p>{AFTER}</p>"] * 3
    if where == "inside":
        body = "<article><h1>A title</h1>" + "".join(paragraphs[:3]) + piece + "".join(paragraphs[3:]) + "</article>"
    elif where == "beside":
        body = piece + "<article><h1>A title</h1>" + "".join(paragraphs) + "</article>" + piece
    else:
        body = "<div><h1>A title</h1>" + "".join(paragraphs[:3]) + piece + "".join(paragraphs[3:]) + "</div>"
    return f"<html><head><title>t</title></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav>{body}<footer>All rights</footer></body></html>"


@pytest.mark.parametrize("where", ["inside", "beside", "without"])
def test_furniture_goes_and_content_stays(known_weights, where):
    """Paragraphs of furniture are no content, in the label, beside it, and where there is none; with weights of the table and without a fit."""
    lines = ["A title", *[BEFORE, AFTER] * 3]
    for weight in (known_weights, html_extraction.weights({})):
        for name, piece in FURNITURE.items():
            assert html_extraction.extract(placed(piece, where), weight) == "\n".join(lines), name
        for name, (piece, text) in CONTENT.items():
            want = lines if where == "beside" else [*lines[:4], text, *lines[4:]]
            assert html_extraction.extract(placed(piece, where), weight) == "\n".join(want), name


def test_headers_and_labels_that_hold_little(known_weights):
    title = "<header><h1>The title of all this</h1><p>By someone who knows all about it and more.</p></header>"
    body = "".join(f"<p>{BEFORE}</p>" for _ in range(5))
    assert html_extraction.extract(f"<body><header><p>The news site that you and all of your friends read.</p></header><article>{title}{body}</article>", known_weights) == "\n".join(["The title of all this", "By someone who knows all about it and more.", *[BEFORE] * 5])
    # a teaser in an article element beside the text does not make the text furniture
    assert html_extraction.extract(f"<body><div>{body}</div><aside><article><p>Read this too</p></article></aside>", known_weights) == "\n".join([BEFORE] * 5)


def test_html_of_any_shape(spark):
    odd_pages = [(1, "u", "<p>" + "long text of many words " * 20000 + "</p>"), (2, "u", "<" * 500 + "&" * 500), (3, "u", "</p></div><article>"), (3, "u", "</p></div><article>"), (None, None, None)]
    df = spark.createDataFrame([(*r, "h", 1) for r in odd_pages], "page_id long, url string, html string, text string, n_chars int")
    rows = html_extraction.main_text(df).collect()
    assert len(rows) == 5 and max(r.n_chars for r in rows) == len("long text of many words " * 20000) - 1


def squeezed(text):
    import re

    return re.sub(r"[\x20\t-\r]+", " ", text or "")


def shingle_set(text):
    words = [w for w in squeezed((text or "").translate({c: c + 32 for c in range(65, 91)})).split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def without_runs(text, cover, words):
    """The text without covered runs of so many words or 400 bytes."""
    out, at = b"", 0
    for hit, run in itertools.groupby(cover.tolist()):
        part = text[at : (at := at + len(list(run)))]
        if not hit or len(part) < 400 and len([w for w in re.split(rb"[\x20\x09-\x0D]+", part) if w]) < words:
            out += part
    return out.decode("utf-8", "ignore")


def test_passages_of_short_words(spark):
    """51 words are found in however few bytes they stand, also twice in one text; 50 are not, nor words with other white space between."""
    run = " ".join(random.Random(4).choice("abcdefghij") for _ in range(51))
    docs = [(1, f"first text {run} goes on"), (2, f"{run}\nanother"), (3, f"x {run[:-2]} q"), (4, run.replace(" ", "  ")), (5, f"{run} and then {run}"), (6, None), (7, ""), (8, "a")]
    df = spark.createDataFrame([(*d, "s") for d in docs], "doc_id long, text string, short string")
    got = {r.doc_id: r.text for r in substring_dedup.without_repeats(df, 240, 51).collect()}
    assert got == {1: "first text  goes on", 2: "\nanother", 3: docs[2][1], 4: docs[3][1], 5: " and then ", 8: "a"}
    assert {r.doc_id: r.text for r in substring_dedup.without_repeats(df.where("doc_id IN (1, 3)"), 240, 51).collect()} == {1: docs[0][1], 3: docs[2][1]}


def stage_by_brute_force(name, docs, kept_by_rules):
    """The texts that a stage should give for (doc_id, text) rows, as a sorted list."""
    least = lambda rows: min(rows, key=lambda r: (r[0] is None, r[0] or 0))
    if name == "quality_rules":
        return sorted(t for _, t in docs if kept_by_rules[t])
    if name == "exact_dedup":
        groups = {}
        for row in docs:
            groups.setdefault(squeezed(row[1]), []).append(row)
        return sorted(str(least(rows)[0]) for rows in groups.values())
    if name == "jaccard_join":
        sets, parent = [shingle_set(t) for _, t in docs], list(range(len(docs)))
        root = lambda i: i if parent[i] == i else root(parent[i])
        for i, j in itertools.combinations(range(len(docs)), 2):
            if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
        groups = {}
        for i, row in enumerate(docs):
            groups.setdefault(root(i), []).append(row)
        return sorted(str(least(rows)[0]) for rows in groups.values())
    texts = [(t or "").encode() for _, t in docs]
    cover, seen = brute_cover(texts, corpus_pipeline.REPEAT_BYTES), {}
    for k, t in enumerate(texts):  # and windows of as many words in fewer bytes
        words = list(re.finditer(rb"[^\x20\x09-\x0D]+", t))
        for a, b in zip(words, words[corpus_pipeline.REPEAT_WORDS - 1 :]):
            if b.end() - a.start() < corpus_pipeline.REPEAT_BYTES:
                seen.setdefault(t[a.start() : b.end()], []).append((k, a.start(), b.end()))
    for places in seen.values():
        for k, a, b in places if len(places) > 1 else ():
            cover[k][a:b] = True
    left = [without_runs(t, c, corpus_pipeline.REPEAT_WORDS) for t, c in zip(texts, cover)]
    return sorted(t for t in left if squeezed(t).strip(" "))


def test_pipeline(spark, sf_dir, odd, library):
    """Every stage against brute force on its own input, with null and repeated ids, and clashing names."""
    prepare(spark)
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = table.unionByName(table.where("doc_id % 17 = 0")).unionByName(table.where("doc_id % 19 = 0").withColumn("doc_id", F.lit(None).cast("long"))).unionByName(odd.select("doc_id", "text"), allowMissingColumns=True)
    docs = docs.withColumns({"hit": F.lit("h"), "row": F.lit(1), "bucket": F.lit(2), "kept": F.lit(True)})
    columns = docs.columns
    work = Workspace(spark, "p")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        judged = {r.text: r.kept for r in quality_rules._judged(docs.select("text"), "text", 0.5).collect()} if name == "quality_rules" else None
        docs = work.table(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        by_text = name in ("quality_rules", "suffix_dedup")
        assert sorted(r.text if by_text else str(r.doc_id) for r in docs.collect()) == stage_by_brute_force(name, before, judged), name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    lengths = sorted(len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    rows = last.collect()
    assert sum(r.length for r in rows) == sum(lengths) and len(rows) == sum(-(-n // packing.CAPACITY) for n in lengths)
    assert len({r.sequence_id for r in rows}) <= 1.1 * -(-sum(lengths) // packing.CAPACITY) + 1
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_pipeline_of_an_empty_table(none, spark, sf_dir):
    docs = none
    for name, stage in corpus_pipeline.STAGES:
        docs = Workspace(spark, "p").table(stage(spark, docs, sf_dir), name)
        assert docs.count() == 0
