import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuespark.llm import phrase_index, source_audit, vector_codes
from cuespark.llm.workspace import prepare

NAN, INF = float("nan"), float("inf")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def quantised(rows, parts, entries, rounds):
    """By hand, in Python integers: {position of the row: (code, error)}, books."""
    kept = [(k, r) for k, r in enumerate(rows) if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = -(-max((len(r[1]) for _, r in kept), default=0) // parts)
    whole = lambda x: math.floor(x * 256)
    vec = {k: [whole(x) for x in r[1]] + [0] * (width * parts - len(r[1])) for k, r in kept}
    order = sorted(vec, key=lambda k: (rows[k][0] is None, rows[k][0] or 0, [float(x) for x in rows[k][1]]))
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(vec[k], p) for k in order[:entries]] for p in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def near(v, p):
        return min((apart(cut(v, p), b), e) for e, b in enumerate(books[p]))

    for _ in range(rounds):
        held = {}
        for v in vec.values():
            for p in range(parts):
                held.setdefault((p, near(v, p)[1]), []).append(cut(v, p))
        books = [[[sum(c) // len(held[p, e]) for c in zip(*held[p, e])] if (p, e) in held else b for e, b in enumerate(books[p])] for p in range(parts)]
    coded = {k: [near(v, p) for p in range(parts)] for k, v in vec.items()}
    return {k: (bytes(e for _, e in c), sum(d for d, _ in c)) for k, c in coded.items()}, books


@pytest.mark.parametrize("kind", ["plain", "odd", "wide", "ties"])
def test_vector_codes_by_hand(spark, kind):
    prepare(spark)
    rng = random.Random(5)
    if kind == "plain":
        rows = [(i, [rng.gauss(0, 1) for _ in range(12)], i % 3) for i in range(90)]
    elif kind == "odd":
        rows = [(3, [0.5, -0.25, 1.0], 1), (3, [0.5, -0.25, 1.0], 1), (3, [0.25], None), (None, [1.0, 2.0, 3.0, 4.0, 5.0], None), (1, None, 1), (2, [NAN, 1.0], 1), (4, [None, 1.0], 1), (5, [INF], 2), (6, [-INF], 2), (7, [], 2), (8, [0.001, -0.001], None)]
    elif kind == "wide":
        rows = [(i, [rng.choice([-1, 1]) * 10 ** rng.uniform(0, 30) for _ in range(8)], 0) for i in range(40)] + [(99, [0.1] * 8, 1)]
    else:
        rows = [(i % 4, [float(i % 2)] * 8, None if i % 3 else 7) for i in range(50)]
    vectors = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, code string, slot int").repartition(3)
    table, books = vector_codes.compress(vectors, 4, 8, 2)
    want, want_books = quantised(rows, 4, 8, 2)
    assert books.tolist() == want_books
    top = vector_codes.LONGEST
    sums = Counter()
    for k, (_, e) in want.items():
        sums[rows[k][2]] += min(e, top)
    got = vector_codes.with_label_errors(table).collect()
    assert Counter((r.vec_id, r.label, bytes(r.code), r.error, r.label_error) for r in got) == Counter((rows[k][0], rows[k][2], c, min(e, top), min(sums[rows[k][2]], top)) for k, (c, e) in want.items())
    text = ",".join(str(x) for part in want_books for entry in part for x in entry)
    assert vector_codes.books_digest(books) == hashlib.sha256(text.encode()).hexdigest()
    if kind == "plain":
        near = [np.abs(np.array(vector_codes.decoded(bytes(r.code), books)) - np.array(rows[r.vec_id][1])).mean() for r in got]
        assert np.mean(near) < 0.8


def test_vector_codes_of_nothing(spark):
    prepare(spark)
    for rows in ([], [(1, None, 2), (2, [NAN], None)]):
        table, books = vector_codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
        assert vector_codes.with_label_errors(table).count() == 0 and books.size == 0


def said(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def near_places(words, phrase, slop, counts):
    """Starts by the rarest term, and the span, by hand."""
    rare = min(range(len(phrase)), key=lambda o: (counts[phrase[o]], o))
    out = set()
    for at, w in enumerate(words):
        start = at - rare
        if w != phrase[rare] or start < -slop:
            continue
        places = [[p for p in range(max(0, start + o - slop), start + o + slop + 1) if p < len(words) and words[p] == t] if o != rare else [at] for o, t in enumerate(phrase)]
        if all(places):
            out.add((start, min(map(min, places)), max(map(max, places))))
    return out


@pytest.fixture
def corpus(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "b", "the", "of", "Ünï", "中文", "x9", "Zed"])
    docs = [(i % 20, " ".join(word() for _ in range(rng.choice([0, 1, 3, 12, 60])))) for i in range(40)]
    docs += [(7, None), (None, "the of the of, a b"), (8, ""), (9, "?!"), (5, docs[5][1]), (50, "the " * 3000 + "Zed a b of")]
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 4, 11])))) for i in range(12)]
    items += [(3, "the of the"), (4, None), (None, "a b"), (5, "!"), (6, "the of the"), (11, "a b"), (13, "nowhere to be seen")]
    return docs, items


@pytest.mark.parametrize("small", [phrase_index.SMALL, 0])
def test_contamination_by_hand(spark, corpus, small, monkeypatch):
    monkeypatch.setattr(phrase_index, "SMALL", small)
    docs, items = corpus
    windows = set()
    for i, t in items:
        w = said(t)
        n = min(len(w), 3)
        windows |= {("" if i is None else str(i), tuple(w[k : k + n])) for k in range(len(w) - n + 1) if n}
    want = Counter()
    for i, t in docs:
        w = said(t)
        hit, named = set(), set()
        for item, phrase in windows:
            for k in range(len(w) - len(phrase) + 1):
                if tuple(w[k : k + len(phrase)]) == phrase:
                    hit |= set(range(k, k + len(phrase)))
                    named.add(item)
        want[i, len(w), len(hit), tuple(sorted(named))] += 1
    df = spark.createDataFrame([(*d, "r", 1) for d in docs], "doc_id long, text string, row string, term int").repartition(3)
    got = phrase_index.contamination(df, spark.createDataFrame([(*i, "w") for i in items], "item_id long, text string, words string"), 3)
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got.collect()) == want
    assert phrase_index.contamination(df.where("false"), got.select(F.col("doc_id").alias("item_id"), F.lit("a").alias("text"))).count() == 0
    none = phrase_index.contamination(df, spark.createDataFrame([], "item_id long, text string"))
    assert {(r.n_hit, tuple(r["items"])) for r in none.collect()} == {(0, ())}


def test_proximity_by_hand(spark, corpus):
    docs, items = corpus
    phrases = spark.createDataFrame([(str(i), said(t)) for i, t in items if said(t)], "item string, words array<string>")
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(docs)], "doc_id long, text string")
    index = phrase_index.Index(df, phrases)
    counts = Counter(w for _, t in docs for w in said(t))
    by_phrase = {r.phrase: tuple(r["words"]) for r in index.work.read("phrases").collect()}
    ids = {r.row: r.doc_id for r in index.rows.collect()}
    for slop in (0, 1, 2):
        got = Counter((by_phrase[r.phrase], ids[r.row], r.start, r.low, r.high) for r in index.matches(slop).collect())
        want = Counter((p, k, *m) for p in {tuple(said(t)) for _, t in items if said(t)} for k, (_, t) in enumerate(docs) for m in near_places(said(t), p, slop, counts))
        assert got == want, slop


def test_contamination_stays_in_the_jvm(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    plan = phrase_index.contamination(read("documents"), read("benchmark"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def audited(docs, least=3, top=200):
    groups, terms, inside = {}, {}, {}
    for lang, source, text in docs:
        g = lang or "", source or ""
        groups.setdefault(g, Counter())
        w = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))
        groups[g].update(w)
        terms.setdefault(g[0], Counter()).update(w)
        inside.setdefault(g[0], Counter()).update(set(w))
    kept = {lang: sorted(t for t, n in c.items() if n >= least) for lang, c in inside.items()}

    def share(counts, lang):
        total = sum(counts[t] for t in kept[lang]) + len(kept[lang])
        return {t: 1 + 10**9 * (counts[t] + 1) // total for t in kept[lang]}

    out = []
    for lang, source in groups:
        p, q0 = share(groups[lang, source], lang), share(terms[lang], lang)
        pairs = []
        for other in groups:
            if other[0] == lang and other[1] != source:
                q = share(groups[other], lang)
                pairs.append((-sum((p[t] - q[t]) ** 2 // q[t] for t in p), other[1].encode()))
        more = [(-((p[t] - q0[t]) ** 2 // q0[t]), t.encode()) for t in p if groups[lang, source][t] and p[t] > q0[t]]
        for part, rows in (("pair", sorted(pairs)), ("term", sorted(more)[:top])):
            out += [(lang, source, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(rows)]
    return Counter(out)


@pytest.mark.parametrize("held", [source_audit.HELD, 3])
def test_source_audit_by_hand(spark, held, monkeypatch):
    prepare(spark)
    monkeypatch.setattr(source_audit, "HELD", held)
    rng = random.Random(4)
    word = lambda s: rng.choice(["a", "b", "The", "the", "É", "é", "中文", "it's", "x-y", "w" + str(rng.randrange(30)), "s" + s])
    docs = [(rng.choice(["en", "de", None, ""]), s, " ".join(word(s) for _ in range(rng.choice([0, 2, 30])))) for s in rng.choices(["p", "q", "r", "é", "z"], k=60)]
    docs += [("fr", "only", "un deux"), ("fr", None, None), ("xx", "one", "a a a"), ("xx", "one", "a a a"), ("xx", "one", "a"), ("en", "empty", ""), ("en", "p", "the " * 4000)]
    df = spark.createDataFrame([(*d, 1, "v") for d in docs], "lang string, source string, text string, rank int, value string").repartition(3)
    df.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir', None) or prepared(spark)}/audit-in-{held}/documents.parquet")
    got = source_audit.op13_source_audit(spark, path.rsplit("/", 1)[0]).collect()
    assert Counter(tuple(r) for r in got) == audited(docs)
    audit = source_audit.Audit(df.where("false"))
    assert audit.pairs().count() == 0 and audit.terms().count() == 0
    assert {r.item for r in source_audit.ranked(source_audit.Audit(df).terms(2)).where("rank > 2").collect()} == set()


def prepared(spark):
    from cuespark.llm.workspace import shared_root

    return shared_root(spark)
