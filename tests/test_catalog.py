import difflib
import re

import duckdb
import pytest

from cuespark import catalog
from cuespark.functions.text import DASHES, DIGITS, PUNCTUATION

TABLES = "benchmark conversations customer documents events labels lineitem orders pages part supplier".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_agrees_with_sql(spark, duck, sf_dir, name):
    query, sql = catalog.QUERIES[name]
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    ours = sorted(str(tuple(r[c] for c in cols)) for r in df.collect())
    result = duck.execute(sql)
    names = [x[0] for x in result.description]
    assert sorted(names) == cols
    theirs = sorted(str(tuple(row[names.index(c)] for c in cols)) for row in result.fetchall())
    assert ours == theirs


def test_entry(spark, sf_dir):
    assert catalog.entry(spark, sf_dir).count() > 0


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.oracle_sql())))
def test_runs_without_sql(spark, sf_dir, name):
    rows = catalog.QUERIES[name][0](spark, sf_dir).collect()
    assert rows and not any(v is None for r in rows for v in r)


def _form(text):
    text = re.sub(DIGITS, "", "".join((text or "").split()).replace("︙", "…"))
    return re.sub(PUNCTUATION, "", re.sub(DASHES, "ー", text))


def _alike(a, b):
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def _works(duck):
    works = {}
    for item, text in duck.execute("SELECT item_id, coalesce(text, '') FROM benchmark ORDER BY item_id").fetchall():
        works.setdefault(item // 10, []).append((item, text))
    return works


def test_runs_of_four_pages_by_brute_force(spark, duck, sf_dir):
    want = set()
    for work, items in _works(duck).items():
        pages = [_form(p) for _, t in items for p in re.split(r"(?<=[.!?])\s+", t) if p.strip() and not re.fullmatch(r"[\d\s]+|-\s*\d+\s*-", p.strip())]
        for item, text in items:
            best = (0.0, 1, 1)
            for k in range(len(pages)):
                for n in range(1, 5):
                    script = "".join(pages[k:k + n])
                    if k + n <= len(pages) and script and (r := _alike(_form(text), script)) > best[0]:
                        best = (r, k + 1, k + n)
            want.add((work, item, *best))
    found = catalog.matching.best_page_window(*catalog._pages(spark, sf_dir), most_pages=4)
    assert {(r.work, r.track, r.ratio, r.first_page, r.last_page) for r in found.collect()} == want


def test_page_windows_of_twelve_pages(spark, duck, sf_dir):
    want = {}
    for work, items in _works(duck).items():
        pages = [_form(p) for _, t in items for p in re.split(r"(?<=[.!?])\s+", t) if p.strip() and not re.fullmatch(r"[\d\s]+|-\s*\d+\s*-", p.strip())]
        for item, text in items:
            runs = [(-_alike(_form(text), "".join(pages[k:k + n])), k + 1, k + n) for k in range(len(pages)) for n in range(1, min(12, len(pages) - k) + 1)]
            want[item] = min((r for r in runs if r[0] < 0), default=(0.0, 1, 1))
    got = {r.track: (-r.ratio, r.first_page, r.last_page) for r in catalog.page_windows(spark, sf_dir).collect()}
    assert got == want and any(b - a >= 4 for _, a, b in got.values())


def test_unscripted_by_brute_force(spark, duck, sf_dir):
    scripts = {w: _form("\n".join(t for _, t in items)) for w, items in _works(duck).items()}
    want = set()
    for file, turn, text in duck.execute("SELECT conv_id, turn, text FROM conversations").fetchall():
        form, script = _form(text), scripts[file % len(scripts)]
        if len(form) >= 4 and form not in script:
            size = max(12, min(3 * len(form), 120))
            best = max(_alike(form, script[k:k + size]) for k in range(0, max(1, len(script) - size), max(1, size // 3)))
            if best < 0.45:
                want.add((file % len(scripts), file, turn + 1, round(best, 6)))
    got = {tuple(r) for r in catalog.unscripted_cues(spark, sf_dir).collect()}
    assert {x[:3] for x in got} == {x[:3] for x in want} and all(abs(a[3] - b[3]) < 2e-6 for a, b in zip(sorted(got), sorted(want)))
