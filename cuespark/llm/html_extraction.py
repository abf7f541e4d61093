"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of words and tags.  Words score positive and tags negative,
with weights from labelled pages; the contiguous run with the largest sum, found in
one linear scan, is the content region.

A run of words has two kinds of evidence.  What its block says for it: the elements
that the block stands in and its own, words of their class and id names, whether it
is short or long, and whether most of its words are links; these sum up, to FULL at
most.  And what speaks against it: elements, roles and names of furniture around it, of
which the worst counts and the others do not, so that no amount of text makes a notice
or a reader's comment content.  On a page that labels its content, to stand outside of
the label is such evidence too.  A header is furniture where it belongs to the page,
not to an article or section.

Weights of all features are fitted by logistic regression on at most FIT_PAGES pages
whose markup labels their content (an ``article`` or ``main`` element), each taken twice:
as it is, and without the label, so that pages without one are judged by all else.  What
elements and names mean is where the fit begins and what it is drawn to: the harder, if
a feature was seen on one side only, as the pages then say nothing of the other.  As
pages do set adverts within an article, runs inside a label that such a name speaks
against count DOUBT as much as others.

A word scores what its run's evidence comes to, within bounds; a tag costs the more, the
less often it stands inside the content of labelled pages.  Inside the region, runs
whose evidence is not above nothing are left out; character references are decoded,
white space in a block becomes one space, and blocks are joined by a line feed.

Defined cases: null or empty html gives an empty text; unclosed or misnested markup
is read as browsers do in the main (a closing tag closes up to its opening tag, one
without is ignored); a page without content words gives an empty text; without a
labelled page the weights are where the fit would begin; repeated rows are extracted
one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages that the weights are fitted on, at most: the first in the order of a hash of their id.
FIT_PAGES = 400
#: Runs that where the fit begins counts for, and the share of its runs for a feature seen on one side only; its steps and its pace.
PRIOR, ONE_SIDED, STEPS, PACE = 1.0, 0.05, 400, 0.5
DOUBT = 0.1
#: A word's score at most and at least, and the evidence for the most, which is also the most that counts for a run; a tag's.
MOST, LEAST, FULL = 1.0, -0.25, 2.0
#: A run's, so that one long advert does not part an article.
RUN_LEAST = -5.0
#: A page's label holds if so much of what would be content without it stands in it.
LABEL_SHARE = 0.25
TAG_MOST, TAG_LEAST = -0.01, -0.25
#: A run is short below, long from so many words.
SHORT, LONG = 8, 20

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not page text.
RAW = frozenset("script style template noscript iframe textarea title svg math object select noembed noframes xmp".split())
LABELS = frozenset(["article", "main"])
#: Where the fit begins: elements, roles and names (a class or id of one word, or a longer one that says nothing else).
TEXT = frozenset("article main p h1 h2 h3 h4 h5 h6 blockquote pre".split())
PARTS = frozenset("li td th dt dd caption figcaption".split())
FURNITURE = frozenset("head nav footer aside form menu dialog button fieldset search".split())
#: A header within one of these is theirs, not the page's.
SECTIONS = frozenset("article main section blockquote figure td".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion promoted banner nav navbar navigation menu "
    "breadcrumb breadcrumbs header footer sidebar widget widgets related recommended share sharing social comment comments disqus replies respond cookie "
    "cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login search pagination pager "
    "copyright toolbar masthead".split()
)
#: Words that say nothing: a name of these and of one above means what that one does.
PLAIN = frozenset(
    "box bar block wrap wrapper container section list item items area widget site page top bottom left right upper lower inner outer text body content link links "
    "button buttons btn panel module primary secondary main post article entry row col column group holder unit slot zone message msg policy form thread reader "
    "user users inline fixed sticky footer the to on in of and for js id c l m s e".split()
)
#: Outside the label of a page that has one.
OUTSIDE = "~outside"
START = {
    **{t: 1.0 for t in TEXT}, **{t: 0.6 for t in PARTS}, **{t: -3.0 for t in FURNITURE}, "page-header": -3.0, **{"@" + r: -3.0 for r in ROLES}, OUTSIDE: -4.0,
    **{"." + n: -4.0 for n in NAMES}, **{"-" + n: -0.5 for n in NAMES}, "=div": -0.3, "#short": -0.5, "#long": 0.5, "#links": -2.0,
}
#: What speaks against a run; of it, the worst counts.
AGAINST = frozenset(f for f, w in START.items() if w < 0 and f[0] not in "#=-")
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_WORDS = re.compile(r"[a-z0-9]+")
_UNSEEN = re.compile(r"(?i)(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)")


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)} if raw.strip(" /\t\r\n") else {}


def _named(word: str) -> list[str]:
    """Features of a class or id name."""
    inner = [w for w in _NAME_WORDS.findall(word) if not w.isdigit()]
    if len(inner) == 1:
        return ["." + inner[0]]
    told = [w for w in inner if w in NAMES]
    sure = told and all(w in NAMES or w in PLAIN for w in inner) and told[0] not in ("header", "widget")
    return ["-" + w for w in inner] + (["." + told[0]] if sure else [])


class Element:
    __slots__ = ("name", "says", "against", "labelled", "sectioned", "hidden", "block", "link", "sums")

    def __init__(self, name: str, raw: str, parent: Element | None):
        attributes = _attributes(raw)
        own: set[str] = set()
        if name not in ("html", "body"):
            own.add("page-header" if name == "header" and not (parent and parent.sectioned) else name)
            for word in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
                own.update(_named(word))
            if role := attributes.get("role", "").lower():
                own.add("@" + role)
        against = own & AGAINST
        self.name = name
        self.says = (parent.says | (own - against) if own != against else parent.says) if parent else frozenset(own - against)
        self.against = (parent.against | against if against else parent.against) if parent else frozenset(against)
        self.labelled = name in LABELS or bool(parent and parent.labelled)
        self.sectioned = name in SECTIONS or bool(parent and parent.sectioned)
        self.hidden = "hidden" in attributes or bool(_UNSEEN.search(attributes.get("style", ""))) or bool(parent and parent.hidden)
        self.block = self if name in BLOCKS or not parent else parent.block
        self.link = name == "a" or bool(parent and parent.link)
        self.sums: dict = {}

    def told(self, kind: str) -> frozenset[str]:
        """What the block of this element says for a run."""
        return self.block.says | {kind, "=" + self.block.name}

    def sum(self, kind: str, outside: bool, weight: dict[str, float]) -> float:
        """The evidence of a run in this element, in a block of a kind."""
        if (kind, outside) not in self.sums:
            good = min(FULL, sum(weight.get(f, 0.0) for f in self.told(kind)))
            bad = min((weight.get(f, 0.0) for f in (self.against | {OUTSIDE} if outside else self.against)), default=0.0)
            self.sums[kind, outside] = -1.0 if self.hidden else good + min(0.0, bad)
        return self.sums[kind, outside]


def _kind(n: int, linked: int) -> str:
    """Of a block of n words, some of them in links."""
    return "#links" if 2 * linked > n else "#short" if n < SHORT else "#long" if n >= LONG else "#mid"


def tokens(html: str):
    """(element, text) for text, (element, None) for tags, in page order; element: what it stands in, or opens."""
    stack = [Element("html", "", None)]
    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.search(html, at)
        stop = m.start() if m else end
        if stop > at:
            yield stack[-1], html[at:stop]
        if not m:
            return
        at = m.end()
        closing, name, raw = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    yield stack[k], None
                    del stack[k:]
                    break
            continue
        if name in ("html", "body") and any(e.name == name for e in stack[1:]):
            continue
        if name in BLOCKS and stack[-1].name in ("p", "b", "i", "em", "strong", "span", "a", "u", "font"):  # a block ends an open paragraph
            k = len(stack)
            while k > 1 and stack[k - 1].name in ("b", "i", "em", "strong", "span", "a", "u", "font"):
                k -= 1
            if k > 1 and stack[k - 1].name == "p":
                del stack[k - 1 :]
        if name in ("li", "dt", "dd", "option", "tr", "td", "th") and stack[-1].name == name:
            stack.pop()
        element = Element(name, raw, stack[-1])
        yield element, None
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(html, at) if not raw.endswith("/") else None
            if close:
                at = close.end()
            elif name in ("script", "style", "textarea", "title", "xmp"):
                at = end
        elif name not in VOID:
            stack.append(element)


def blocks(html: str):
    """(items, kind) of each block: its (element, text or None for a tag, words) in page order; a tag that parts blocks ends the one before it."""
    items, words, linked = [], 0, 0
    for element, text in tokens(html):
        if text is None:
            items.append((element, None, 0))
            if element.name in BLOCKS:
                yield items, _kind(words, linked)
                items, words, linked = [], 0, 0
        else:
            n = len(text.split())
            items.append((element, text, n))
            if not element.hidden:
                words, linked = words + n, linked + (n if element.link else 0)
    yield items, _kind(words, linked)


def count(html: str, into: Counter) -> None:
    """Of a page that labels its content: (features for and against a run, or tag; inside) -> times."""
    for items, kind in blocks(html):
        for element, text, n in items:
            inside = element.labelled
            if text is None:
                into["<" + element.name, inside] += 1
            elif n and not element.hidden:
                told, bare = element.told(kind), element.told(kind) - LABELS
                against = "\x1f".join(sorted(element.against))
                into["\x1f".join(sorted(told)) + "\x1e" + ("" if inside else OUTSIDE + "\x1f") + against, inside] += 1
                into["\x1f".join(sorted(bare)) + "\x1e" + against, inside] += 1


def _table(rows: list[list[str]], place: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.full(len(r), i, np.int64) for i, r in enumerate(rows)]), np.array([place[f] for r in rows for f in r], np.int64)


def weights(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Weights of features and costs of tags ("<name")."""
    out = dict(START)
    for tag in {k[1:] for k, _ in counts if k[:1] == "<"}:
        inside, outside = counts.get(("<" + tag, True), 0), counts.get(("<" + tag, False), 0)
        out["<" + tag] = max(TAG_LEAST, min(TAG_MOST, math.log((inside + 0.1) / (outside + 0.1)) / 4))
    runs = sorted(([[f for f in side.split("\x1f") if f] for side in k.split("\x1e")], inside, n) for (k, inside), n in counts.items() if k[:1] != "<")
    if not runs:
        return out
    says, against = [r[0] for r, _, _ in runs], [r[1] for r, _, _ in runs]
    names = sorted({f for r in says + against for f in r})
    place = {f: i for i, f in enumerate(names)}
    sign = np.array([1.0 if inside else -1.0 for _, inside, _ in runs])
    times = np.array([n * (DOUBT if inside and bad else 1.0) for (_, bad), inside, n in runs])
    (row, column), (bad_row, bad_column) = _table(says, place), _table(against, place)
    start = np.array([START.get(f, 0.0) for f in names])
    seen = [np.bincount(np.concatenate([column, bad_column]), np.concatenate([(times * (sign == side))[row], (times * (sign == side))[bad_row]]), len(names)) for side in (1, -1)]
    prior = PRIOR + np.where(np.minimum(*seen) == 0, ONE_SIDED * (seen[0] + seen[1]), 0.0)
    weight, moved = start.copy(), np.full(len(names), 1e-9)
    for _ in range(STEPS):
        good, worst = np.bincount(row, weight[column], len(runs)), np.zeros(len(runs))
        np.minimum.at(worst, bad_row, weight[bad_column])
        pull = times * sign / (1 + np.exp(np.minimum(sign * (np.minimum(good, FULL) + worst), 50)))
        # Of what speaks against a run the worst is moved; what speaks for it only as far as it counts.
        of_worst = weight[bad_column] <= worst[bad_row]
        slope = np.bincount(column, np.where((good < FULL) | (sign < 0), pull, 0.0)[row], len(names)) + np.bincount(bad_column, np.where(of_worst, pull[bad_row], 0.0), len(names)) - prior * (weight - start)
        moved += slope**2
        weight += PACE * slope / np.sqrt(moved)
    return out | dict(zip(names, weight.tolist()))


def extract(html: str, weight: dict[str, float]) -> str:
    """Text of the content region."""
    page = list(blocks(html))
    content = [0, 0]
    for part, kind in page:
        for element, _, n in part:
            if n and element.sum(kind, False, weight) > 0:
                content[element.labelled] += n
    label = content[1] > LABEL_SHARE * sum(content)
    items, best, run, began, region = [], 0.0, 0.0, 0, (0, 0)
    for part, kind in page:
        for element, text, n in part:
            good = not n
            if text is None:
                score = weight.get("<" + element.name, TAG_LEAST / 5)
            else:
                told = element.sum(kind, label and not element.labelled, weight) if n else 0.0
                good = told > 0 or not n
                score = max(RUN_LEAST, n * max(LEAST, min(MOST, told * MOST / FULL)))
            items.append((element, text, good))
            run += score
            if run <= 0:
                run, began = 0.0, len(items)
            elif run > best:
                best, region = run, (began, len(items))
    out, parts = [], []

    def close():
        if block := " ".join(unescape("".join(parts)).split()):
            out.append(block)
        parts.clear()

    for element, text, good in items[slice(*region)]:
        if text is None:
            if element.name in BLOCKS:
                close()
            elif element.name == "br":
                parts.append(" ")
        elif good:
            parts.append(text)
    close()
    return "\n".join(out)


def fit(pages: DataFrame, most: int = FIT_PAGES) -> dict[str, float]:
    """Weights from at most ``most`` pages whose markup labels their content."""
    labelled = pages.where(F.col("html").rlike(r"(?i)<(article|main)[\s>]")).where("page_id IS NOT NULL")
    ids = [r[0] for r in labelled.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(most).collect()]
    if not ids:
        return weights({})

    def counted(batches):
        counts: Counter = Counter()
        for batch in batches:
            for html in batch.column("html").to_pylist():
                count(html, counts)
        if counts:
            yield pa.RecordBatch.from_pydict({"feature": [f for f, _ in counts], "inside": [i for _, i in counts], "n": list(counts.values())})

    rows = labelled.where(F.col("page_id").isin(ids)).select("html").mapInArrow(counted, "feature string, inside boolean, n long").groupBy("feature", "inside").agg(F.sum("n")).collect()
    return weights({(r[0], r[1]): r[2] for r in rows})


def main_text(pages: DataFrame, weight: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text, n_chars: a row for each row of ``pages`` (page_id, url, html)."""
    known = fit(pages) if weight is None else weight

    def run(batches):
        for batch in batches:
            texts = [extract(html, known) if html else "" for html in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id").cast(pa.int64()), "url": batch.column("url").cast(pa.string()), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_html_extraction(spark, sf_dir):
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
