"""Lines, blocks, reports and pages: texts other than cues.

A file is one row (file, value), as ``cue_files.read_texts`` gives it.
"""

from __future__ import annotations

import html
import json
import re
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuespark.dist import ship
from cuespark.functions.text import issue_class, keywords, trimmed
from cuespark.functions.timecode import blank, stable_id
from cuespark.sources.cue_files import parse_srt_files

#: Everything that ends a line.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def lines(texts: DataFrame) -> DataFrame:
    """file, line (from 1), content; an end of line at the end of the text opens no further line."""
    ended = F.regexp_replace(F.coalesce("value", F.lit("")), f"(?:{LINE_END})\\z", "")
    some = texts.where(F.coalesce("value", F.lit("")) != "")
    return some.select("file", F.posexplode(F.split(ended, LINE_END)).alias("k", "content")).select("file", (F.col("k") + 1).cast("long").alias("line"), "content")


def vtt_blocks(texts: DataFrame) -> DataFrame:
    """Blocks of a VTT text (file, line, idx, content): first line, number among cue blocks (null for others), text without headers and times."""
    w = Window.partitionBy("file").orderBy("line")
    marked = lines(texts).withColumn("empty", blank(F.col("content")))
    runs = marked.withColumn("run", F.sum(F.col("empty").cast("int")).over(w)).where(~F.col("empty"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("line", "content"))), lambda x: x["content"])
    blocks = runs.groupBy("file", "run").agg(F.min("line").alias("line"), rows.alias("rows"))
    blocks = blocks.withColumn("cue", F.exists("rows", lambda x: x.contains("-->")))
    text = F.when(F.col("cue"), F.filter("rows", lambda x: ~x.contains("-->") & (trimmed(x) != "WEBVTT"))).otherwise(F.col("rows"))
    return blocks.withColumn("idx", F.when(F.col("cue"), F.sum(F.col("cue").cast("long")).over(w))).select("file", "line", "idx", F.array_join(text, "\n").alias("content"))


def rule_texts(texts: DataFrame) -> DataFrame:
    """Texts to scan for rules (file, line, idx, content), by a file's ending: cues of SRT files, blocks of VTT files, lines of all others.

    An SRT file that cannot be parsed is scanned by lines.
    """
    suffix = F.lower(F.regexp_extract("file", r"\.([^./]+)$", 1))
    srt, vtt = texts.where(suffix == "srt"), texts.where(suffix == "vtt")
    cues = parse_srt_files(srt)
    good = cues.where("error IS NULL").select("file", F.lit(None).cast("long").alias("line"), "idx", "content")
    failed = cues.where("error IS NOT NULL").select("file")
    plain = texts.where(~suffix.isin("srt", "vtt")).select("file", "value").unionByName(srt.join(failed, "file", "left_semi").select("file", "value"))
    return good.unionByName(vtt_blocks(vtt)).unionByName(lines(plain).withColumn("idx", F.lit(None).cast("long")))


def review_items(reports: DataFrame) -> DataFrame:
    """Review items of QC reports (value: a JSON object of file names to arrays of issues).

    Values that are no arrays, issues without a whole number ``i`` and issues without
    problem and suggestion are left out; of equal items one is kept.
    """
    found = reports.select(F.explode(F.from_json("value", "map<string,string>")).alias("file", "list")).where(F.col("list").startswith("["))
    rows = found.select("file", F.explode(F.from_json("list", "array<string>")).alias("one")).select("file", F.from_json("one", "i string, problem string, suggest string").alias("x"))
    items = rows.select("file", F.expr("try_cast(x.i AS bigint)").alias("idx"), trimmed(F.col("x.problem")).alias("problem"), trimmed(F.col("x.suggest")).alias("suggest"))
    items = items.where(F.col("idx").isNotNull() & ((F.col("problem") != "") | (F.col("suggest") != ""))).distinct()
    return items.select(stable_id(F.col("file"), F.col("idx").cast("string"), F.col("problem"), F.col("suggest")).alias("issue_id"), "file", "idx", "problem", "suggest", issue_class(F.col("problem"), F.col("suggest")).alias("c")).select("issue_id", "file", "idx", "problem", "suggest", "c.category", "c.severity")


def sample_cues(cues: DataFrame, files: int = 6, each: int = 3) -> DataFrame:
    """The first cues of the first files by name, blank ones left out after counting (a sampling operator)."""
    names = cues.select("file").distinct().orderBy("file").limit(files)
    head = cues.join(F.broadcast(names), "file", "left_semi").withColumn("_k", F.row_number().over(Window.partitionBy("file").orderBy("pos")))
    return head.where((F.col("_k") <= each) & ~blank(F.col("content"))).drop("_k")


class _Head(HTMLParser):
    """Title, meta tags and the data in scripts of JSON-LD; meta tags are decoded ``once`` or, as their attributes are already, twice."""

    def __init__(self, once: bool):
        super().__init__()
        self.once = once
        self.title, self.meta, self.data, self.within = [], {}, [], None

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "meta" and (name := a.get("property") or a.get("name")) and a.get("content"):
            self.meta[name.lower()] = (a["content"] if self.once else html.unescape(a["content"])).strip()
        elif tag == "title":
            self.within = self.title
        elif tag == "script":
            self.within = self.data if a.get("type", "").lower() == "application/ld+json" else None

    def handle_endtag(self, tag):
        if tag in ("title", "script"):
            self.within = None

    def handle_data(self, data):
        if self.within is not None:
            self.within.append(data)


def _tidy(value) -> str:
    return " ".join(html.unescape(str(value or "")).split())


def _objects(value):
    """Objects of a JSON-LD value, those of a graph before the object that has it."""
    if isinstance(value, list):
        for v in value:
            yield from _objects(v)
    elif isinstance(value, dict):
        if isinstance(value.get("@graph"), list):
            yield from _objects(value["@graph"])
        yield value


def _names(value) -> list[str]:
    """Names that a JSON-LD value stands for."""
    if isinstance(value, list):
        return [n for v in value for n in _names(v)]
    if isinstance(value, dict):
        value = next((value[k] for k in ("name", "alternateName", "label") if value.get(k)), None)
    return [name] if (name := _tidy(value)) else []


def _ended(text: str) -> str:
    """The text with ``&amp;`` for each & that begins no character reference ended by a semicolon."""
    return re.sub(r"&(#(?:[0-9]+|[xX][0-9a-fA-F]+);|[A-Za-z][A-Za-z0-9]*;)?", lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else "&amp;" + (m[1] or ""), text)


def _page(text: str | None, strict: bool) -> dict:
    head = _Head(strict)
    head.feed(_ended(text or "") if strict else text or "")
    title = " ".join(head.title)
    found = []
    for data in head.data:
        try:
            found += _objects(json.loads(data))
        except ValueError:
            continue
    stated = lambda *keys: next((n for o in found for k in keys if k in o for n in _names(o[k])[:1]), "")
    meta = lambda *keys: next((head.meta[k] for k in keys if head.meta.get(k)), "")
    words = [meta("keywords"), *(n for o in found for k in ("keywords", "genre") for n in _names(o.get(k)))]
    return {
        "title": stated("name", "headline") or meta("og:title") or (" ".join(title.split()) if strict else _tidy(title)),
        "description": stated("description") or meta("description", "og:description"),
        "image": stated("image", "thumbnailUrl") or meta("og:image"),
        "maker": stated("brand", "publisher", "author", "creator"),
        "published": stated("datePublished", "dateCreated"),
        "words": words,
    }


def _page_head(strict: bool):
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_page(t, strict) for t in texts], columns=["title", "description", "image", "maker", "published", "words"])

    return run


def page_metadata(pages: DataFrame, text: str = "html", strict: bool = False) -> DataFrame:
    """Adds title, description, image, maker, published and keywords of pages: JSON-LD first, then meta tags, then the title.

    Scripts that hold no JSON are passed over; a null page has empty fields.  Character
    references are decoded as browsers do, without a semicolon too, and once more in
    titles and meta tags, as many pages escape them twice; with ``strict`` once, and only
    those that end with a semicolon.
    """
    ship(pages.sparkSession)
    rows = pages.select("*", F.pandas_udf(_page_head(strict), "title string, description string, image string, maker string, published string, words array<string>")(F.col(text)).alias("_h"))
    found = F.array_distinct(F.flatten(F.transform("_h.words", keywords)))
    return rows.select(*[F.col(c) for c in pages.columns if c != text], *[F.col(f"_h.{c}") for c in ("title", "description", "image", "maker", "published")], found.alias("keywords"))
