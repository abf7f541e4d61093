"""JSON documents, rule tables and settings: texts that may be absent, broken or of another shape."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuespark.dist import ship
from cuespark.functions.patterns import compiles
from cuespark.functions.text import trimmed

#: Fields that every rule must have.
RULE_FIELDS = ("name", "pattern", "problem", "suggestion")
RULES = "struct<version:int,patterns:array<struct<name:string,pattern:string,problem:string,suggestion:string>>>"


def documents(texts: DataFrame, schema: str, defaults: dict[str, object] | None = None) -> DataFrame:
    """texts (file, value) as file and the fields of ``schema``; a text that is absent or no such object has the defaults, as a field without value has its own."""
    rows = texts.select("file", F.from_json("value", schema).alias("x"))
    names = [f.name for f in rows.schema["x"].dataType.fields]
    value = lambda n: F.coalesce(F.col(f"x.{n}"), F.lit(defaults[n])) if n in (defaults or {}) else F.col(f"x.{n}")
    return rows.select("file", *[value(n).alias(n) for n in names])


def first_found(candidates: list[DataFrame], key: str, value: str) -> DataFrame:
    """key, value and which of the candidates (key, value), in order, is the first to have one; a candidate may lack any key."""
    ranked = None
    for k, some in enumerate(candidates):
        rows = some.where(F.col(value).isNotNull()).select(key, value, F.lit(k).alias("candidate"))
        ranked = rows if ranked is None else ranked.unionByName(rows)
    return ranked.groupBy(key).agg(F.min_by(value, "candidate").alias(value), F.min("candidate").alias("candidate"))


def item_count(text: Column) -> Column:
    """Items of a JSON array, or of all arrays of a JSON object; null for anything else."""
    bare = trimmed(text)
    lists = F.filter(F.map_values(F.from_json(bare, "map<string,string>")), lambda v: v.startswith("["))
    total = F.aggregate(lists, F.lit(0), lambda a, v: a + F.coalesce(F.json_array_length(v), F.lit(0)))
    return F.when(bare.startswith("["), F.json_array_length(bare)).when(bare.startswith("{"), total)


def model_ids(reply: Column) -> Column:
    """Names of models in a reply: those of ``data`` (ids, or texts), else those of ``models`` (names, ids, or texts)."""

    def listed(path: str, *fields: str) -> Column:
        one = lambda v: F.when(v.startswith("{"), F.coalesce(*[F.nullif(F.get_json_object(v, f"$.{f}"), F.lit("")) for f in fields])).otherwise(v)
        values = F.from_json(F.get_json_object(reply, f"$.{path}"), "array<string>")
        return F.filter(F.transform(values, one), lambda v: v.isNotNull())

    return F.coalesce(listed("data", "id"), listed("models", "name", "id"), F.array().cast("array<string>"))


def json_lines(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows as lines of JSON (line), for ``write.text``: its committer shows all of a report or nothing."""
    return rows.select(F.to_json(F.struct(*(columns or rows.columns))).alias("line"))


def rules(texts: DataFrame) -> DataFrame:
    """Rules (file, k, name, pattern, problem, suggestion) of rule tables (file, value): objects of version 1 with patterns."""
    rows = texts.select("file", F.from_json("value", RULES).alias("x")).where("x.version = 1").select("file", F.posexplode("x.patterns").alias("k", "r"))
    return rows.select("file", F.col("k").cast("long").alias("k"), *[trimmed(F.col(f"r.{c}")).alias(c) for c in RULE_FIELDS])


def table_errors(texts: DataFrame) -> DataFrame:
    """file, error of rule tables that are no object, of another version, or without patterns."""
    x = F.from_json("value", RULES)
    error = F.when(x.isNull() | ~trimmed(F.col("value")).startswith("{"), "not_an_object").when(F.coalesce(x["version"], F.lit(0)) != 1, "bad_version").when(F.coalesce(F.size(x["patterns"]), F.lit(0)) <= 0, "no_patterns")
    return texts.select("file", error.alias("error")).where("error IS NOT NULL")


def duplicate_names(rules: DataFrame) -> DataFrame:
    """file, name, times of names that several rules of a table have."""
    return rules.where("name <> ''").groupBy("file", "name").agg(F.count("*").alias("times")).where("times > 1")


def rule_errors(rules: DataFrame) -> DataFrame:
    """file, k, error of rules: fields that are blank, a name that an earlier rule has, a pattern that does not compile in the dialect that scans run."""
    ship(rules.sparkSession)

    @F.pandas_udf("boolean")
    def bad(patterns: pd.Series) -> pd.Series:
        return ~patterns.map(compiles).astype(bool)

    again = F.row_number().over(Window.partitionBy("file", "name").orderBy("k")) > 1
    tests = [(F.col(c) == "", f"missing:{c}") for c in RULE_FIELDS] + [((F.col("name") != "") & F.col("_again"), "duplicate_name"), (F.col("_bad"), "invalid_regex")]
    found = F.array_compact(F.array(*[F.when(test, code) for test, code in tests]))
    return rules.withColumn("_again", again).withColumn("_bad", bad("pattern")).select("file", "k", F.explode(found).alias("error"))


def glob_pattern(glob: str) -> str:
    """A shell glob (``*``, ``?``, ``[...]``) as a regular expression of a whole text."""
    out, k = "", 0
    while k < len(glob):
        c = glob[k]
        end = glob.find("]", k + 2) if c == "[" else -1
        if end > 0:
            body = glob[k + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out, k = out + "[" + ("^" + body[1:] if body[0] == "!" else body) + "]", end + 1
            continue
        out, k = out + {"*": ".*", "?": "."}.get(c, re.escape(c)), k + 1
    return f"(?s)^{out}$"


def in_globs(files: DataFrame, include: list[str] = (), exclude: list[str] = (), suffixes: tuple[str, ...] = ("srt", "vtt", "txt", "md")) -> DataFrame:
    """Files (path) of some endings whose path or name matches a glob of ``include`` (any, if there is none) and none of ``exclude``."""
    name = F.element_at(F.split("path", "/"), -1)
    met = lambda globs: F.coalesce(*[F.when(F.col("path").rlike(glob_pattern(g)) | name.rlike(glob_pattern(g)), True) for g in globs], F.lit(False))
    wanted = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin(*suffixes)
    return files.where(wanted & (met(include) if include else F.lit(True)) & ~(met(exclude) if exclude else F.lit(False)))


def relative(path: Column, root: str) -> Column:
    """A path below ``root`` without it; any other as it is."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, F.lit(len(base) + 1), F.length(path))).otherwise(path)
