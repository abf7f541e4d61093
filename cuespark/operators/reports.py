"""Reports over files, issues, models and runs."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuespark.dist import ship
from cuespark.functions.timecode import format_srt

# Statuses from the best to the worst; names and endings of files of work, and of files that may teach.
RANKS = ["OK", "WARN", "FAIL"]
WORK_NAMES = ["qc_report.json", "validate_report.json", "risk_report.json", "readability_report.json", "review_notes.md", "asr_vs_script_report.md"]
WORK_ENDINGS = [".ja.asr.srt", ".ja.asr.json", ".partial.json"]
TEACHING_WORDS, TEACHING_ENDINGS = ["reference", "learning", "lesson"], ["md", "txt", "json"]
#: Issues that do not fail a file.
WARNINGS = ("index_position_mismatch", "no_final_subtitles", "work_artifact_in_final_dir", "no_asr_files")


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def issues(*streams: DataFrame) -> DataFrame:
    """One table (file, pos, level, code) of issue streams (file, code, and pos if they have it)."""
    out = None
    for some in streams:
        pos = F.col("pos").cast("long") if "pos" in some.columns else F.lit(None).cast("long")
        rows = some.select(F.col("file").cast("string").alias("file"), pos.alias("pos"), F.when(F.col("code").isin(*WARNINGS), "warning").otherwise("error").alias("level"), "code")
        out = rows if out is None else out.unionByName(rows)
    return out


def by_file(found: DataFrame, files: DataFrame) -> DataFrame:
    """file, errors, warnings, status of all files, those without issues too."""
    n = lambda level: F.count_if(F.col("level") == level)
    told = found.groupBy("file").agg(n("error").alias("errors"), n("warning").alias("warnings"))
    rows = files.select(F.col("file").cast("string").alias("file")).distinct().join(told, "file", "left").na.fill(0, ["errors", "warnings"])
    return rows.withColumn("status", F.when(F.col("errors") > 0, "FAIL").when(F.col("warnings") > 0, "WARN").otherwise("OK"))


def worst(rows: DataFrame, *keys: str) -> DataFrame:
    """The worst status of each key; statuses that are not known rank below all."""
    rank = F.array_position(F.array(*map(F.lit, RANKS)), F.col("status"))
    return rows.groupBy(*keys).agg(F.max(F.struct(rank.alias("rank"), "status")).alias("m")).select(*keys, F.col("m.status").alias("status"))


def histogram(rows: DataFrame, column: str = "status") -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def file_counts(files: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """One row: how many files (path) have names like each pattern."""
    return files.agg(*[F.count_if(_name(F.col("path")).rlike(p)).alias(k) for k, p in patterns.items()])


def final_issues(files: DataFrame, allow_work: bool = False, folders: DataFrame | None = None) -> DataFrame:
    """file, code of final folders' files (directory, path): files of work among them, and folders without a final subtitle file.

    ``folders`` (directory) names those that must be there; one of which no file is listed is missing.
    """
    name = _name(F.col("path"))
    ending = lambda *ends: F.coalesce(*[F.when(name.endswith(e), True) for e in ends], F.lit(False))
    work = files.where(name.isin(*WORK_NAMES) | ending(*WORK_ENDINGS)).where(F.lit(not allow_work)).select(F.col("path").alias("file"), F.lit("work_artifact_in_final_dir").alias("code"))
    none = files.groupBy("directory").agg(F.max(ending(".zh.vtt", ".zh.srt")).alias("some")).where("NOT some")
    out = work.unionByName(none.select(F.col("directory").alias("file"), F.lit("no_final_subtitles").alias("code")))
    if folders is None:
        return out
    missing = folders.select("directory").distinct().join(files.select("directory"), "directory", "left_anti")
    return out.unionByName(missing.select(F.col("directory").alias("file"), F.lit("missing_final_dir").alias("code")))


def teaching_files(files: DataFrame) -> DataFrame:
    """Files (path) that may teach, by their names."""
    low = F.lower(_name(F.col("path")))
    word = F.coalesce(*[F.when(low.contains(w), True) for w in TEACHING_WORDS], F.lit(False))
    return files.where(word & F.regexp_extract(low, r"\.([^.]+)$", 1).isin(*TEACHING_ENDINGS))


def backup_names(wanted: DataFrame, there: DataFrame) -> DataFrame:
    """wanted (name) with ``backup``, its name in a folder that holds ``there`` (name): its own, or with the first ``.bakN`` before its ending that is free."""
    number = F.regexp_extract("name", r"^(.*)\.bak([1-9]\d*)((?:\.[^.]*)?)$", 2)
    own = F.regexp_replace("name", r"^(.*)\.bak[1-9]\d*((?:\.[^.]*)?)$", "$1$2")
    taken = there.select(own.alias("name"), F.coalesce(F.nullif(number, F.lit("")), F.lit("0")).try_cast("long").alias("n")).distinct()
    run = taken.withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy("n")) - 1 + F.min("n").over(Window.partitionBy("name")))
    used = run.where("n = k").groupBy("name").agg(F.min("n").alias("least"), F.count("*").alias("used"))  # numbers from 0 without a hole
    out = wanted.select("name").distinct().join(used, "name", "left")
    ending = F.regexp_extract("name", r"^.+?((?:\.[^.]*)?)$", 1)
    return out.select("name", F.when(F.col("least") == 0, F.concat(F.regexp_replace("name", r"^(.+?)(?:\.[^.]*)?$", "$1"), F.lit(".bak"), F.col("used").cast("string"), ending)).otherwise(F.col("name")).alias("backup"))


def next_round(names: DataFrame, *keys: str) -> DataFrame:
    """The next of folders (name) called ``round_`` and a number."""
    last = F.max(F.regexp_extract("name", r"^round_(\d+)$", 1).try_cast("long"))
    n = F.coalesce(last, F.lit(0)) + 1
    return names.groupBy(*keys).agg(F.concat(F.lit("round_"), F.when(n < 10, F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string"))).alias("name"))


def _grams(text: Column, size: Column) -> Column:
    """Distinct runs of so many characters of a text, or none."""
    n = F.length(text) - size + 1
    return F.when(n < 1, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n)), lambda i: F.substring(text, i, size))))


def containing(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """Distinct (needle, text) of needles (needle) and texts (text) that hold them; both of one kind (kind), none of them empty.

    An inverted index of the texts' runs of up to three characters: a needle is looked up
    by the rarest of its own, and what is found there is checked.
    """
    one = lambda c, size: F.explode(_grams(F.col(c), size)).alias("gram")
    held = texts.distinct().select("kind", "text", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("size")).select("kind", "text", one("text", F.col("size")))
    counts = held.groupBy("kind", "gram").agg(F.count("*").alias("n"))
    asked = needles.where("needle <> ''").distinct().select("kind", "needle", one("needle", F.least(F.lit(3), F.length("needle"))))
    rarest = asked.join(counts, ["kind", "gram"], "left").groupBy("kind", "needle").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    return rarest.join(held, ["kind", "gram"]).where(F.col("text").contains(F.col("needle"))).select("kind", "needle", "text").distinct()


# Points for a name that holds the other, holds it but for its dashes, and for each of its words.
_WHOLE, _PACKED, _WORD = 100, 80, 10


def similar_models(wanted: DataFrame, known: DataFrame, most: int = 5) -> DataFrame:
    """Of known model names (id) those most like each wanted one (model): model, id, score; at most ``most`` (the report's length)."""
    low, mid = F.lower("model"), F.lower("id")
    packed = lambda c: F.regexp_replace(c, "[-_]", "")
    words = F.filter(F.split(F.translate(low, "_", "-"), "-"), lambda w: F.length(w) >= 3)
    models, ids = wanted.select("model").where("model IS NOT NULL").distinct(), known.select("id").where("id IS NOT NULL")
    told = F.concat(F.array(F.struct(F.lit("name").alias("kind"), low.alias("needle")), F.struct(F.lit("packed").alias("kind"), packed(low).alias("needle"))), F.transform(words, lambda w: F.struct(F.lit("name").alias("kind"), w.alias("needle"))))
    asked = models.select("model", F.explode(told).alias("x")).select("model", "x.*")
    texts = ids.distinct().select("id", F.explode(F.array(F.struct(F.lit("name").alias("kind"), mid.alias("text")), F.struct(F.lit("packed").alias("kind"), packed(mid).alias("text")))).alias("x")).select("id", "x.*")
    found = containing(asked.select("kind", "needle"), texts.select("kind", "text"))
    pairs = asked.join(found, ["kind", "needle"]).join(texts, ["kind", "text"]).select("model", "id").distinct()
    met = F.filter(words, lambda w: mid.contains(w))
    score = F.when((low != "") & mid.contains(low), _WHOLE).otherwise(0) + F.when((packed(low) != "") & packed(mid).contains(packed(low)), _PACKED).otherwise(0) + _WORD * F.size(met)
    rank = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("score"), "id"))
    scored = pairs.join(ids, "id").withColumn("score", score).withColumn("rank", rank)
    return scored.where(F.col("rank") <= most).select("model", "id", F.col("score").cast("long").alias("score"), "rank")


def first_success(tried: DataFrame, *keys: str) -> DataFrame:
    """Of candidates (keys, candidate, priority, ok) the first that is ok; keys of which none is have a null candidate."""
    return tried.groupBy(*keys).agg(F.min_by("candidate", F.when(F.col("ok"), F.col("priority"))).alias("candidate"), F.count("*").alias("tried"))


def resolved_backend(hosts: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """hosts (host, platform, explicit, available array): the backend that is asked for, else the platform's if there, else the first there; null for none."""
    usual = F.coalesce(*[F.when(F.col("platform") == p, b) for p, b in defaults.items()], F.lit(None).cast("string"))
    there = F.when(F.array_contains("available", usual), usual)
    return hosts.select("host", F.coalesce(F.nullif(F.trim("explicit"), F.lit("")), there, F.get("available", F.lit(0))).alias("backend"))


def upsert_manifest(held: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """A manifest with the entries of ``new`` in place of those of their key; of several new ones the last by ``ord``."""
    columns = held.columns
    last = new.groupBy(key).agg(F.max(F.struct("ord", *[c for c in columns if c != key])).alias("m")).select(*[F.col(c) if c == key else F.col(f"m.{c}").alias(c) for c in columns])
    return held.join(last.select(key), key, "left_anti").select(*columns).unionByName(last)


def clip_manifest(windows: DataFrame, folder: str = "clips", ready: bool = False) -> DataFrame:
    """Windows (file, start_ms, end_ms, reason) numbered, with the paths of their clips of either channel."""
    number = F.row_number().over(Window.partitionBy("file").orderBy("start_ms", "end_ms", "reason"))
    told = lambda c: F.translate(format_srt(F.col(c), "."), ":.", "")
    stem = F.concat(F.col("file").cast("string"), F.lit("__w"), F.lpad(F.col("id").cast("string"), 3, "0"), F.lit("__"), told("start_ms"), F.lit("_"), told("end_ms"))
    rows = windows.withColumn("id", number.cast("long"))
    clip = lambda side: F.concat(F.lit(folder + "/"), stem, F.lit(f"__{side}.wav"))
    return rows.select("file", "id", format_srt(F.col("start_ms"), ".").alias("start"), format_srt(F.col("end_ms"), ".").alias("end"), (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), "reason", clip("left").alias("left_clip"), clip("right").alias("right_clip"), F.lit("clips_ready" if ready else "planned").alias("status"))


def record(settings: DataFrame, owner: str = "owner") -> DataFrame:
    """Settings (owner, setting, value) as one record of each owner: a map in the order of its names."""
    return settings.groupBy(owner).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("setting", "value")))).alias("record"))


def each_file(files: DataFrame, work: Callable[[str], str], workers: int = 8) -> DataFrame:
    """Run ``work`` for each file (file): file, status (ok, failed), message (what it returned, or its error) and seconds.

    ``workers`` tasks at a time at most, as each may hold a model; a failure is a row, not the end of the run.
    """
    ship(files.sparkSession)

    def run(batches):
        for batch in batches:
            rows = []
            for file in batch["file"]:
                began = time.time()
                try:
                    rows.append((file, "ok", str(work(file)), time.time() - began))
                except Exception as e:  # noqa: BLE001 - work may fail in any way
                    rows.append((file, "failed", f"{type(e).__name__}: {e}", time.time() - began))
            yield pd.DataFrame(rows, columns=["file", "status", "message", "seconds"])

    return files.select(F.col("file").cast("string").alias("file")).repartition(workers, "file").mapInPandas(run, "file string, status string, message string, seconds double")
