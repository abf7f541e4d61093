"""Sinks: cue files in several kinds, and reports in Markdown."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuespark.functions.timecode import format_srt
from cuespark.sources.cue_files import parse_srt_files, read_texts, to_texts

KINDS = {"srt": ("srt",), "vtt": ("vtt",), "both": ("srt", "vtt")}


def _shared(spark: SparkSession, folder: str) -> str:
    """The folder as a URI of the session's file system; a folder of one machine is refused on a cluster."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if uri.startswith("file:"):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"executors do not share {folder}")
        uri = "file://" + uri.removeprefix("file:").replace("//", "/")
    return uri


def convert(spark: SparkSession, source: str, folder: str, kind: str = "vtt", recursive: bool = False, overwrite: bool = False) -> DataFrame:
    """SRT files under ``source`` written as files of another kind, as ``export`` does it; files that cannot be parsed have status parse_error."""
    parsed = parse_srt_files(read_texts(spark, source, "*.srt", recursive)).withColumn("file", F.regexp_extract("file", r"([^/]+)\.srt$", 1))
    failed = parsed.where("error IS NOT NULL").select("file", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("path"), F.col("error").alias("status"))
    return export(parsed.where("error IS NULL"), folder, kind, overwrite).unionByName(failed)


def export(cues: DataFrame, folder: str, kind: str = "vtt", overwrite: bool = False) -> DataFrame:
    """Write each file's cues to ``folder/<file>.<kind>`` and return file, kind, path, status (wrote, skipped_exists).

    ``file`` is a name without folders; ``folder`` is a path or URI that all executors
    see.  A file appears whole or not at all: it is written aside and renamed, so a
    task that is run again does no harm (it may then report skipped_exists).  The
    result must be read once for the files to be written.
    """
    folder = _shared(cues.sparkSession, folder)
    texts = None
    for k in KINDS[kind]:
        rows = to_texts(cues, k).withColumn("kind", F.lit(k))
        texts = rows if texts is None else texts.unionByName(rows)

    def write(batches):
        import uuid

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            out = []
            for file, value, k in zip(batch["file"], batch["value"], batch["kind"]):
                path = f"{root}/{file}.{k}"
                there = store.get_file_info(path).type != fs.FileType.NotFound
                if not there or overwrite:
                    aside = f"{root}/.{uuid.uuid4().hex}"
                    store.create_dir(root, recursive=True)
                    with store.open_output_stream(aside) as f:
                        f.write(value.encode("utf-8"))
                    store.move(aside, path)
                out.append((file, k, path, "skipped_exists" if there and not overwrite else "wrote"))
            yield pd.DataFrame(out, columns=["file", "kind", "path", "status"])

    return texts.select(F.col("file").cast("string").alias("file"), "value", "kind").mapInPandas(write, "file string, kind string, path string, status string")


def _md(value: Column) -> Column:
    return F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit("(missing)"))


def review_queue_markdown(items: DataFrame) -> DataFrame:
    """One section of a report for each item (issue_id, file, idx, category, severity, review_method, reason, source, current, suggest), in a row each: ord, section.

    Rows instead of one text, so that a report of any length is no single value;
    written in order of ``ord`` they are the report.
    """
    c = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    section = F.concat(
        F.lit("## "), c("issue_id"), F.lit(" / "), c("file"), F.lit(" #"), c("idx"), F.lit("\n\n- Category/severity: "), c("category"), F.lit(" / "), c("severity"),
        F.lit("\n- Required review: "), c("review_method"), F.lit("\n- Reason: "), c("reason"),
        *[p for head, name in (("Source", "source"), ("Current", "current"), ("Candidate", "suggest")) for p in (F.lit(f"\n\n**{head}**\n\n"), _md(F.col(name)))], F.lit("\n"),
    )
    return items.select(F.struct("file", "idx", "issue_id").alias("ord"), section.alias("section"))


def activity_markdown(found: DataFrame) -> DataFrame:
    """One section of a report for each candidate (file, start_s, end_s, confidence, side, avg_left_db, avg_right_db, gap_ratio, weak_ratio, reasons): ord, section.

    Candidates of a file are numbered in order of their start.  The head is ``activity_head``.
    """
    number = F.row_number().over(Window.partitionBy("file").orderBy("start_s", "end_s"))
    time = lambda c: format_srt(F.bround(F.col(c) * 1000).cast("long"), ".")
    told = lambda c: F.concat(F.lit("`"), F.col(c).cast("string"), F.lit("`"))
    lines = [
        F.concat(F.lit("## C"), F.lpad(F.col("_k").cast("string"), 3, "0"), F.lit(" "), time("start_s"), F.lit(" - "), time("end_s")), F.lit(""),
        F.concat(F.lit("- confidence: "), told("confidence"), F.lit(" (energy cannot tell whether this is speech)")), F.concat(F.lit("- side: "), told("side")),
        F.concat(F.lit("- left / right dB: "), told("avg_left_db"), F.lit(" / "), told("avg_right_db")), F.concat(F.lit("- gap ratio: "), told("gap_ratio")), F.concat(F.lit("- weak coverage ratio: "), told("weak_ratio")),
        F.concat(F.lit("- reasons: "), F.array_join("reasons", ", ")), F.lit("- decision: pending / prepare-recovery / ignore"), F.lit(""),
    ]
    return found.withColumn("_k", number).select(F.struct("file", F.col("_k").alias("k")).alias("ord"), F.concat_ws("\n", *lines).alias("section"))


def activity_head(found: DataFrame) -> DataFrame:
    """The head of each file's report of candidates: file, head."""
    return found.groupBy("file").agg(F.concat(F.lit("# Channel activity candidates\n\nStretches with energy and little recognised speech; effects can look so too.\n\n- candidates: `"), F.count("*").cast("string"), F.lit("`\n")).alias("head"))


def table_markdown(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows as lines of a Markdown table (line); bars inside values are escaped.  The head is ``table_head(*columns)``."""
    cells = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"([|\\])", r"\\$1") for c in columns]
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.regexp_replace(x, r"\n", " ") for x in cells]), F.lit(" |")).alias("line"))


def table_head(*columns: str) -> str:
    return "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns)
