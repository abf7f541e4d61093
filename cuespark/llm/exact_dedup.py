"""Exact deduplication as a stateful stream.

Documents arrive through a log in the shared folder; a Structured Streaming query
reads it and keeps, for each digest, a state of constant size that never expires:
the digest, the stable identifier of the row that stays and where its content is
(its batch and row of the log), and how many rows have had that digest.  State is in
RocksDB, on disk, with its changes in the stream's checkpoint.  Counts and minima are
formed before the exchange, so that a text that a third of all rows hold reaches its
state as one row per task.

With a named ``store`` log, checkpoint and state last: rows of a later call are held
against all that came before.  What an earlier call has kept stays; within a call the
smallest doc_id does.  Without a name a call has a store of its own.

A digest that has been seen is a hit, not yet a copy: the full bytes of every hit
are compared with the content that the state's locator points to, in whichever batch
of the log that lies.  The comparison is dealt over several tasks for a large group.
If bytes differ behind one digest, the rows of that digest are grouped by their bytes
instead.

Defined cases: null text counts as empty; of rows with equal text the smallest
doc_id stays (null ids last; of repeated ids, the first in the log); all rows are
returned, repeated ones too; an empty table gives an empty result; other columns
are carried in a struct and cannot clash.  A call that failed has its rows in the log
and the next one counts them.  A store takes one call at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace, marked

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: State on disk, and no disk set aside beforehand for each of many small stores.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}
#: Rows of a group that are compared with its first row in one task.
HITS_PER_TASK = 512
#: Groups of more rows, and of more than a HOT_GROUPS-th of all rows, are hot: there are HOT_GROUPS of them at most.
HOT_ROWS, HOT_GROUPS = 10_000, 100_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


#: What stays of a digest's rows: the least of these.
FIRST = "struct<batch:int,no_id:boolean,id:long,row:long>"


def _first() -> Column:
    return F.min(F.struct("batch", F.col("id").isNull().alias("no_id"), "id", "row")).alias("first")


def _stream(work: Workspace, trigger_bytes: int) -> DataFrame:
    """Run the stream over what is new in the log; the state of each digest that it has updated."""
    spark = work.spark
    seen = (
        spark.readStream.schema("digest string, id long, row long, batch int")
        .option("maxBytesPerTrigger", trigger_bytes)
        .parquet(work.path("log"))
        .groupBy("digest")
        .agg(_first(), F.count("*").alias("n"))
    )
    out, known = work.path("updates"), set(work.names("updates"))

    def save(batch: DataFrame, number: int) -> None:  # again after a failure: the same folder
        batch.write.mode("overwrite").parquet(f"{out}/part={number}")

    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        query = seen.writeStream.outputMode("update").option("checkpointLocation", work.path("stream")).trigger(availableNow=True).foreachBatch(save).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    new = [f"{out}/{name}" for name in work.names("updates") if name not in known]
    return spark.read.schema(f"digest string, first {FIRST}, n long").parquet(*new)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, trigger_bytes: int = 16 << 30, store: str | None = None) -> DataFrame:
    """Rows (doc struct of the input's columns, digest, keep_id, group_size, kept).

    ``trigger_bytes`` bounds what one micro-batch takes from the log; ``store`` names a
    folder in the shared one that lasts from call to call.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "dedup", store)
    number = 1 + max((int(name.partition("=")[2]) for name in work.names("log")), default=-1)
    log = work.table(
        docs.select(
            digest(normalised(F.col(text_col))).alias("digest"),
            F.col(id_col).cast("long").alias("id"),
            F.monotonically_increasing_id().alias("row"),
            F.struct(*[F.col(c) for c in docs.columns]).alias("doc"),
        ),
        f"log/batch={number}",
    ).withColumn("batch", F.lit(number))
    if log.isEmpty():
        return log.select("doc", "digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    groups = work.table(_stream(work, trigger_bytes).groupBy("digest").agg(F.min("first").alias("first"), F.max("n").alias("n")), f"groups/batch={number}")

    # Texts move only where a digest has been met again, and not where a third of all rows may share it.
    text = normalised(F.col(f"doc.{text_col}"))
    salts = F.ceil(F.col("n") / HITS_PER_TASK).cast("int")
    known = marked(log, groups.where("n > 1"), "digest")
    hot = F.col("n") > max(HOT_ROWS, log.count() // HOT_GROUPS)
    met = known.where("hit").drop("hit").join(F.broadcast(groups.where(hot)), "digest", "left")
    found = met.where("n IS NOT NULL").unionByName(met.where("n IS NULL").drop("first", "n").join(groups.where(~hot).hint("merge"), "digest"))
    hits = found.where("n > 1").select("digest", "batch", "row", "first", text.alias("t"), F.pmod(F.xxhash64("row"), salts).cast("int").alias("salt"))
    # Locators are followed: only rows that one points to leave the log.
    whole = work.read("log", log.schema) if number else log
    named = [r[0] for r in groups.where("n > 1").select("first.batch").distinct().collect()]  # calls so far, at most
    places = groups.where("n > 1").select(F.struct("first.batch", "first.row").alias("place"), salts.alias("salts"))
    pointed = marked(whole.where(F.col("batch").isin(named)).select(F.struct("batch", "row").alias("place"), "digest", text.alias("held")), places, "place").where("hit").drop("hit")
    held = pointed.join(places.hint("merge"), "place").select("digest", "held", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    differ = hits.where("batch <> first.batch OR row <> first.row").join(held.hint("merge"), ["digest", "salt"]).where("t <> held").select("digest").distinct()
    differ = work.table(differ, f"differ/batch={number}")
    if not differ.isEmpty():
        apart = whole.join(differ, "digest").withColumn("t", text)
        byte_groups = apart.groupBy("digest", "t").agg(_first(), F.count("*").alias("n"))
        exact = apart.where(F.col("batch") == number).join(byte_groups, ["digest", "t"])
        columns = ["digest", "batch", "row", "doc", "first", "n"]
        found = found.join(differ, "digest", "left_anti").select(*columns).unionByName(exact.select(*columns))
    alone = known.where("NOT hit").select("doc", "digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    kept = (F.col("row") == F.col("first.row")) & (F.col("batch") == F.col("first.batch"))
    return alone.unionByName(found.select("doc", "digest", F.col("first.id").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept")))


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns."""
    return deduplicate(docs).where("kept").select("doc.*")


def op4_exact_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return deduplicate(docs).select("doc.doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


SQL = """
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""
