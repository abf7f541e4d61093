"""Manifests and caches as Parquet tables by key, of which an upsert rewrites only what it touches.

A table is partitioned by a hash of its key.  An upsert reads the partitions of its new
keys, writes them aside with the new rows, and only then has Spark overwrite those
partitions and no other (dynamic overwrite).  A call that fails before that leaves the
table as it was; no other partition's files are ever written.

Defined cases: a table that is not there yet is made; an empty upsert changes nothing; of
several new rows of a key the greatest by ``ord`` counts; a null key is a key.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
BUCKET = "_bucket"


def _there(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def _bucketed(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    return rows.withColumn(BUCKET, F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int"))


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table's rows; none if it is not there.  ``schema``: that of its columns."""
    if not _there(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.parquet(path).drop(BUCKET)


def find(wanted: DataFrame, path: str, key: str, schema, buckets: int = BUCKETS) -> DataFrame:
    """``wanted`` (key and any columns) joined to the table's rows of its keys; only partitions that hold such keys are read."""
    spark = wanted.sparkSession
    if not _there(spark, path):
        return wanted.join(read(spark, path, schema), key)
    asked = _bucketed(wanted, key, buckets)
    held = spark.read.parquet(path)
    touched = [r[0] for r in asked.select(BUCKET).distinct().collect()]  # ``buckets`` at most
    return asked.join(held.where(F.col(BUCKET).isin(touched)), [BUCKET, key]).drop(BUCKET)


def upsert(path: str, new: DataFrame, key: str, order: str = "ord", keep_held: bool = False, buckets: int = BUCKETS) -> list[int]:
    """Put rows of ``new`` (the table's columns and ``order``) in place of those of their key, or, with ``keep_held``, only where there is none; returns the partitions that were rewritten."""
    spark = new.sparkSession
    columns = [c for c in new.columns if c != order]
    last = new.groupBy(key).agg(F.max(F.struct(order, *[c for c in columns if c != key])).alias("_m")).select(*[F.col(c) if c == key else F.col(f"_m.{c}").alias(c) for c in columns])
    last = _bucketed(last, key, buckets)
    touched = sorted(r[0] for r in last.select(BUCKET).distinct().collect())
    if not touched:
        return touched
    merged = last
    if _there(spark, path):
        held = spark.read.parquet(path).where(F.col(BUCKET).isin(touched)).select(*columns, BUCKET)
        same = lambda a, b: a.join(b.select(F.col(BUCKET).alias("_b"), F.col(key).alias("_k")), (F.col(BUCKET) == F.col("_b")) & F.col(key).eqNullSafe(F.col("_k")), "left_anti")
        merged = held.unionByName(same(last, held)) if keep_held else same(held, last).unionByName(last)
    aside = f"{path.rstrip('/')}_aside-{uuid.uuid4().hex[:12]}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(aside)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        merged.repartition(BUCKET).write.parquet(aside)
        spark.read.parquet(aside).repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    finally:
        files.delete(folder, True)
    spark.catalog.refreshByPath(path)
    return touched
