"""Incremental processing: only what has not been done before (an extension: as a stream of files)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def pending(inputs: DataFrame, done: DataFrame, key: str = "signature") -> DataFrame:
    """Inputs whose signature has no completed output."""
    return inputs.join(done.where("status = 'ok'").select(key).distinct(), key, "left_anti")


def process_new_files(spark: SparkSession, path: str, schema: str, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Run ``work`` over the Parquet files that have come since the last call; each file is done once."""

    def batch(df: DataFrame, number: int) -> None:
        work(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    spark.readStream.schema(schema).parquet(path).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start().awaitTermination()
