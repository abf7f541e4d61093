"""Working tables in the folder that driver and executors share.

Operators cut lineage by writing a table and reading it back.  The folder is the
one the session names in ``spark.checkpoint.dir``; only where that is unset (a
local session, tests) is a temporary folder made and set.  Everything goes
through Spark's own readers, writers and Hadoop's file system, so the folder may
be in any store.

A result may read the tables of its run until its last row has been read.  ``collected``
removes the tables of all runs begun within it, also after a failure, and ``clear``
those of a session; a job calls one of them when its results are written.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuespark.dist import ship

SETTING = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """Folder that all executors see."""
    root = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SETTING} must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set(SETTING, root)
    return root.rstrip("/")


def prepare(spark: SparkSession) -> None:
    """The package on the executors, and Arrow batches of bounded bytes, as texts may be long."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


#: Bits of the table of ``marked`` for a key, at least; of the whole table, in bitmaps of 2**15 bits, at least and at most (128 MB).
BITS_PER_KEY, LEAST_BITS, MOST_BITS = 16, 1 << 18, 1 << 30


def table_bits(keys: int) -> int:
    """Bits for so many keys: a power of two."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << max(0, BITS_PER_KEY * keys - 1).bit_length()))


def marked(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Adds ``hit``: false only for rows whose key is surely not in ``keys``; true for all others, and by chance for a few more.

    Keys are counted first, and what is broadcast has BITS_PER_KEY to twice as many bits a key,
    so that at most one other row in BITS_PER_KEY passes, up to MOST_BITS; with more than
    67 million keys more rows pass, by and by.  Rows that are not hit need not move to be joined.
    """
    bits = table_bits(keys.count())
    place = F.pmod(F.xxhash64(column), F.lit(bits)) + 1
    maps = keys.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("_bits"))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(1) == 1, F.lit(False))
    return df.withColumn("_bucket", F.bitmap_bucket_number(place)).join(F.broadcast(maps), "_bucket", "left").withColumn("hit", hit).drop("_bucket", "_bits")


def without(docs: DataFrame, out: DataFrame, column: str) -> DataFrame:
    """Rows of ``docs`` whose ``column`` is not in ``out`` (null equals null), with all their columns; few rows move."""
    rows = docs.select(F.col(column).alias("id"), F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    known = marked(rows, out.select(F.col(column).alias("id")), "id")
    gone = out.select(F.col(column).alias("gone")).hint("merge")
    asked = known.where("hit").select("id", "row").join(gone, F.col("id").eqNullSafe(F.col("gone")), "left_anti")
    return known.where("NOT hit").select("row.*").unionByName(asked.select("row.*"))


#: Runs whose tables have not been removed; named stores are not among them.
_RUNS: list[Workspace] = []


class Workspace:
    """A folder of one run of an operator, or a named one that lasts; tables that are no longer read can be dropped."""

    def __init__(self, spark: SparkSession, name: str, store: str | None = None):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{store or f'{name}-{uuid.uuid4().hex[:12]}'}"
        if not store:
            _RUNS.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        """Write ``df`` and return the written table."""
        df.write.mode("overwrite").option("compression", compression).parquet(self.path(name))
        return self.read(name, df.schema)

    def read(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read
        return (reader.schema(schema) if schema is not None else reader).parquet(self.path(name))

    def _files(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def names(self, name: str) -> list[str]:
        """Folders in a folder, in order; none if there is no such folder."""
        files, path = self._files(self.path(name))
        return sorted(f.getPath().getName() for f in files.listStatus(path) if f.isDirectory() and "=" in f.getPath().getName()) if files.exists(path) else []

    def drop(self, *names: str) -> None:
        """Delete tables; only those that no returned DataFrame reads."""
        for name in names:
            files, path = self._files(self.path(name))
            files.delete(path, True)

    def remove(self) -> None:
        """Delete the whole folder."""
        files, path = self._files(self.root)
        files.delete(path, True)
        if self in _RUNS:
            _RUNS.remove(self)


def clear(spark: SparkSession) -> None:
    """Remove the tables of all runs of a session."""
    for run in [r for r in _RUNS if r.spark is spark]:
        run.remove()


@contextmanager
def collected():
    """Removes the tables of all runs begun within; what is to be kept has been written elsewhere by then."""
    before = list(_RUNS)
    try:
        yield
    finally:
        for run in [r for r in _RUNS if r not in before]:
            run.remove()
