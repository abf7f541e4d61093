"""Running values over the rows of a file of any length.

A window over a file puts all its rows into one task.  Here a file of more than MOST rows
is cut into ranges of its order, PIECES at most, at quantiles of its own values; a window
holds one range, each range is summed up in one row, and what the ranges before it came
to is carried into it.  Shorter files are one range.  Files are counted beforehand: where
none is longer, as is usual, nothing is cut or carried and the plan is a plain window.

Rows that are equal in the ranging column share a range.  Orders are total only as far
as the callers' columns make them so, as in any window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Rows of a file that one task takes, about; ranges of a longer one.
MOST, PIECES = 500_000, 256


def ranged(rows: DataFrame, by: str, file: str = "file", among: DataFrame | None = None) -> DataFrame:
    """Adds ``_range``, the place of the row's range in its file's order of ``by`` (a number), and ``_split``, whether the file has several.

    ``among`` holds all of the rows, and others, and is counted in their place where it costs less.
    """
    long = (rows if among is None else among).groupBy(file).agg(F.count("*").alias("_n")).where(F.col("_n") > MOST).select(file)
    if long.isEmpty():
        return rows.withColumns({"_range": F.lit(0), "_split": F.lit(False)})
    # At most a MOST-th of all rows are long files, with PIECES numbers each.
    marks = F.percentile_approx(by, [k / PIECES for k in range(1, PIECES)], 10_000)
    cuts = rows.join(long, file, "left_semi").groupBy(file).agg(F.array_sort(F.array_distinct(marks)).alias("_cuts"))
    told = rows.join(cuts, file, "left").withColumn("_split", F.col("_cuts").isNotNull())
    below = F.size(F.filter("_cuts", lambda c: c < F.col(by)))
    return told.withColumn("_range", F.when(F.col("_split") & F.col(by).isNotNull(), below).otherwise(0)).drop("_cuts")


def _here(order: list[str], file: str) -> WindowSpec:
    return Window.partitionBy(file, "_range").orderBy(*order)


def _carry(rows: DataFrame, summary: Column, over, name: str, file: str) -> DataFrame:
    """Adds ``name``: ``over`` (a column of summaries, a window of a file's ranges) of the ranges of the row's file."""
    sums = rows.where("_split").groupBy(F.col(file).alias("_f"), F.col("_range").alias("_r")).agg(summary.alias("_s"))
    told = sums.select("_f", "_r", over(F.col("_s"), Window.partitionBy("_f").orderBy("_r")).alias(name))
    return rows.join(told, F.col(file).eqNullSafe(F.col("_f")) & (F.col("_range") == F.col("_r")), "left").drop("_f", "_r")


def before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def with_previous(rows: DataFrame, order: list[str], value: Column, name: str, file: str = "file") -> DataFrame:
    """Adds ``value`` (a struct) of the row before in the file; null for the first.  Rows as ``ranged`` gives them."""
    last = F.max_by(value, F.struct(*order))
    out = _carry(rows, last, lambda s, w: F.lag(s).over(w), "_before", file)
    return out.withColumn(name, F.coalesce(F.lag(value).over(_here(order, file)), "_before")).drop("_before")


def with_next(rows: DataFrame, order: list[str], value: Column, name: str, file: str = "file") -> DataFrame:
    """Adds ``value`` (a struct) of the row after in the file; null for the last."""
    first = F.min_by(value, F.struct(*order))
    out = _carry(rows, first, lambda s, w: F.lead(s).over(w), "_after", file)
    return out.withColumn(name, F.coalesce(F.lead(value).over(_here(order, file)), "_after")).drop("_after")


def with_reached(rows: DataFrame, order: list[str], value: str, name: str, file: str = "file") -> DataFrame:
    """Adds the largest ``value`` of the rows before in the file; null for the first."""
    out = _carry(rows, F.max(value), lambda s, w: F.max(s).over(before(w)), "_before", file)
    return out.withColumn(name, F.greatest(F.max(value).over(before(_here(order, file))), "_before")).drop("_before")


def with_sums(rows: DataFrame, order: list[str], values: dict[str, Column], file: str = "file", ties: bool = False) -> DataFrame:
    """Adds sums of values up to the row, it included (with ``ties``, rows equal in order too)."""
    w = _here(order, file)
    w = w if ties else w.rowsBetween(Window.unboundedPreceding, 0)
    many = F.struct(*[F.sum(v).alias(n) for n, v in values.items()])
    so_far = lambda s, range_w: F.struct(*[F.coalesce(F.sum(s[n]).over(before(range_w)), F.lit(0)).alias(n) for n in values])
    out = _carry(rows, many, so_far, "_before", file)
    return out.withColumns({n: F.sum(v).over(w) + F.coalesce(F.col(f"_before.{n}"), F.lit(0)) for n, v in values.items()}).drop("_before")


def with_runs(rows: DataFrame, order: list[str], breaks: Column, name: str, file: str = "file") -> DataFrame:
    """Adds the number of the run that a row is in: one more at each break."""
    return with_sums(rows, order, {name: breaks.cast("long")}, file)


def _ranges(rows: DataFrame, file: str) -> DataFrame:
    return rows.groupBy(F.col(file).alias("_f"), F.col("_range").alias("_r")).agg(F.count("*").alias("_c"))


def value_of_rank(rows: DataFrame, value: str, rank, name: str, file: str = "file") -> DataFrame:
    """file, name: the value of a rank (a function of the number of a file's values, from 1) among a file's values in order.

    Ranges (of ``ranged`` by the value) are counted, and only the rows of the range that
    has the rank are sorted.
    """
    per = Window.partitionBy("_f")
    sized = _ranges(rows, file).withColumn("_k", rank(F.sum("_c").over(per))).withColumn("_under", F.coalesce(F.sum("_c").over(before(per.orderBy("_r"))), F.lit(0)))
    wanted = sized.withColumn("_need", F.col("_k") - F.col("_under")).where((F.col("_need") >= 1) & (F.col("_need") <= F.col("_c")))
    here = rows.select(file, "_range", F.col(value).alias(name)).join(wanted, F.col(file).eqNullSafe(F.col("_f")) & (F.col("_range") == F.col("_r")))
    return here.withColumn("_i", F.row_number().over(_here([name], file))).where("_i = _need").select(file, name)


def with_value_of_rank(rows: DataFrame, value: str, rank, name: str, file: str = "file") -> DataFrame:
    """Adds ``value_of_rank`` to all rows; a long file's rows are joined range by range."""
    rows = ranged(rows, value, file)
    found = value_of_rank(rows, value, rank, name, file).withColumnRenamed(file, "_g")
    told = _ranges(rows, file).join(found, F.col("_f").eqNullSafe(F.col("_g"))).select("_f", "_r", name)
    return rows.join(told, F.col(file).eqNullSafe(F.col("_f")) & (F.col("_range") == F.col("_r"))).drop("_f", "_r", "_range", "_split")
