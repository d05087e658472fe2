"""Scans along one unbroken order, over ranges instead of one task.

Rows are dealt into ranges of the order and written, so that a row's range
stays. A summary of each range (its first and last value, its number of rows)
is a row; carried along the ranges, it tells each of them what lies before and
after it, and windows within the ranges do the rest. The driver holds one row a
range, as many as there are shuffle partitions, whatever the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from loomstone.session import Scratch

RANGE = "_range"


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with the number of its range of ``order``, nulls first, written to the shared folder."""
    ranged = df.repartitionByRange(*[F.asc_nulls_first(c) for c in order]).withColumn(RANGE, F.spark_partition_id())
    return Scratch(df.sparkSession, "ordered").write(ranged, "rows")


def _within(order: list[str]) -> Window:
    return Window.partitionBy(RANGE).orderBy(*[F.asc_nulls_first(c) for c in order])


def _backward(order: list[str]) -> Window:
    return Window.partitionBy(RANGE).orderBy(*[F.desc_nulls_last(c) for c in order])


def nearest(df: DataFrame, order: list[str], value: str, before: str = "lo", after: str = "hi") -> DataFrame:
    """``df`` with the nearest non-null ``value`` of the rows before and after each row, itself left out.

    Rows that ``order`` doesn't tell apart are ordered by ``value``.
    """
    full = [*order, value]
    rows = _ranged(df, full)
    key = F.when(F.col(value).isNotNull(), F.struct(*full))
    ends = rows.groupBy(RANGE).agg(F.min_by(value, key).alias("first"), F.max_by(value, key).alias("last")).collect()
    ends.sort(key=lambda r: r[RANGE])
    carried, lo = [], None
    for r in ends:
        carried.append([r[RANGE], lo, None])
        lo = lo if r["last"] is None else r["last"]
    hi = None
    for r, c in zip(reversed(ends), reversed(carried), strict=True):
        c[2] = hi
        hi = hi if r["first"] is None else r["first"]
    kind = rows.schema[value].dataType
    schema = StructType([StructField(RANGE, IntegerType()), StructField("_lo", kind), StructField("_hi", kind)])
    carry = df.sparkSession.createDataFrame([tuple(c) for c in carried], schema)
    # What follows is what precedes in the opposite order: a frame that only grows takes each row once, one that shrinks is summed up anew for each row.
    earlier = lambda own: F.last(value, ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1))
    found = {before: F.coalesce(earlier(_within(full)), F.col("_lo")), after: F.coalesce(earlier(_backward(full)), F.col("_hi"))}
    # A row a range.
    return rows.join(F.broadcast(carry), RANGE).withColumns(found).select(*df.columns, before, after)


def previous(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with ``value`` of the row before each, null in the first row alone or where it is null there."""
    boxed = nearest(df.withColumn("_value", F.struct(value.alias("x"))), order, "_value", "_before", "_after")
    return boxed.select(*df.columns, F.col("_before.x").alias(name))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with the number of each row in ``order``, from 1 and without gaps."""
    rows = _ranged(df, order)
    at, starts = 0, []
    for r in sorted(rows.groupBy(RANGE).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r[RANGE]):
        starts.append((r[RANGE], at))
        at += r["n"]
    carry = df.sparkSession.createDataFrame(starts, StructType([StructField(RANGE, IntegerType()), StructField("_at", LongType())]))
    return rows.join(F.broadcast(carry), RANGE).select(*df.columns, (F.col("_at") + F.row_number().over(_within(order))).alias(name))
