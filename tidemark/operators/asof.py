"""As-of and range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: Column, name: str) -> DataFrame:
    """Adds to each row of left the value of right's last row of the same keys at or before it; null where there is none.

    Both sides are put together and sorted once by key and time, right rows first on ties: one shuffle, no range join.
    """
    columns = left.columns
    marked = left.withColumn("_side", F.lit(1)).withColumn(name, F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType))
    other = right.select(*keys, F.col(at), F.lit(0).alias("_side"), value.alias(name))
    both = marked.unionByName(other, allowMissingColumns=True)
    back = Window.partitionBy(*keys).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("_last", F.last(name, ignorenulls=True).over(back)).where("_side = 1").drop(name, "_side").withColumnRenamed("_last", name).select(*columns, name)


def valid_positions(times: DataFrame, positions: DataFrame, keys: list[str], at: str, value: Column, name: str, until: str | None = None, since: str | None = None) -> DataFrame:
    """The as-of join for things that are there from ``since`` (or their first position) until before ``until``."""
    first = positions.groupBy(*keys).agg(F.min(at).alias("_first"))
    found = asof_join(times, positions, keys, at, value, name).join(first, keys)
    found = found.where(F.col(at) >= (F.greatest(F.col("_first"), F.coalesce(F.col(since), F.col("_first"))) if since else F.col("_first")))
    return (found.where(F.col(until).isNull() | (F.col(at) < F.col(until))) if until else found).where(F.col(name).isNotNull()).drop("_first")


def range_join(rows: DataFrame, ranges: DataFrame, keys: list[str], at: str, start: str, value: str) -> DataFrame:
    """Half-open ranges that begin at ``start`` and last to the next one: an as-of join by number."""
    return asof_join(rows, ranges.withColumnRenamed(start, at), keys, at, F.struct(F.col(value).alias("v")), "_in").withColumn(value, F.col("_in.v")).drop("_in")
