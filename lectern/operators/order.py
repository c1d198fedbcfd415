"""Numbers and carried values along an order, without one task for a hot group.

Rows are range-sorted as a table, so that every task has a like number of them whatever their groups are. What a group has before a partition is
carried to it: a partition continues one group at most, so that what is carried are as many rows as there are partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.sources.files import written


def ranged(df: DataFrame, *order: Column) -> DataFrame:
    """df, range-sorted, as a written table with the range partition (_part) and the place in it (_place) of each row.

    Rows that agree in all of order may stand in either order, but the table keeps the one they got.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return written(rows.select("*", F.spark_partition_id().alias("_part"), place.alias("_place")))


def dense_number(df: DataFrame, order: str, name: str = "_n") -> DataFrame:
    """df with 1, 2, ... by a column: a row's number is its place after the partitions before its own.

    What meets in one task is a count for each partition, however sparse the column is. Rows that are equal in it are numbered in any order.
    """
    placed = ranged(df, F.col(order))
    counted = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_low"))
    begins = counted.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n") - F.col("_low") + 1).alias("_begin"))
    return placed.join(F.broadcast(begins), "_part").withColumn(name, F.col("_begin") + F.col("_place")).drop("_part", "_place", "_begin")


def _with_before(placed: DataFrame, heads: DataFrame, by: list[str], before: Column) -> DataFrame:
    """placed with _before: what before makes of the heads (_part, by, ...) of the same group in earlier partitions; null if there are none.

    Only the first group of a partition can have begun in an earlier one, so the join's small side has a row a partition at most.
    """
    carried = heads.withColumn("_before", before).filter("_before is not null")
    other = carried.select("_before", F.col("_part").alias("_of_part"), *[F.col(c).alias(f"_of_{c}") for c in by])
    same = F.col("_part") == F.col("_of_part")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return placed.join(F.broadcast(other), same, "left").drop("_of_part", *[f"_of_{c}" for c in by])


def _earlier(by: list[str]):
    return Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """df with name, 1, 2, ... within each group of equal by, in order. A group may hold most of the rows: it is numbered range by range."""
    placed = ranged(df, *[F.col(c) for c in by], *order)
    heads = placed.groupBy("_part", *by).agg(F.count("*").alias("_n"))
    near = Window.partitionBy("_part", *by).orderBy("_place")
    counted = _with_before(placed.withColumn("_in", F.row_number().over(near)), heads, by, F.sum("_n").over(_earlier(by)))
    return counted.withColumn(name, (F.col("_in") + F.coalesce("_before", F.lit(0))).cast("long")).drop("_part", "_place", "_in", "_before")


def last_seen(df: DataFrame, by: list[str], order: list[Column], value: str, name: str) -> DataFrame:
    """df with name, the last value that is not null of its own row or an earlier one of its group; null before the first."""
    placed = ranged(df, *[F.col(c) for c in by], *order)
    heads = placed.groupBy("_part", *by).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_place"))).alias("_last"))
    near = Window.partitionBy("_part", *by).orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    seen = _with_before(placed.withColumn("_in", F.last(value, True).over(near)), heads, by, F.last("_last", True).over(_earlier(by)))
    return seen.withColumn(name, F.coalesce("_in", "_before")).drop("_part", "_place", "_in", "_before")
