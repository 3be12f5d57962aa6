"""Operators over ordered rows: carrying forward, runs, repeated lines, buckets, running numbers, first and last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def carried(df: DataFrame, value: Column, by: list[str], order: list[str], name: str) -> DataFrame:
    """The last non-null value up to and including each row."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def with_runs(df: DataFrame, label: Column, by: list[str], order: list[str], name: str = "run") -> DataFrame:
    """A number that grows where the label differs from the row before; null is a label."""
    w = W.partitionBy(*by).orderBy(*order)
    changed = F.when(F.row_number().over(w) == 1, 0).otherwise((~F.lag(label).over(w).eqNullSafe(label)).cast("int"))
    return df.withColumn("__changed__", changed).withColumn(name, F.sum("__changed__").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__changed__")


def merged_runs(df: DataFrame, label: str, by: list[str], order: str, start: str, end: str, text: str) -> DataFrame:
    """One row for each run of a label: its first start, last end, and the texts in order joined by spaces."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text).alias("t"))))
    joined = F.array_join(F.transform(parts, lambda p: p["t"]), " ")
    return with_runs(df, F.col(label), by, [order]).groupBy(*by, "run").agg(F.min_by(label, order).alias(label), F.min(start).alias(start), F.max(end).alias(end), joined.alias(text))


def without_repeats(df: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    """Rows whose value differs from the row before; empty and null values go first."""
    kept = df.where(F.coalesce(F.trim(value), F.lit("")) != "")
    before = F.lag(value).over(W.partitionBy(*by).orderBy(*order))
    return kept.withColumn("__before__", before).where(F.col("__before__").isNull() | (F.col("__before__") != F.col(value))).drop("__before__")


def buckets(df: DataFrame, size: int, by: list[str], order: list[str], name: str = "bucket") -> DataFrame:
    """Numbers of consecutive groups of size rows."""
    return df.withColumn(name, F.floor((F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1) / size))


def passages(df: DataFrame, most: int, by: list[str], order: list[str], name: str = "passage") -> DataFrame:
    """Numbers of consecutive groups whose size is the rows of the partition by most, at least 1."""
    w = W.partitionBy(*by)
    step = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(w) / most))
    return df.withColumn(name, F.floor((F.row_number().over(w.orderBy(*order)) - 1) / step))


def numbered(df: DataFrame, by: list[str], order: list[str], name: str, base: int = 0) -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1 + base)


def by_appearance(df: DataFrame, value: str, by: list[str], order: str, name: str) -> DataFrame:
    """Numbers values from 1 in the order in which they first appear."""
    first = F.min(order).over(W.partitionBy(*by, value))
    return df.withColumn("__first__", first).withColumn(name, F.dense_rank().over(W.partitionBy(*by).orderBy("__first__"))).drop("__first__")


def evenly(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """At most n rows at even distances, without chance.

    Rows are sorted by ranges over all tasks; the sizes of the ranges, a number each, give every row its place. The sorted
    table is saved in the checkpoint folder, as a second sort could cut other ranges."""
    from .algorithms import saved

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # The ids grow by one inside a partition, in its order.
    placed = saved(placed.withColumn("__p__", F.spark_partition_id()).withColumn("__i__", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    sizes = dict(placed.groupBy("__p__").count().collect())  # a number for each task
    before, total = {}, 0
    for p in sorted(sizes):
        before[p], total = total, total + sizes[p]
    if not n or not total:
        return df.limit(0)
    step = max(1, total // n)
    at = F.create_map(*[F.lit(x) for p in before for x in (p, before[p])])[F.col("__p__")] + F.col("__i__")
    return placed.where((at % step == 0) & (at < step * n)).drop("__i__", "__p__")
