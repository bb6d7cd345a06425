"""Exact ranks and prefix cuts of large groups without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.runtime import staged

#: Rows that a slice is to hold, and the fewest slices.
SLICE_ROWS, FEWEST = 65_536, 256


def slices_for(rows: int) -> int:
    """How many slices a group of at most so many rows is cut into, so that a task's part doesn't grow with the table."""
    return max(FEWEST, -(-rows // SLICE_ROWS))


def bucket_of(unit: Column, buckets: int) -> Column:
    """Bucket 0..buckets-1 of a number in [0, 1); order-preserving."""
    return F.least(F.floor(unit * buckets), F.lit(buckets - 1)).cast("int")


def _with_offsets(rows: DataFrame, keys: list[str], bucket: str, weight: Column, out: str) -> DataFrame:
    """Add to each row the total weight of its group's earlier buckets; totals per bucket are aggregated before their shuffle."""
    sums = rows.groupBy(*keys, bucket).agg(weight.alias("__n"))
    w = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(bucket).alias("__b2"), F.coalesce(F.sum("__n").over(w), F.lit(0)).alias(out))
    on = F.col(bucket) == F.col("__b2")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return rows.join(offsets, on).drop("__b2", *[f"__k{i}" for i in range(len(keys))])


def rank_by_unit(df: DataFrame, keys: list[str], unit: str, tie: str, rank: str = "rank", buckets: int = FEWEST) -> DataFrame:
    """Add the 1-based rank of each row in its ``keys`` group by (``unit``, ``tie``).

    ``unit`` is a number in [0, 1), normally a hash, so the rows of even the
    largest group spread over ``buckets`` sub-groups (:func:`slices_for`).
    Counts per sub-group are aggregated before the shuffle, their running sum
    gives each sub-group's offset, and only rows of one sub-group are ever
    sorted together. Null keys form a group of their own.
    """
    b, off = "__bucket", "__offset"
    rows = df.withColumn(b, bucket_of(F.col(unit), buckets))
    inner = W.partitionBy(*keys, b).orderBy(unit, tie)
    return _with_offsets(rows, keys, b, F.count(F.lit(1)), off).withColumn(rank, F.col(off) + F.row_number().over(inner)).drop(b, off)


def prefix_sum_by_unit(df: DataFrame, keys: list[str], unit: str, tie: str, size: str, out: str = "before", buckets: int = FEWEST) -> DataFrame:
    """Add the sum of ``size`` over the rows that come before each row by (``unit``, ``tie``) within ``keys``.

    The same two-level scheme as :func:`rank_by_unit`.
    """
    b, off = "__bucket", "__offset"
    rows = df.withColumn(b, bucket_of(F.col(unit), buckets))
    inner = W.partitionBy(*keys, b).orderBy(unit, tie).rowsBetween(W.unboundedPreceding, -1)
    return _with_offsets(rows, keys, b, F.sum(size), off).withColumn(out, F.col(off) + F.coalesce(F.sum(size).over(inner), F.lit(0))).drop(b, off)


def prefix_sum_by_order(df: DataFrame, order: list[str], size: str | None, out: str) -> DataFrame:
    """Add the sum of ``size`` (None: the number) of the rows that come before each row in the order of columns.

    Rows are cut into slices of like numbers by Spark's range partitioning,
    which samples the columns, so neither outliers nor crowded values fill one
    slice as long as ``order`` as a whole tells rows apart. The slices are
    written, since a repeated sample could cut otherwise; their totals give
    each slice's offset, and rows are summed within their slice.
    """
    slices = max(8, -(-df.count() // SLICE_ROWS))
    rows = staged(df.repartitionByRange(slices, *order).withColumn("__slice", F.spark_partition_id()), "slices")
    weight = F.lit(1) if size is None else F.col(size)
    inner = W.partitionBy("__slice").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy("__slice").agg(F.sum(weight).alias("__n"))
    w = W.orderBy("__s2").rowsBetween(W.unboundedPreceding, -1)  # one row a slice
    offsets = sums.select(F.col("__slice").alias("__s2"), "__n").select("__s2", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__offset"))
    placed = rows.join(offsets, F.col("__slice") == F.col("__s2"))
    return placed.withColumn(out, F.col("__offset") + F.coalesce(F.sum(weight).over(inner), F.lit(0))).drop("__slice", "__s2", "__offset")
