"""Tables as logs of commutative increments, and the merges that read them.

The canonical log is ``(row_id INT, col_id INT, delta DOUBLE)`` with the
optional columns ``worker``, ``clock`` and ``seq``. A table is the sum of its
log; partial sums run before the shuffle, so a hot row costs one value per task
and column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("row_id", "col_id")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def inc(df: DataFrame, row: Column | str, col: Column | str, delta: Column | str, *extra: str) -> DataFrame:
    """One increment per row of ``df``; rows with a null key or delta give none."""
    out = df.select(_c(row).cast("int").alias("row_id"), _c(col).cast("int").alias("col_id"), _c(delta).cast("double").alias("delta"), *extra)
    return out.where("row_id is not null and col_id is not null and delta is not null")


def batch_inc(df: DataFrame, row: Column | str, cols: Column | str, deltas: Column | str, *extra: str) -> DataFrame:
    """Increments of many columns of a row: parallel arrays of column ids and deltas."""
    pairs = F.arrays_zip(_c(cols).alias("c"), _c(deltas).alias("d"))
    rows = df.select(_c(row).alias("__row"), *extra, F.explode(pairs).alias("__p"))
    names = rows.schema["__p"].dataType.fieldNames()
    return inc(rows, "__row", F.col("__p").getField(names[0]), F.col("__p").getField(names[1]), *extra)


def dense_batch_inc(df: DataFrame, row: Column | str, values: Column | str, first: Column | int = 0, *extra: str) -> DataFrame:
    """Increments of the columns from ``first`` on: one array per row, added once at ``first + place``."""
    start = F.lit(first) if isinstance(first, int) else first
    rows = df.select(_c(row).alias("__row"), start.alias("__first"), *extra, F.posexplode(_c(values)).alias("__i", "__v"))
    return inc(rows, "__row", F.col("__first") + F.col("__i"), "__v", *extra)


def merge(deltas: DataFrame, *by: str) -> DataFrame:
    """Sum of the increments per key; zero increments are dropped before the shuffle."""
    keys = by or KEY
    return deltas.where("delta <> 0").groupBy(*keys).agg(F.sum("delta").alias("value"))


def subtract(deltas: DataFrame) -> DataFrame:
    """The log that takes these increments back."""
    return deltas.withColumn("delta", -F.col("delta"))


def merge_product(deltas: DataFrame, *by: str) -> DataFrame:
    """Product of the factors per key, for tables that multiply; the neutral factor is 1."""
    return deltas.groupBy(*(by or KEY)).agg(F.product("delta").alias("value"))


def sparse_rows(values: DataFrame) -> DataFrame:
    """Only the cells that aren't exactly zero."""
    return values.where("value <> 0")


def dense_rows(values: DataFrame, capacity: int) -> DataFrame:
    """``row_id, values``: every row as an array of ``capacity`` doubles, missing cells 0.

    Cells are put in place by an aggregated map, so no row is joined with a
    range of columns. Columns outside the capacity are left out.
    """
    inside = values.where((F.col("col_id") >= 0) & (F.col("col_id") < capacity))
    cells = inside.groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("col_id", "value"))).alias("m"))
    return cells.select("row_id", F.transform(F.sequence(F.lit(0), F.lit(capacity - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("values"))


def dense_cells(values: DataFrame, capacity: int) -> DataFrame:
    """The dense rows in long form: one row per cell."""
    return dense_rows(values, capacity).select("row_id", F.posexplode("values").alias("col_id", "value"))


def column_of(dense: DataFrame, col: int) -> DataFrame:
    """One column of dense rows; null beyond their end."""
    return dense.select("row_id", F.get("values", F.lit(col)).alias("value"))


def row_of(values: DataFrame, row: int) -> DataFrame:
    """Point lookup: the cells of one row; the filter reaches the scan."""
    return values.where(F.col("row_id") == row)


def weight_cells(values: DataFrame, row_width: int) -> DataFrame:
    """A long vector ``(col_id, value)`` over rows of ``row_width`` columns: row = id div width, column = id mod width."""
    return values.select(F.floor(F.col("col_id") / row_width).cast("int").alias("row_id"), (F.col("col_id") % row_width).cast("int").alias("col_id"), "value")
