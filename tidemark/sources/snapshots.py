"""Snapshots of tables by clock, and how to go on from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(values: DataFrame, folder: str, table: int, clock: int) -> None:
    """Write ``(row_id, col_id, value)`` as the table's state at a clock; an earlier one of the same clock is replaced."""
    values.select("row_id", "col_id", "value").write.mode("overwrite").parquet(f"{folder}/table={table}/clock={clock}")


def clocks(spark: SparkSession, folder: str, table: int) -> list[int]:
    """Clocks of which there is a complete snapshot, ascending."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/table={table}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath() for s in fs.listStatus(path)]
    return sorted(int(p.getName().split("=")[1]) for p in names if p.getName().startswith("clock=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def load(spark: SparkSession, folder: str, table: int, clock: int | None = None) -> DataFrame:
    """The state at a clock, or the newest complete one; raises KeyError if there is none."""
    known = clocks(spark, folder, table)
    at = clock if clock is not None else (known[-1] if known else None)
    if at not in known:
        raise KeyError(f"no snapshot of table {table} at clock {at}")
    return spark.read.schema("row_id int, col_id int, value double").parquet(f"{folder}/table={table}/clock={at}")


def resume(snapshot: DataFrame, log: DataFrame, clock: int) -> DataFrame:
    """A snapshot with the increments from its clock on."""
    late = log.where(F.col("clock") >= clock).select("row_id", "col_id", F.col("delta").alias("value"))
    return snapshot.unionByName(late).groupBy("row_id", "col_id").agg(F.sum("value").alias("value"))


def to_text(values: DataFrame, path: str, capacity: int) -> None:
    """Lines ``row_id v0 v1 …`` of dense rows."""
    from tidemark.operators.deltas import dense_rows
    from tidemark.sources.formats import write_rows

    write_rows(dense_rows(values, capacity), "row_id", "values", path, with_key=True)
