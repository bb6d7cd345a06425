"""Logical clocks of workers, and reads of bounded staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.deltas import merge


def worker_clocks(log: DataFrame) -> DataFrame:
    """``worker, clock``: the number of clocks each worker has finished (its last clock, plus one)."""
    return log.groupBy("worker").agg((F.max("clock") + 1).cast("int").alias("clock"))


def min_clock(clocks: DataFrame) -> DataFrame:
    """The server's clock: the least of all workers' clocks; no row without workers."""
    return clocks.agg(F.min("clock").alias("min_clock")).where("min_clock is not null")


def unique_min(clocks: DataFrame) -> DataFrame:
    """``min_clock, n_slowest, unique_slowest``: whether the next tick of one worker moves the minimum."""
    low = clocks.agg(F.min("clock").alias("min_clock"))
    at = clocks.crossJoin(F.broadcast(low)).where("clock = min_clock")  # one row
    return at.groupBy("min_clock").agg(F.count(F.lit(1)).alias("n_slowest")).withColumn("unique_slowest", F.col("n_slowest") == 1)


def leads(clocks: DataFrame, clock: int) -> DataFrame:
    """``leads``: whether ``clock`` is ahead of every worker's."""
    return clocks.agg((F.coalesce(F.max("clock"), F.lit(-1)) < clock).alias("leads"))


def tick(clocks: DataFrame, worker: Column | int) -> DataFrame:
    """The clocks after one worker's tick."""
    w = F.lit(worker) if isinstance(worker, int) else worker
    return clocks.withColumn("clock", F.col("clock") + F.when(F.col("worker") == w, 1).otherwise(0))


def visible(reader_clock: int, staleness: int, reader: int | None = None) -> Column:
    """What a reader at a clock is sure to see: everyone's increments older than its staleness, and all its own."""
    bound = max(0, reader_clock - staleness)
    seen = F.col("clock") < bound
    return seen if reader is None else seen | (F.col("worker") == reader)


def stale_read(log: DataFrame, reader_clock: int, staleness: int, reader: int | None = None) -> DataFrame:
    """The table as a reader at ``reader_clock`` is sure to see it; with staleness 0, bulk-synchronous."""
    return merge(log.where(visible(reader_clock, staleness, reader)))


def snapshot_at(log: DataFrame, clock: int) -> DataFrame:
    """The table after all increments before ``clock``."""
    return merge(log.where(F.col("clock") < clock))


def latest_as_of(versions: DataFrame, clock: int) -> DataFrame:
    """As-of read of versioned rows ``(row_id, clock, value)``: each row's last version at or before ``clock``."""
    return versions.where(F.col("clock") <= clock).groupBy("row_id").agg(F.max_by("value", "clock").alias("value"), F.max("clock").alias("clock"))


def replay_pending(pushed: DataFrame, pending: DataFrame) -> DataFrame:
    """Pushed values with the reader's own pending increments put on top again."""
    both = pushed.select("row_id", "col_id", F.col("value").alias("delta")).unionByName(pending.select("row_id", "col_id", "delta"))
    return merge(both)


def subscribed(values: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Only the rows that some client reads."""
    return values.join(subscriptions.select("row_id").distinct(), "row_id", "left_semi")
