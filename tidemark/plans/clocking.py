"""Queries on logical clocks and reads of bounded staleness."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import clocks as C
from tidemark.plans.common import EVENT_SQL, event_log, r

READER, CLOCK = 1, 20


def vector_clock(spark, root):
    return C.worker_clocks(event_log(spark, root))


def vector_clock_min(spark, root):
    return C.min_clock(C.worker_clocks(event_log(spark, root)))


def unique_min_clock(spark, root):
    """Clocks by user (mod 40) rather than by worker, so that they differ."""
    log = event_log(spark, root).withColumn("worker", F.col("row_id") % 40)
    return C.unique_min(C.worker_clocks(log))


def max_clock_leads(spark, root):
    return C.leads(C.worker_clocks(event_log(spark, root)), 31)


def clock_after_tick(spark, root):
    return C.tick(C.worker_clocks(event_log(spark, root)), 2)


def _cells(df):
    return df.select("row_id", "col_id", r("value", 4).alias("value"))


def stale_read_s0(spark, root):
    return _cells(C.stale_read(event_log(spark, root), CLOCK, 0))


def stale_read_s2(spark, root):
    return _cells(C.stale_read(event_log(spark, root), CLOCK, 2))


def read_my_writes(spark, root):
    return _cells(C.stale_read(event_log(spark, root), CLOCK, 5, READER))


def snapshot_at_clock(spark, root):
    return _cells(C.snapshot_at(event_log(spark, root), 10))


def replay_pending(spark, root):
    log = event_log(spark, root)
    pushed = C.snapshot_at(log, 15)
    return _cells(C.replay_pending(pushed, log.where((F.col("clock") >= 15) & (F.col("worker") == READER))))


def as_of_row(spark, root):
    """Each user's last daily total on or before day 12."""
    log = event_log(spark, root)
    versions = log.groupBy("row_id", "clock").agg(F.sum("delta").alias("value"))
    return C.latest_as_of(versions, 12).select("row_id", r("value", 4).alias("value"), "clock")


def subscribed_rows(spark, root):
    log = event_log(spark, root)
    subs = log.where((F.col("worker") == READER) & (F.col("clock") == 3)).select("row_id")
    return _cells(C.subscribed(C.snapshot_at(log, 30), subs))


def sum_per_clock(spark, root):
    """A clock as a tumbling logical window."""
    return event_log(spark, root).groupBy("clock", "worker").agg(r(F.sum("delta"), 4).alias("total"), F.count(F.lit(1)).alias("n"))


QUERIES = {
    q.__name__: q
    for q in (vector_clock, vector_clock_min, unique_min_clock, max_clock_leads, clock_after_tick, stale_read_s0, stale_read_s2, read_my_writes, snapshot_at_clock, replay_pending, as_of_row, subscribed_rows, sum_per_clock)
}


def _sum(where: str) -> str:
    return f"WITH {EVENT_SQL} SELECT row_id, col_id, round(sum(delta), 4) + 0.0 AS value FROM event_log WHERE delta <> 0 AND ({where}) GROUP BY 1, 2"


_CLOCKS = f"WITH {EVENT_SQL}, c AS (SELECT worker, CAST(max(clock) + 1 AS INT) AS clock FROM event_log GROUP BY 1)"

ORACLE = {
    "vector_clock": f"{_CLOCKS} SELECT * FROM c",
    "vector_clock_min": f"{_CLOCKS} SELECT min(clock) AS min_clock FROM c",
    "unique_min_clock": f"""WITH {EVENT_SQL}, c AS (SELECT row_id % 40 AS worker, CAST(max(clock) + 1 AS INT) AS clock FROM event_log GROUP BY 1)
        SELECT clock AS min_clock, count(*) AS n_slowest, count(*) = 1 AS unique_slowest FROM c WHERE clock = (SELECT min(clock) FROM c) GROUP BY 1""",
    "max_clock_leads": f"{_CLOCKS} SELECT max(clock) < 31 AS leads FROM c",
    "clock_after_tick": f"{_CLOCKS} SELECT worker, CAST(clock + CASE WHEN worker = 2 THEN 1 ELSE 0 END AS INT) AS clock FROM c",
    "stale_read_s0": _sum("clock < 20"),
    "stale_read_s2": _sum("clock < 18"),
    "read_my_writes": _sum("clock < 15 OR worker = 1"),
    "snapshot_at_clock": _sum("clock < 10"),
    "replay_pending": _sum("clock < 15 OR worker = 1"),
    "as_of_row": f"""WITH {EVENT_SQL}, v AS (SELECT row_id, clock, sum(delta) AS value FROM event_log WHERE clock <= 12 GROUP BY 1, 2)
        SELECT row_id, round(arg_max(value, clock), 4) + 0.0 AS value, max(clock) AS clock FROM v GROUP BY 1""",
    "subscribed_rows": _sum("clock < 30 AND row_id IN (SELECT row_id FROM event_log WHERE worker = 1 AND clock = 3)"),
    "sum_per_clock": f"WITH {EVENT_SQL} SELECT clock, worker, round(sum(delta), 4) + 0.0 AS total, count(*) AS n FROM event_log GROUP BY 1, 2",
}
