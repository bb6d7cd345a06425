"""Queries that run a stream to its end; results equal the batch ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.deltas import inc
from tidemark.plans.common import EVENT_SQL, EVENT_TYPES, r
from tidemark.plans.optimisers import _rev
from tidemark.streaming import deltas as S


def _events(spark, root):
    e = S.file_stream(spark, f"{root}/events.parquet")
    kind = F.array_position(F.array(*[F.lit(t) for t in EVENT_TYPES]), F.col("event_type")) - 1
    e = e.select("user_id", "value", "ts", kind.alias("kind"), (F.col("user_id") % 4).cast("int").alias("worker"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("clock"))
    return inc(e, "user_id", "kind", "value", "worker", "clock", "ts")


def stream_delta_sum(spark, root):
    out = S.drain(S.sum_stream(_events(spark, root)), ["row_id", "col_id"])
    return out.select("row_id", "col_id", r("value", 4).alias("value"))


def stream_clock_push(spark, root):
    out = S.drain(S.clock_stream(_events(spark, root)), ["clock", "worker"])
    return out.select("clock", "worker", r("total", 4).alias("total"), "n")


def stream_window_counts(spark, root):
    e = _events(spark, root).withColumn("at", F.col("ts").cast("timestamp"))
    out = S.drain(S.window_stream(e, "at", "1 day"), ["start"])
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "n")


def stream_adarevision(spark, root):
    e = S.file_stream(spark, f"{root}/embeddings.parquet").select(F.col("label").alias("row_id"), F.col("vec_id").alias("seq"), F.posexplode("embedding").alias("col_id", "g"))
    g = e.select("row_id", "col_id", "seq", F.col("g").cast("double").alias("g"), F.lit(None).cast("double").alias("g_old"))
    out = S.drain(S.adarevision_stream(g), ["row_id", "col_id"])
    return out.select("row_id", "col_id", r("value").alias("value"))


QUERIES = {q.__name__: q for q in (stream_delta_sum, stream_clock_push, stream_window_counts, stream_adarevision)}

ORACLE = {
    "stream_delta_sum": f"WITH {EVENT_SQL} SELECT row_id, col_id, round(sum(delta), 4) + 0.0 AS value FROM event_log GROUP BY 1, 2",
    "stream_clock_push": f"WITH {EVENT_SQL} SELECT clock, worker, round(sum(delta), 4) + 0.0 AS total, count(*) AS n FROM event_log GROUP BY 1, 2",
    "stream_window_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND value IS NOT NULL GROUP BY 1",
    "stream_adarevision": f"WITH {_rev(0)} SELECT row_id, col_id, round(arg_max(value, seq), 6) + 0.0 AS value FROM v GROUP BY 1, 2",
}
