"""What several query modules share: logs over the test tables, rounding, worker settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.deltas import inc
from tidemark.runtime import table

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def r(x: Column | str, places: int = 6) -> Column:
    """Rounded, and never a negative zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, places) + F.lit(0.0)


def text_unit_sql(seed: int, *cols: str) -> str:
    """SQL for :func:`tidemark.runtime.text_unit`."""
    values = ", ".join(f"coalesce({c}::VARCHAR, '~')" for c in cols)
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', {values})), 1, 13))::BIGINT / 4503599627370496.0)"


def lineitem_log(spark: SparkSession, root: str) -> DataFrame:
    """Increments of the table supplier × line number by quantity."""
    return inc(table(spark, root, "lineitem"), "l_suppkey", "l_linenumber", "l_quantity")


def event_log(spark: SparkSession, root: str) -> DataFrame:
    """Increments of the table user × kind of event by value; workers are users mod 4, clocks are days."""
    e = table(spark, root, "events")
    kind = F.array_position(F.array(*[F.lit(t) for t in EVENT_TYPES]), F.col("event_type")) - 1
    e = e.select(
        "event_id", "user_id", "value", kind.alias("kind"), (F.col("user_id") % 4).cast("int").alias("worker"),
        F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("clock"), F.col("event_id").alias("seq"),
    )
    return inc(e, "user_id", "kind", "value", "worker", "clock", "seq")


EVENT_SQL = """
    event_log AS (
        SELECT CAST(user_id AS INT) AS row_id, CAST(list_position(['click','error','purchase','signup','view'], event_type) - 1 AS INT) AS col_id,
               CAST(value AS DOUBLE) AS delta, CAST(user_id % 4 AS INT) AS worker,
               CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS clock, event_id AS seq
        FROM events WHERE user_id IS NOT NULL AND event_type IN ('click','error','purchase','signup','view') AND value IS NOT NULL)
"""

LINE_SQL = """
    line_log AS (SELECT CAST(l_suppkey AS INT) AS row_id, CAST(l_linenumber AS INT) AS col_id, CAST(l_quantity AS DOUBLE) AS delta FROM lineitem)
"""

EMB_SQL = """
    emb AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS fid FROM embeddings)
"""
