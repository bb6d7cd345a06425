"""Queries on the importance of pending rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import vec
from tidemark.operators import clocks as C
from tidemark.operators import priority as P
from tidemark.operators.deltas import merge
from tidemark.plans.common import EVENT_SQL, LINE_SQL, event_log, lineitem_log, r, text_unit_sql


def importance_abs(spark, root):
    return P.pending_rows(lineitem_log(spark, root)).select("row_id", r("importance").alias("importance"))


def importance_relative(spark, root):
    """Days from the 20th on against the table before them."""
    log = event_log(spark, root)
    before = C.snapshot_at(log, 20)
    new = merge(log.where("clock >= 20")).withColumnRenamed("value", "delta")
    joined = new.join(before, ["row_id", "col_id"], "left")
    return joined.groupBy("row_id").agg(r(F.sum(P.relative_magnitude(F.col("delta"), F.col("value")))).alias("importance"))


def importance_count(spark, root):
    return P.pending_rows(event_log(spark, root), F.lit(1)).select("row_id", F.col("importance").alias("importance"))


def pending_heap(spark, root):
    return P.pending_rows(event_log(spark, root)).select("row_id", r("importance", 4).alias("importance"), "min_clock", "n")


def topk_rows(spark, root):
    return P.top_rows(P.pending_rows(event_log(spark, root)), 20).select("row_id", r("importance", 4).alias("importance"))


def topk_fifo(spark, root):
    return P.top_rows(P.pending_rows(event_log(spark, root)), 20, "fifo").select("row_id", "min_clock")


def upto_clock_then_topk(spark, root):
    pending = P.pending_rows(event_log(spark, root).where("clock >= 4"))
    return P.up_to_clock_then_top(pending, 4, 120).select("row_id", "min_clock", "due")


def fixed_order_cursor(spark, root):
    pending = P.pending_rows(event_log(spark, root))
    return P.top_rows(pending, 25, "fixed_order", cursor=140, n_rows=150).select("row_id")


def random_order(spark, root):
    return P.top_rows(P.pending_rows(event_log(spark, root)), 25, "random", seed=11).select("row_id")


def candidate_topk(spark, root):
    pending = P.pending_rows(event_log(spark, root))
    return P.candidate_top(pending, 20, 3.0, seed=7).select("row_id", r("importance", 4).alias("importance"))


def merge_pending(spark, root):
    log = event_log(spark, root)
    a, b = P.pending_rows(log.where("clock < 10")), P.pending_rows(log.where("clock >= 10"))
    return P.merge_pending(a, b).select("row_id", r("importance", 4).alias("importance"), "min_clock", "n")


def merge_pending_overwrite(spark, root):
    log = event_log(spark, root)
    a, b = P.pending_rows(log.where("clock < 10")), P.pending_rows(log.where("clock >= 10"))
    return P.merge_pending(a, b, keep_min=False).select("row_id", "min_clock", "n")


def dirty_subscribed(spark, root):
    log = event_log(spark, root)
    subs = log.where("worker = 1 and clock = 3").select("row_id")
    return P.dirty_subscribed(log.where("clock = 5"), subs).select("row_id", r("importance", 4).alias("importance"))


def server_of_row(spark, root):
    rows = lineitem_log(spark, root).select("row_id").distinct()
    s = rows.withColumn("s", vec.server_of_row("row_id", 4, 3))
    return s.select("row_id", "s.channel", "s.client")


QUERIES = {
    q.__name__: q
    for q in (importance_abs, importance_relative, importance_count, pending_heap, topk_rows, topk_fifo, upto_clock_then_topk, fixed_order_cursor, random_order, candidate_topk, merge_pending, merge_pending_overwrite, dirty_subscribed, server_of_row)
}

_PENDING = "p AS (SELECT row_id, sum(abs(delta)) AS imp, min(clock) AS min_clock, count(*) AS n FROM event_log GROUP BY 1)"

ORACLE = {
    "importance_abs": f"WITH {LINE_SQL} SELECT row_id, round(sum(abs(delta)), 6) + 0.0 AS importance FROM line_log GROUP BY 1",
    "importance_relative": f"""WITH {EVENT_SQL}, b AS (SELECT row_id, col_id, sum(delta) AS v FROM event_log WHERE clock < 20 AND delta <> 0 GROUP BY 1, 2),
        d AS (SELECT row_id, col_id, sum(delta) AS d FROM event_log WHERE clock >= 20 AND delta <> 0 GROUP BY 1, 2)
        SELECT row_id, round(sum(abs(CASE WHEN coalesce(v, 0) = 0 THEN d ELSE d / v END)), 6) + 0.0 AS importance FROM d LEFT JOIN b USING (row_id, col_id) GROUP BY 1""",
    "importance_count": f"WITH {EVENT_SQL} SELECT row_id, count(*) AS importance FROM event_log GROUP BY 1",
    "pending_heap": f"WITH {EVENT_SQL}, {_PENDING} SELECT row_id, round(imp, 4) + 0.0 AS importance, min_clock, n FROM p",
    "topk_rows": f"WITH {EVENT_SQL}, {_PENDING} SELECT row_id, round(imp, 4) + 0.0 AS importance FROM p ORDER BY imp DESC, row_id LIMIT 20",
    "topk_fifo": f"WITH {EVENT_SQL}, {_PENDING} SELECT row_id, min_clock FROM p ORDER BY min_clock, row_id LIMIT 20",
    "upto_clock_then_topk": f"""WITH {EVENT_SQL}, p AS (SELECT row_id, sum(abs(delta)) AS imp, min(clock) AS min_clock FROM event_log WHERE clock >= 4 GROUP BY 1),
        q AS (SELECT *, min_clock <= 4 AS due, row_number() OVER (PARTITION BY min_clock <= 4 ORDER BY imp DESC, row_id) AS rn, sum(CASE WHEN min_clock <= 4 THEN 1 ELSE 0 END) OVER () AS nd FROM p)
        SELECT row_id, min_clock, due FROM q WHERE due OR rn <= greatest(0, 120 - nd)""",
    "fixed_order_cursor": f"WITH {EVENT_SQL} SELECT row_id FROM (SELECT DISTINCT row_id FROM event_log) ORDER BY (((row_id - 140) % 150) + 150) % 150, row_id LIMIT 25",
    "random_order": f"WITH {EVENT_SQL} SELECT row_id FROM (SELECT DISTINCT row_id FROM event_log) ORDER BY {text_unit_sql(11, 'row_id')}, row_id LIMIT 25",
    "candidate_topk": f"""WITH {EVENT_SQL}, {_PENDING} SELECT row_id, round(imp, 4) + 0.0 AS importance FROM p
        WHERE {text_unit_sql(7, 'row_id')} < 60.0 / (SELECT count(*) FROM p) ORDER BY imp DESC, row_id LIMIT 20""",
    "merge_pending": f"WITH {EVENT_SQL}, {_PENDING} SELECT row_id, round(imp, 4) + 0.0 AS importance, min_clock, n FROM p",
    "merge_pending_overwrite": f"""WITH {EVENT_SQL} SELECT row_id, coalesce(min(clock) FILTER (clock >= 10), min(clock)) AS min_clock, count(*) AS n FROM event_log GROUP BY 1""",
    "dirty_subscribed": f"""WITH {EVENT_SQL}, d AS (SELECT row_id, col_id, sum(delta) AS v FROM event_log WHERE clock = 5 GROUP BY 1, 2)
        SELECT row_id, round(sum(abs(v)), 4) + 0.0 AS importance FROM d WHERE v <> 0 AND row_id IN (SELECT row_id FROM event_log WHERE worker = 1 AND clock = 3) GROUP BY 1""",
    "server_of_row": "SELECT DISTINCT CAST(l_suppkey AS INT) AS row_id, CAST(l_suppkey % 4 AS INT) AS channel, CAST((l_suppkey // 4) % 3 AS INT) AS client FROM lineitem",
}
