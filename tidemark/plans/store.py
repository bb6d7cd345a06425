"""Queries on tables as logs of increments."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import deltas as D
from tidemark.plans.common import EMB_SQL, LINE_SQL, lineitem_log, r
from tidemark.runtime import table

CAPACITY = 8


def inc_sum(spark, root):
    return D.merge(lineitem_log(spark, root)).select("row_id", "col_id", r("value").alias("value"))


def batch_inc(spark, root):
    """Line numbers and quantities of each order, as one batch of increments to its supplier-free row."""
    li = table(spark, root, "lineitem")
    batch = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("b"))
    d = D.batch_inc(batch, F.col("l_orderkey") % 1000, "b.l_linenumber", "b.l_quantity")
    return D.merge(d).select("row_id", "col_id", r("value").alias("value"))


def dense_batch_inc(spark, root):
    d = D.dense_batch_inc(table(spark, root, "embeddings"), "label", "embedding")
    return D.merge(d).select("row_id", "col_id", r("value").alias("value"))


def dense_batch_inc_offset(spark, root):
    d = D.dense_batch_inc(table(spark, root, "embeddings"), "label", F.slice("embedding", 1, 4), F.lit(10))
    return D.merge(d).select("row_id", "col_id", r("value").alias("value"))


def sparse_row_drop_zero(spark, root):
    """Quantities above 25 count up, others down, in whole units; cells that end at zero are gone."""
    li = table(spark, root, "lineitem")
    d = D.inc(li, "l_suppkey", "l_linenumber", F.when(F.col("l_quantity") > 25, 1.0).otherwise(-1.0))
    return D.sparse_rows(D.merge(d)).select("row_id", "col_id", r("value").alias("value"))


def dense_row_fill(spark, root):
    v = D.merge(lineitem_log(spark, root).where("col_id <> 3"))
    return D.dense_cells(v, CAPACITY).select("row_id", "col_id", r("value").alias("value"))


def row_lookup(spark, root):
    return D.row_of(D.merge(lineitem_log(spark, root)), 7).select("row_id", "col_id", r("value").alias("value"))


def column_read(spark, root):
    v = D.dense_rows(D.merge(lineitem_log(spark, root)), CAPACITY)
    return D.column_of(v, 2).select("row_id", r("value").alias("value"))


def subtract_updates(spark, root):
    d = lineitem_log(spark, root)
    return D.merge(d.unionByName(D.subtract(d.where("col_id = 1")))).where("value <> 0").select("row_id", "col_id", r("value").alias("value"))


def product_merge_all(spark, root):
    d = D.inc(table(spark, root, "lineitem"), F.col("l_partkey") % 500, "l_linenumber", 1 + F.col("l_tax") / 10)
    return D.merge_product(d).select("row_id", "col_id", r("value", 4).alias("value"))


def weights_over_rows(spark, root):
    """A long weight vector, the sum of quantities by part, in rows of 100 columns."""
    li = table(spark, root, "lineitem")
    w = D.merge(D.inc(li, F.lit(0), "l_partkey", "l_quantity"))
    return D.weight_cells(w, 100).select("row_id", "col_id", r("value").alias("value"))


def clamp_negative(spark, root):
    li = table(spark, root, "lineitem")
    d = D.inc(li, "l_suppkey", "l_linenumber", F.when(F.col("l_quantity") > 25, 1.0).otherwise(-1.0))
    return D.merge(d).select("row_id", "col_id", r(F.greatest("value", F.lit(0.0))).alias("value"))


def union_distinct_ids(spark, root):
    li = table(spark, root, "lineitem")
    a = li.where("l_quantity > 45").select(F.col("l_partkey").alias("word_id"))
    b = li.where("l_discount = 0").select(F.col("l_partkey").alias("word_id"))
    return a.union(b).distinct()


def flagship(spark, root):
    """Class rows of the vectors by increments, their importance, and the five that go first."""
    from tidemark.operators.priority import pending_rows, top_rows

    d = D.dense_batch_inc(table(spark, root, "embeddings"), "label", "embedding")
    pending = pending_rows(D.merge(d).where("value <> 0").withColumnRenamed("value", "delta"))
    return top_rows(pending, 5).select("row_id", r("importance").alias("importance"), F.col("n").alias("n_cells"))


QUERIES = {
    q.__name__: q
    for q in (inc_sum, batch_inc, dense_batch_inc, dense_batch_inc_offset, sparse_row_drop_zero, dense_row_fill, row_lookup, column_read, subtract_updates, product_merge_all, weights_over_rows, clamp_negative, union_distinct_ids, flagship)
}

_SIGN = "SELECT CAST(l_suppkey AS INT) AS row_id, CAST(l_linenumber AS INT) AS col_id, sum(CASE WHEN l_quantity > 25 THEN 1.0 ELSE -1.0 END)::DOUBLE AS value FROM lineitem GROUP BY 1, 2"

ORACLE = {
    "inc_sum": f"WITH {LINE_SQL} SELECT row_id, col_id, round(sum(delta), 6) + 0.0 AS value FROM line_log WHERE delta <> 0 GROUP BY 1, 2",
    "batch_inc": "SELECT CAST(l_orderkey % 1000 AS INT) AS row_id, CAST(l_linenumber AS INT) AS col_id, round(sum(l_quantity), 6) + 0.0 AS value FROM lineitem GROUP BY 1, 2",
    "dense_batch_inc": f"WITH {EMB_SQL} SELECT CAST(label AS INT) AS row_id, fid AS col_id, round(sum(x), 6) + 0.0 AS value FROM emb GROUP BY 1, 2",
    "dense_batch_inc_offset": f"WITH {EMB_SQL} SELECT CAST(label AS INT) AS row_id, CAST(fid + 10 AS INT) AS col_id, round(sum(x), 6) + 0.0 AS value FROM emb WHERE fid < 4 GROUP BY 1, 2",
    "sparse_row_drop_zero": f"SELECT row_id, col_id, value FROM ({_SIGN}) WHERE value <> 0",
    "dense_row_fill": f"""WITH {LINE_SQL}, s AS (SELECT row_id, col_id, sum(delta) AS v FROM line_log WHERE col_id <> 3 GROUP BY 1, 2),
        g AS (SELECT row_id, CAST(c AS INT) AS col_id FROM (SELECT DISTINCT row_id FROM s WHERE col_id BETWEEN 0 AND 7), range(0, 8) t(c))
        SELECT row_id, col_id, round(coalesce(v, 0), 6) + 0.0 AS value FROM g LEFT JOIN s USING (row_id, col_id)""",
    "row_lookup": f"WITH {LINE_SQL} SELECT row_id, col_id, round(sum(delta), 6) + 0.0 AS value FROM line_log WHERE row_id = 7 GROUP BY 1, 2",
    "column_read": f"WITH {LINE_SQL} SELECT row_id, round(sum(CASE WHEN col_id = 2 THEN delta ELSE 0 END), 6) + 0.0 AS value FROM line_log WHERE col_id BETWEEN 0 AND 7 GROUP BY 1",
    "subtract_updates": f"WITH {LINE_SQL} SELECT row_id, col_id, round(sum(delta), 6) + 0.0 AS value FROM line_log WHERE col_id <> 1 GROUP BY 1, 2",
    "product_merge_all": "SELECT CAST(l_partkey % 500 AS INT) AS row_id, CAST(l_linenumber AS INT) AS col_id, round(product(1 + l_tax / 10), 4) + 0.0 AS value FROM lineitem GROUP BY 1, 2",
    "weights_over_rows": "SELECT CAST(l_partkey // 100 AS INT) AS row_id, CAST(l_partkey % 100 AS INT) AS col_id, round(sum(l_quantity), 6) + 0.0 AS value FROM lineitem GROUP BY 1, 2",
    "clamp_negative": f"SELECT row_id, col_id, greatest(value, 0.0) AS value FROM ({_SIGN})",
    "union_distinct_ids": "SELECT l_partkey AS word_id FROM lineitem WHERE l_quantity > 45 UNION SELECT l_partkey FROM lineitem WHERE l_discount = 0",
    "flagship": f"""WITH {EMB_SQL}, s AS (SELECT label, fid, sum(x) AS v FROM emb GROUP BY 1, 2)
        SELECT CAST(label AS INT) AS row_id, round(sum(abs(v)), 6) + 0.0 AS importance, count(*) AS n_cells FROM s WHERE v <> 0 GROUP BY 1 ORDER BY sum(abs(v)) DESC, 1 LIMIT 5""",
}
