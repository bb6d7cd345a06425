"""Queries on matrices, ranges and cuts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import partition as P
from tidemark.plans.common import EMB_SQL, r, text_unit_sql
from tidemark.runtime import table


def _coo(spark, root):
    """Part × supplier: the mean quantity of each pair."""
    li = table(spark, root, "lineitem")
    g = li.groupBy(F.col("l_partkey").cast("int").alias("i"), F.col("l_suppkey").cast("int").alias("j"))
    return g.agg(F.avg("l_quantity").alias("x"))


def coo_cells(spark, root):
    """Cells of the stored sparse entries: the newest sound value of each, by arrival."""
    c = table(spark, root, "coo_entry").where("row_id is not null and col_id is not null and x is not null and not isnan(x)")
    return c.groupBy(F.col("row_id").alias("i"), F.col("col_id").alias("j")).agg(r(F.max_by("x", F.struct("ingested_at", "entry_id")).cast("double")).alias("x"))


def coo_dims(spark, root):
    return P.coo_dims(_coo(spark, root))


def nnz_per_row(spark, root):
    return _coo(spark, root).groupBy("i").agg(F.count(F.lit(1)).alias("nnz"))


def nnz_per_col(spark, root):
    return _coo(spark, root).groupBy("j").agg(F.count(F.lit(1)).alias("nnz"))


def max_col_of_part(spark, root):
    """What a partition verifier looks at: the largest column of each row range."""
    return _coo(spark, root).groupBy(F.floor(F.col("i") / 500).cast("int").alias("part")).agg(F.max("j").alias("max_col"))


def distinct_in_range(spark, root):
    c = _coo(spark, root).where("i between 100 and 600")
    return c.agg(F.count_distinct("i").alias("n_rows"), F.count_distinct("j").alias("n_cols"))


def tile_matrix(spark, root):
    t = P.tile(_coo(spark, root), 2, 2, 100_000, 10_000)
    return t.groupBy("i").agg(F.count(F.lit(1)).alias("nnz"), F.min("j").alias("first"), F.max("j").alias("last"), r(F.sum("x"), 4).alias("total"))


def row_split(spark, root):
    """Rows in the order of their ids, cut where 1000 entries are full; no row is cut."""
    n = _coo(spark, root).groupBy("i").agg(F.count(F.lit(1)).alias("nnz"))
    return P.split_by_weight(n, "i", "nnz", 1000).select("i", "part")


def worker_ranges(spark, root):
    """Near-even ranges of the customers over 7 workers."""
    c = P.numbered(table(spark, root, "customer").select("c_custkey"), "c_custkey")
    n = c.agg(F.count(F.lit(1)).alias("n"))
    w = c.crossJoin(F.broadcast(n)).withColumn("worker", P.worker_of(F.col("row_no"), F.col("n"), 7))
    return w.groupBy("worker").agg(F.min("row_no").alias("first"), (F.max("row_no") + 1).alias("end"))


def token_partition(spark, root):
    """Documents by id, cut by a running sum of characters."""
    d = table(spark, root, "documents").where("n_chars is not null").select("doc_id", "n_chars")
    return P.split_by_weight(d, "doc_id", "n_chars", 50_000).select("doc_id", "part")


def token_partition_greedy(spark, root):
    """The cut that starts anew at each part: ends beyond the target less the mean document."""
    d = table(spark, root, "documents").where("n_chars is not null").select("doc_id", "n_chars")
    return P.greedy_parts(d, "doc_id", "n_chars", 50_000.0, 1_800.0).select("doc_id", "part")


def quantile_label(spark, root):
    o = table(spark, root, "orders").select("o_orderkey", "o_totalprice")
    return P.quantile_labels(o, "o_totalprice", 7, "o_orderkey").select("o_orderkey", "label")


def permute(spark, root):
    """Rows relabelled by a permutation that follows a fixed rule."""
    c = _coo(spark, root)
    n = c.agg((F.max("i") + 1).alias("n"))
    mapping = c.select("i").distinct().crossJoin(F.broadcast(n)).select(F.col("i").alias("old"), (F.col("n") - F.col("i")).cast("int").alias("new"))
    return P.relabel(c, mapping).groupBy("i").agg(F.count(F.lit(1)).alias("nnz"), r(F.sum("x"), 4).alias("total"))


def permute_hash(spark, root):
    return P.hash_permutation(_coo(spark, root), "i", 3)


def passes(spark, root):
    """Three passes over a stream of orders."""
    o = table(spark, root, "orders").select("o_orderstatus", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("pass"))
    return o.groupBy("o_orderstatus", "pass").agg(F.count(F.lit(1)).alias("n"))


def class_counts(spark, root):
    """The distinct features and rows of each class."""
    e = table(spark, root, "embeddings").select("label", F.posexplode("embedding").alias("fid", "x")).where("x > 0")
    return e.groupBy("label").agg(F.count_distinct("fid").alias("features"), F.count(F.lit(1)).alias("positive"))


def meta_values(spark, root):
    """Meta lines as name and value; names are trimmed, of contradicting lines the largest value counts, flags are "1"."""
    m = table(spark, root, "dataset_meta").where("meta_name is not null and meta_value is not null and trim(meta_value) <> ''")
    g = m.groupBy("db_name", F.trim("meta_name").alias("meta_name")).agg(F.max(F.trim("meta_value")).alias("meta_value"), F.count_distinct(F.trim("meta_value")).alias("n_values"))
    return g.withColumn("flag", F.col("meta_value") == "1")


QUERIES = {
    q.__name__: q
    for q in (coo_cells, coo_dims, nnz_per_row, nnz_per_col, max_col_of_part, distinct_in_range, tile_matrix, row_split, worker_ranges, token_partition, token_partition_greedy, quantile_label, permute, permute_hash, passes, class_counts, meta_values)
}

_COO = "c AS (SELECT CAST(l_partkey AS INT) AS i, CAST(l_suppkey AS INT) AS j, avg(l_quantity) AS x FROM lineitem GROUP BY 1, 2)"

ORACLE = {
    "coo_cells": "SELECT row_id AS i, col_id AS j, round(arg_max(x, ROW(ingested_at, entry_id))::DOUBLE, 6) + 0.0 AS x FROM coo_entry WHERE row_id IS NOT NULL AND col_id IS NOT NULL AND x IS NOT NULL AND NOT isnan(x) GROUP BY 1, 2",
    "coo_dims": f"WITH {_COO} SELECT max(i) + 1 AS n_rows, max(j) + 1 AS n_cols FROM c",
    "nnz_per_row": f"WITH {_COO} SELECT i, count(*) AS nnz FROM c GROUP BY 1",
    "nnz_per_col": f"WITH {_COO} SELECT j, count(*) AS nnz FROM c GROUP BY 1",
    "max_col_of_part": f"WITH {_COO} SELECT CAST(i // 500 AS INT) AS part, max(j) AS max_col FROM c GROUP BY 1",
    "distinct_in_range": f"WITH {_COO} SELECT count(DISTINCT i) AS n_rows, count(DISTINCT j) AS n_cols FROM c WHERE i BETWEEN 100 AND 600",
    "tile_matrix": f"WITH {_COO}, t AS (SELECT CAST(i + a * 100000 AS INT) AS i, CAST(j + b * 10000 AS INT) AS j, x FROM c, range(0, 2) ra(a), range(0, 2) rb(b)) SELECT i, count(*) AS nnz, min(j) AS first, max(j) AS last, round(sum(x), 4) + 0.0 AS total FROM t GROUP BY 1",
    "row_split": f"WITH {_COO}, n AS (SELECT i, count(*) AS nnz FROM c GROUP BY 1) SELECT i, CAST((sum(nnz) OVER (ORDER BY i) - nnz) // 1000 AS INT) AS part FROM n",
    "worker_ranges": """WITH c AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_no, count(*) OVER () AS n FROM customer),
        w AS (SELECT w, w * (n // 7) + least(w, n % 7) AS first, (w + 1) * (n // 7) + least(w + 1, n % 7) AS stop FROM (SELECT DISTINCT n FROM c), range(0, 7) t(w))
        SELECT CAST(w AS INT) AS worker, CAST(first AS BIGINT) AS first, CAST(stop AS BIGINT) AS "end" FROM w WHERE stop > first""",
    "token_partition_greedy": """WITH RECURSIVE o AS MATERIALIZED (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) AS rn FROM documents WHERE n_chars IS NOT NULL),
        g AS (SELECT rn, doc_id, 0 AS part, n_chars AS total FROM o WHERE rn = 1
            UNION ALL SELECT o.rn, o.doc_id, g.part + (g.total > 48200)::INT, CASE WHEN g.total > 48200 THEN o.n_chars ELSE g.total + o.n_chars END FROM g JOIN o ON o.rn = g.rn + 1)
        SELECT doc_id, CAST(part AS INT) AS part FROM g""",
    "permute_hash": f"WITH {_COO}, d AS (SELECT DISTINCT i AS old FROM c) SELECT old, CAST(row_number() OVER (ORDER BY {text_unit_sql(3, 'old')}, old) - 1 AS INT) AS new FROM d",
    "token_partition": "SELECT doc_id, CAST((sum(n_chars) OVER (ORDER BY doc_id) - n_chars) // 50000 AS INT) AS part FROM documents WHERE n_chars IS NOT NULL",
    "quantile_label": """WITH o AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice) - 1 AS rn, count(*) OVER () AS n FROM orders),
        c AS (SELECT l, CASE WHEN l = 6 THEN (SELECT max(o_totalprice) FROM o) ELSE (SELECT o_totalprice FROM o WHERE rn = least((l + 1) * n // 7, n - 1)) END AS cut FROM range(0, 7) t(l))
        SELECT o_orderkey, CAST((SELECT min(l) FROM c WHERE cut >= o_totalprice) AS INT) AS label FROM o""",
    "permute": f"WITH {_COO} SELECT CAST((SELECT max(i) + 1 FROM c) - i AS INT) AS i, count(*) AS nnz, round(sum(x), 4) + 0.0 AS total FROM c GROUP BY 1",
    "passes": 'SELECT o_orderstatus, CAST(p AS INT) AS "pass", count(*) AS n FROM orders, range(0, 3) t(p) GROUP BY 1, 2',
    "class_counts": f"WITH {EMB_SQL} SELECT label, count(DISTINCT fid) AS features, count(*) AS positive FROM emb WHERE x > 0 GROUP BY 1",
    "meta_values": """SELECT db_name, trim(meta_name) AS meta_name, max(trim(meta_value)) AS meta_value, count(DISTINCT trim(meta_value)) AS n_values, max(trim(meta_value)) = '1' AS flag
        FROM dataset_meta WHERE meta_name IS NOT NULL AND meta_value IS NOT NULL AND trim(meta_value) <> '' GROUP BY 1, 2""",
}
