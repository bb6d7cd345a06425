"""Queries on losses of models with fixed weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.models import logreg as L
from tidemark.models import matfact as M
from tidemark.plans.common import EMB_SQL, r
from tidemark.plans.etl import _coo
from tidemark.runtime import table

CLASSES, DIMS = 10, 64


def _weights(spark):
    """Fixed class weights from class and feature numbers alone."""
    g = spark.range(CLASSES * DIMS)
    k, f = F.floor(F.col("id") / DIMS).cast("int"), (F.col("id") % DIMS).cast("int")
    return g.select(k.alias("k"), f.alias("fid"), (((k * 13 + f * 7) % 11 - 5) / F.lit(2.0)).alias("w"))


def _data(spark, root):
    e = table(spark, root, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"), F.col("label").alias("y"))


def _binary(spark, root):
    d = _data(spark, root)
    return d.withColumn("y", (F.col("y") >= 5).cast("int"))


def _binary_weights(spark):
    return _weights(spark).where("k = 1").select("fid", "w")


def predict_classes(spark, root):
    p = L.class_probabilities(_data(spark, root), _weights(spark), CLASSES, DIMS)
    return p.select("id", F.posexplode("p").alias("k", "p")).select("id", "k", r("p", 8).alias("p"))


def argmax_class(spark, root):
    p = L.class_probabilities(_data(spark, root), _weights(spark), CLASSES, DIMS)
    return p.select("id", L.predicted_class().alias("predicted"))


def zero_one_loss(spark, root):
    p = L.class_probabilities(_data(spark, root), _weights(spark), CLASSES, DIMS)
    return L.class_losses(p).select("n", "zero_one")


def cross_entropy(spark, root):
    p = L.class_probabilities(_data(spark, root), _weights(spark), CLASSES, DIMS)
    return L.class_losses(p).select(r("cross_entropy").alias("cross_entropy"))


def accuracy_topk(spark, root):
    p = L.class_probabilities(_data(spark, root), _weights(spark), CLASSES, DIMS)
    return L.top_k_accuracy(p, 3).select("n", r("accuracy").alias("accuracy"))


def binary_losses(spark, root):
    return L.binary_losses(L.binary_probability(_binary(spark, root), _binary_weights(spark), DIMS)).select("n", "zero_one", r("log_loss").alias("log_loss"))


def l2_reg(spark, root):
    return L.l2_penalty(_binary_weights(spark), 0.01).select(r("penalty").alias("penalty"))


def hinge(spark, root):
    p = L.binary_margin(_binary(spark, root), _binary_weights(spark), DIMS)
    return p.agg(r(F.avg(F.greatest(F.lit(0.0), 1 - F.col("margin")))).alias("l1"), r(F.avg(F.pow(F.greatest(F.lit(0.0), 1 - F.col("margin")), 2))).alias("l2"))


def mf_squared_loss(spark, root):
    x, left, right = M.fixed_problem(_coo(spark, root))
    return M.losses(x, left, right, 0.05).select("n", r("squared", 4).alias("squared"))


def mf_objective(spark, root):
    x, left, right = M.fixed_problem(_coo(spark, root))
    return M.losses(x, left, right, 0.05).select(r("objective", 4).alias("objective"))


QUERIES = {
    q.__name__: q
    for q in (predict_classes, argmax_class, zero_one_loss, cross_entropy, accuracy_topk, binary_losses, l2_reg, hinge, mf_squared_loss, mf_objective)
}

_P = f"""{EMB_SQL}, s AS (SELECT vec_id AS id, any_value(label) AS y, k, sum(x * ((k * 13 + fid * 7) % 11 - 5) / 2.0) AS z FROM emb, range(0, 10) t(k) GROUP BY vec_id, k),
    t AS (SELECT id, y, k, CASE WHEN abs(z) < 1e-15 THEN 1e-15 ELSE z END AS z FROM s),
    l AS (SELECT id, ln(sum(exp(z))) AS lse FROM t GROUP BY 1),
    p AS (SELECT id, y, k, least(exp(z - lse), 1.0) AS p FROM t JOIN l USING (id)),
    b AS (SELECT id, any_value(y) AS y, arg_max(k, ROW(p, -k)) AS best FROM p GROUP BY 1)"""
_B = f"""{EMB_SQL}, m AS (SELECT vec_id AS id, CAST(any_value(label) >= 5 AS INT) AS y, sum(x * ((13 + fid * 7) % 11 - 5) / 2.0) AS z FROM emb GROUP BY 1), q AS (SELECT id, y, z, 1 / (1 + exp(-z)) AS p FROM m)"""
_MF = """c AS (SELECT CAST(l_partkey AS INT) AS i, CAST(l_suppkey AS INT) AS j, avg(l_quantity) AS x FROM lineitem GROUP BY 1, 2),
    f AS (SELECT i, j, x, list_sum(list_transform(range(0, 4), lambda k: (((i * 3 + k) % 7) / 7.0) * (((j * 5 + k) % 9) / 9.0))) AS z FROM c),
    lr AS (SELECT (SELECT sum(pow(((i * 3 + k) % 7) / 7.0, 2)) FROM (SELECT DISTINCT i FROM c), range(0, 4) t(k)) + (SELECT sum(pow(((j * 5 + k) % 9) / 9.0, 2)) FROM (SELECT DISTINCT j FROM c), range(0, 4) t(k)) AS reg)"""

ORACLE = {
    "predict_classes": f"WITH {_P} SELECT id, CAST(k AS INT) AS k, round(p, 8) + 0.0 AS p FROM p",
    "argmax_class": f"WITH {_P} SELECT id, CAST(best AS INT) AS predicted FROM b",
    "zero_one_loss": f"WITH {_P} SELECT count(*) AS n, CAST(sum(CASE WHEN best <> y THEN 1 ELSE 0 END) AS BIGINT) AS zero_one FROM b",
    "cross_entropy": f"WITH {_P} SELECT round(avg(-ln(CASE WHEN abs(p) < 1e-15 THEN 1e-15 ELSE p END)), 6) + 0.0 AS cross_entropy FROM p WHERE k = y",
    "accuracy_topk": f"WITH {_P}, o AS (SELECT id, y, k, row_number() OVER (PARTITION BY id ORDER BY p DESC, k) AS rn FROM p) SELECT count(DISTINCT id) AS n, round(sum(CASE WHEN k = y AND rn <= 3 THEN 1.0 ELSE 0 END) / count(DISTINCT id), 6) + 0.0 AS accuracy FROM o",
    "binary_losses": f"WITH {_B} SELECT count(*) AS n, CAST(sum(CASE WHEN (CASE WHEN y = 1 THEN p ELSE 1 - p END) >= 0.5 AND p <> 0.5 THEN 0 ELSE 1 END) AS BIGINT) AS zero_one, round(avg(-ln(CASE WHEN y = 1 THEN p ELSE 1 - p END)), 6) + 0.0 AS log_loss FROM q",
    "l2_reg": "SELECT round(sum(w * w) * 0.005, 6) + 0.0 AS penalty FROM (SELECT ((13 + f * 7) % 11 - 5) / 2.0 AS w FROM range(0, 64) t(f))",
    "hinge": f"WITH {_B} SELECT round(avg(greatest(0.0, 1 - z * (2 * y - 1))), 6) + 0.0 AS l1, round(avg(pow(greatest(0.0, 1 - z * (2 * y - 1)), 2)), 6) + 0.0 AS l2 FROM q",
    "mf_squared_loss": f"WITH {_MF} SELECT count(*) AS n, round(sum(pow(x - z, 2)), 4) + 0.0 AS squared FROM f",
    "mf_objective": f"WITH {_MF} SELECT round(sum(pow(x - z, 2)) + 0.05 * any_value(reg), 4) + 0.0 AS objective FROM f, lr",
}
