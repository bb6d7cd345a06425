"""Queries on vector and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import vec
from tidemark.operators.deltas import dense_batch_inc
from tidemark.plans.common import EMB_SQL, EVENT_SQL, event_log, r
from tidemark.runtime import table


def _pairs(spark, root):
    """Each vector beside the one that follows it by id."""
    e = table(spark, root, "embeddings")
    a = e.select("vec_id", "label", F.col("embedding").alias("a"))
    return a.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")


def _weights(i):
    """Fixed weights of a feature, from its number alone."""
    return ((i * 7) % 11 - 5).cast("double") / 10


def dot_dense(spark, root):
    return _pairs(spark, root).select("vec_id", r(vec.dot("a", "b")).alias("dot"))


def dot_sparse_dense(spark, root):
    """Only entries above 0.1 of the first vector."""
    p = _pairs(spark, root)
    ids = F.filter(F.sequence(F.lit(0), F.size("a") - 1), lambda i: F.get("a", i) > F.lit(0.1).cast("double"))
    p = p.withColumn("ids", ids)
    p = p.withColumn("vals", F.transform("ids", lambda i: F.get("a", i)))
    return p.select("vec_id", r(vec.dot_sparse_dense("ids", "vals", "b")).alias("dot"))


def dot_sparse_sparse(spark, root):
    """Entries above 0.1 of the first and below −0.1 of the second vector, through a join on the feature."""
    e = table(spark, root, "embeddings")
    x = e.select("vec_id", F.posexplode("embedding").alias("fid", "x"))
    a = x.where(F.col("x").cast("double") > 0.1)
    b = x.where(F.col("x").cast("double") < -0.1).select((F.col("vec_id") - 1).alias("vec_id"), "fid", F.col("x").alias("y"))
    j = a.join(b, ["vec_id", "fid"])
    return j.groupBy("vec_id").agg(r(F.sum(F.col("x").cast("double") * F.col("y").cast("double"))).alias("dot"))


def axpy(spark, root):
    p = _pairs(spark, root).select("vec_id", F.posexplode(vec.axpy(10.0, "a", "b")).alias("fid", "value"))
    return p.select("vec_id", "fid", r("value").alias("value"))


def softmax(spark, root):
    e = table(spark, root, "embeddings")
    s = e.select("vec_id", F.posexplode(vec.softmax("embedding")).alias("fid", "p"))
    return s.select("vec_id", "fid", r("p", 8).alias("p"))


def logsumexp(spark, root):
    return table(spark, root, "embeddings").select("vec_id", r(vec.log_sum_vec("embedding")).alias("lse"))


def log_sum_pair(spark, root):
    p = _pairs(spark, root)
    return p.select("vec_id", r(vec.log_sum(F.get("a", F.lit(0)), F.get("b", F.lit(0)))).alias("lse"))


def sigmoid(spark, root):
    e = table(spark, root, "embeddings")
    return e.select("vec_id", r(vec.sigmoid(F.get("embedding", F.lit(0)))).alias("p"))


def safe_log(spark, root):
    e = table(spark, root, "lineitem")
    return e.groupBy("l_discount").agg(r(F.first(vec.safe_log("l_discount"))).alias("log"))


def argmax(spark, root):
    return table(spark, root, "embeddings").select("vec_id", vec.argmax("embedding").alias("place"))


def soft_threshold(spark, root):
    e = table(spark, root, "embeddings").select("vec_id", F.posexplode("embedding").alias("fid", "x"))
    return e.select("vec_id", "fid", r(vec.soft_threshold("x", 0.05)).alias("value"))


def l2_project(spark, root):
    e = table(spark, root, "embeddings")
    s = e.select("vec_id", F.posexplode(vec.l2_project("embedding", 0.5)).alias("fid", "value"))
    return s.select("vec_id", "fid", r("value").alias("value"))


def lazy_decay(spark, root):
    """Event values decayed by 0.9 a day until day 30."""
    e = event_log(spark, root)
    return e.select("seq", r(vec.lazy_decay("delta", 0.9, F.lit(30), "clock")).alias("value"))


def rising_log(spark, root):
    """lnΓ(n + 0.7) − lnΓ(0.7) of the number of lines of each order."""
    n = table(spark, root, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return n.select("l_orderkey", r(vec.log_rising("n", 0.7)).alias("value"))


def clip(spark, root):
    o = table(spark, root, "orders")
    return o.select("o_orderkey", r(vec.clip("o_totalprice", 50000, 100000), 2).alias("value"))


def hyperbolic(spark, root):
    e = table(spark, root, "embeddings").select("vec_id", F.posexplode("embedding").alias("fid", "v")).withColumn("x", F.col("v").cast("double"))
    return e.select("vec_id", "fid", r(F.sinh("x")).alias("sinh"), r(F.cosh("x")).alias("cosh"), r(F.tanh("x")).alias("tanh"), r(F.exp("x")).alias("exp"), r(F.pow(F.lit(2.0), "x")).alias("pow2"), r(F.log2(F.abs("x") + 1)).alias("log2"))


def linear_score(spark, root):
    """Weighted sum of all features, by a join on the feature id."""
    d = dense_batch_inc(table(spark, root, "embeddings"), "vec_id", "embedding")
    w = spark.range(64).select(F.col("id").cast("int").alias("col_id"), _weights(F.col("id")).alias("w"))
    return d.join(F.broadcast(w), "col_id").groupBy("row_id").agg(r(F.sum(F.col("delta") * F.col("w"))).alias("score"))


def one_based(spark, root):
    li = table(spark, root, "lineitem")
    return li.groupBy((F.col("l_linenumber") - 1).cast("int").alias("feature")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    q.__name__: q
    for q in (dot_dense, dot_sparse_dense, dot_sparse_sparse, axpy, softmax, logsumexp, log_sum_pair, sigmoid, safe_log, argmax, soft_threshold, l2_project, lazy_decay, rising_log, clip, hyperbolic, linear_score, one_based)
}

_NEXT = "b AS (SELECT vec_id - 1 AS vec_id, fid, x AS y FROM emb)"

ORACLE = {
    "dot_dense": f"WITH {EMB_SQL}, {_NEXT} SELECT vec_id, round(sum(x * y), 6) + 0.0 AS dot FROM emb JOIN b USING (vec_id, fid) GROUP BY 1",
    "dot_sparse_dense": f"WITH {EMB_SQL}, {_NEXT} SELECT vec_id, round(sum(CASE WHEN x > 0.1 THEN x * y ELSE 0 END), 6) + 0.0 AS dot FROM emb JOIN b USING (vec_id, fid) GROUP BY 1",
    "dot_sparse_sparse": f"WITH {EMB_SQL}, {_NEXT} SELECT vec_id, round(sum(x * y), 6) + 0.0 AS dot FROM emb JOIN b USING (vec_id, fid) WHERE x > 0.1 AND y < -0.1 GROUP BY 1",
    "axpy": f"WITH {EMB_SQL}, {_NEXT} SELECT vec_id, fid, round(y + 10.0 * x, 6) + 0.0 AS value FROM emb JOIN b USING (vec_id, fid)",
    "softmax": f"""WITH {EMB_SQL}, c AS (SELECT vec_id, fid, CASE WHEN abs(x) < 1e-15 THEN 1e-15 ELSE x END AS x FROM emb),
        m AS (SELECT vec_id, max(x) AS top FROM c GROUP BY 1), l AS (SELECT vec_id, any_value(top) + ln(sum(exp(x - top))) AS lse FROM c JOIN m USING (vec_id) GROUP BY 1)
        SELECT vec_id, fid, round(least(exp(x - lse), 1.0), 8) + 0.0 AS p FROM c JOIN l USING (vec_id)""",
    "logsumexp": f"WITH {EMB_SQL} SELECT vec_id, round(ln(sum(exp(x))), 6) + 0.0 AS lse FROM emb GROUP BY 1",
    "log_sum_pair": f"WITH {EMB_SQL}, {_NEXT} SELECT vec_id, round(ln(exp(x) + exp(y)), 6) + 0.0 AS lse FROM emb JOIN b USING (vec_id, fid) WHERE fid = 0",
    "sigmoid": "SELECT vec_id, round(1 / (1 + exp(-embedding[1]::DOUBLE)), 6) + 0.0 AS p FROM embeddings",
    "safe_log": "SELECT l_discount, round(ln(CASE WHEN abs(l_discount) < 1e-15 THEN 1e-15 ELSE l_discount END), 6) + 0.0 AS log FROM (SELECT DISTINCT l_discount FROM lineitem)",
    "argmax": f"WITH {EMB_SQL}, m AS (SELECT vec_id, max(x) AS top FROM emb GROUP BY 1) SELECT vec_id, min(fid) AS place FROM emb JOIN m USING (vec_id) WHERE x = top GROUP BY 1",
    "soft_threshold": f"WITH {EMB_SQL} SELECT vec_id, fid, round(sign(x) * greatest(abs(x) - 0.05, 0), 6) + 0.0 AS value FROM emb",
    "l2_project": f"WITH {EMB_SQL}, n AS (SELECT vec_id, sum(x * x) AS s FROM emb GROUP BY 1) SELECT vec_id, fid, round(x * CASE WHEN s > 0.5 THEN sqrt(0.5 / s) ELSE 1 END, 6) + 0.0 AS value FROM emb JOIN n USING (vec_id)",
    "lazy_decay": f"WITH {EVENT_SQL} SELECT seq, round(delta * pow(0.9, 30 - clock), 6) + 0.0 AS value FROM event_log",
    "rising_log": "SELECT l_orderkey, round(lgamma(count(*) + 0.7) - lgamma(0.7), 6) + 0.0 AS value FROM lineitem GROUP BY 1",
    "clip": "SELECT o_orderkey, round(least(greatest(o_totalprice, 50000.0), 100000.0), 2) + 0.0 AS value FROM orders",
    "hyperbolic": f"WITH {EMB_SQL} SELECT vec_id, fid, round(sinh(x), 6) + 0.0 AS sinh, round(cosh(x), 6) + 0.0 AS cosh, round(tanh(x), 6) + 0.0 AS tanh, round(exp(x), 6) + 0.0 AS exp, round(pow(2.0, x), 6) + 0.0 AS pow2, round(log2(abs(x) + 1), 6) + 0.0 AS log2 FROM emb",
    "linear_score": f"WITH {EMB_SQL} SELECT CAST(vec_id AS INT) AS row_id, round(sum(x * (((fid * 7) % 11 - 5) / 10.0)), 6) + 0.0 AS score FROM emb GROUP BY 1",
    "one_based": "SELECT CAST(l_linenumber - 1 AS INT) AS feature, count(*) AS n FROM lineitem GROUP BY 1",
}
