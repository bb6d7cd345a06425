"""Queries on adaptive step sizes, and single steps of models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.models import logreg as L
from tidemark.models import matfact as M
from tidemark.operators import optim as O
from tidemark.plans.common import EMB_SQL, r
from tidemark.plans.etl import _COO, _coo
from tidemark.plans.losses import _B, _P, CLASSES, DIMS, _binary, _binary_weights, _data, _weights
from tidemark.runtime import table


def _gradients(spark, root):
    """Each feature's values in the order of the vectors, as a stream of gradients."""
    e = table(spark, root, "embeddings").select("label", F.col("vec_id").alias("seq"), F.posexplode("embedding").alias("col_id", "g"))
    return e.select(F.col("label").alias("row_id"), "col_id", "seq", F.col("g").cast("double").alias("g"))


def adagrad_window(spark, root):
    a = O.adagrad(_gradients(spark, root), 0.1)
    return a.select("row_id", "col_id", "seq", r("h").alias("h"), r("step").alias("step"), r("value").alias("value"))


def adagrad_from_one(spark, root):
    a = O.adagrad(_gradients(spark, root), 0.1, start=1.0)
    return a.groupBy("row_id", "col_id").agg(r(F.max_by("value", "seq")).alias("value"))


def adarevision_window(spark, root):
    a = O.adarevision(_gradients(spark, root), 0.1, lag=2)
    return a.select("row_id", "col_id", "seq", r("z").alias("z"), r("zmax").alias("zmax"), r("step").alias("step"), r("value").alias("value"))


def adarevision_fresh(spark, root):
    """Without delay it is AdaGrad with an accumulator that begins at 1."""
    a = O.adarevision(_gradients(spark, root), 0.1)
    return a.groupBy("row_id", "col_id").agg(r(F.max_by("value", "seq")).alias("value"))


def step_sizes(spark, root):
    t = F.col("id")
    return spark.range(200).select(
        t.alias("t"), r(O.inverse_root(0.1, t), 8).alias("inverse_root"), r(O.geometric(0.1, 0.995, t), 8).alias("geometric"), r(O.inverse_power(0.1, 10, 0.6, t), 8).alias("inverse_power"),
        r(O.policy_rate("step", 0.01, 0.1, t, step=50), 8).alias("step"), r(O.policy_rate("exp", 0.01, 0.99, t), 8).alias("exp"), r(O.policy_rate("inv", 0.01, 0.0001, t, power=0.75), 8).alias("inv"),
    )


def momentum_fold(spark, root):
    g = table(spark, root, "embeddings")
    return g.select("vec_id", r(O.momentum(F.col("embedding"), 0.9, 0.1)).alias("h"))


def one_sgd_step(spark, root):
    w = L.binary_step(_binary(spark, root), _binary_weights(spark), DIMS, 0.01, 0.001)
    return w.select("fid", r("w").alias("w"))


def one_mlr_step(spark, root):
    w = L.class_step(_data(spark, root), _weights(spark), CLASSES, DIMS, 0.5)
    return w.select("k", "fid", r("w").alias("w"))


def one_mf_step(spark, root):
    x, left, right = M.fixed_problem(_coo(spark, root))
    new, _ = M.step(x, left, right, 0.001, 0.05)
    return new.select("i", F.posexplode("l").alias("k", "l")).select("i", "k", r("l").alias("l"))


def one_mf_split_step(spark, root):
    """Columns after a step in which rows moved first."""
    x, left, right = M.fixed_problem(_coo(spark, root))
    _, new = M.split_step(x, left, right, 0.001, 0.05)
    return new.select("j", F.posexplode("r").alias("k", "r")).select("j", "k", r("r").alias("r"))


QUERIES = {
    q.__name__: q
    for q in (adagrad_window, adagrad_from_one, adarevision_window, adarevision_fresh, step_sizes, momentum_fold, one_sgd_step, one_mlr_step, one_mf_step, one_mf_split_step)
}

_G = f"{EMB_SQL}, g AS (SELECT label AS row_id, fid AS col_id, vec_id AS seq, x AS g FROM emb)"
_W = "PARTITION BY row_id, col_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND"


def _ada(start: int) -> str:
    return f"""{_G}, h AS (SELECT *, {start} + sum(g * g) OVER ({_W} CURRENT ROW) AS h FROM g), s AS (SELECT *, CASE WHEN h > 0 THEN -0.1 * g / sqrt(h) ELSE 0 END AS step FROM h),
        v AS (SELECT *, sum(step) OVER ({_W} CURRENT ROW) AS value FROM s)"""


def _rev(lag: int) -> str:
    seen = "b" if not lag else f"coalesce(sum(g) OVER ({_W} {1 + lag} PRECEDING), 0)"
    return f"""{_G}, b AS (SELECT *, coalesce(sum(g) OVER ({_W} 1 PRECEDING), 0) AS b FROM g), u AS (SELECT *, b - {seen} AS u FROM b),
        z AS (SELECT *, 1 + sum(g * (g + 2 * u)) OVER ({_W} CURRENT ROW) AS z FROM u),
        m AS (SELECT *, greatest(1.0, max(z) OVER ({_W} CURRENT ROW)) AS zmax, greatest(1.0, coalesce(max(z) OVER ({_W} 1 PRECEDING), 1.0)) AS zold FROM z),
        s AS (SELECT *, -0.1 / sqrt(zmax) * g + (0.1 / sqrt(zold) - 0.1 / sqrt(zmax)) * u AS step FROM m),
        v AS (SELECT *, sum(step) OVER ({_W} CURRENT ROW) AS value FROM s)"""


_MFS = f"""{_COO}, L AS (SELECT i, CAST(k AS INT) AS k, ((i * 3 + k) % 7) / 7.0 AS l FROM (SELECT DISTINCT i FROM c), range(0, 4) t(k)),
    R AS (SELECT j, CAST(k AS INT) AS k, ((j * 5 + k) % 9) / 9.0 AS r FROM (SELECT DISTINCT j FROM c), range(0, 4) t(k)),
    e AS (SELECT i, j, any_value(x) - sum(l * r) AS e FROM c JOIN L USING (i) JOIN R USING (j, k) GROUP BY i, j),
    NL AS (SELECT i, k, any_value(l) + sum(2 * 0.001 * (e * r - 0.05 * l)) AS l FROM e JOIN L USING (i) JOIN R USING (j, k) GROUP BY i, k)"""

ORACLE = {
    "adagrad_window": f"WITH {_ada(0)} SELECT row_id, col_id, seq, round(h, 6) + 0.0 AS h, round(step, 6) + 0.0 AS step, round(value, 6) + 0.0 AS value FROM v",
    "adagrad_from_one": f"WITH {_ada(1)} SELECT row_id, col_id, round(arg_max(value, seq), 6) + 0.0 AS value FROM v GROUP BY 1, 2",
    "adarevision_window": f"WITH {_rev(2)} SELECT row_id, col_id, seq, round(z, 6) + 0.0 AS z, round(zmax, 6) + 0.0 AS zmax, round(step, 6) + 0.0 AS step, round(value, 6) + 0.0 AS value FROM v",
    "adarevision_fresh": f"WITH {_rev(0)} SELECT row_id, col_id, round(arg_max(value, seq), 6) + 0.0 AS value FROM v GROUP BY 1, 2",
    "step_sizes": """SELECT t, round(0.1 * pow(100 + t, -0.5), 8) + 0.0 AS inverse_root, round(0.1 * pow(0.995, t), 8) + 0.0 AS geometric, round(0.1 * pow(t + 10, -0.6), 8) + 0.0 AS inverse_power,
        round(0.01 * pow(0.1, t // 50), 8) + 0.0 AS step, round(0.01 * pow(0.99, t), 8) + 0.0 AS exp, round(0.01 * pow(1 + 0.0001 * t, -0.75), 8) + 0.0 AS inv FROM range(0, 200) r(t)""",
    "momentum_fold": f"WITH {EMB_SQL} SELECT vec_id, round(sum(0.1 * x * pow(0.9, 63 - fid)), 6) + 0.0 AS h FROM emb GROUP BY 1",
    "one_sgd_step": f"""WITH {_B}, w AS (SELECT CAST(f AS INT) AS fid, ((13 + f * 7) % 11 - 5) / 2.0 AS w FROM range(0, 64) t(f)),
        g AS (SELECT fid, sum((p - y) * x) AS g, count(*) AS n FROM emb JOIN q ON q.id = emb.vec_id WHERE x <> 0 GROUP BY 1)
        SELECT fid, round(w - 0.01 * (coalesce(g, 0) + 0.001 * coalesce(n, 0) * w), 6) + 0.0 AS w FROM w LEFT JOIN g USING (fid)""",
    "one_mlr_step": f"""WITH {_P}, g AS (SELECT CAST(k AS INT) AS k, fid, sum((p - CASE WHEN k = y THEN 1 ELSE 0 END) * x) AS g FROM p JOIN emb ON emb.vec_id = p.id GROUP BY 1, 2)
        SELECT k, fid, round(((k * 13 + fid * 7) % 11 - 5) / 2.0 - 0.5 * g / (SELECT count(*) FROM embeddings), 6) + 0.0 AS w FROM g""",
    "one_mf_step": f"WITH {_MFS} SELECT i, k, round(l, 6) + 0.0 AS l FROM NL",
    "one_mf_split_step": f"""WITH {_MFS}, e2 AS (SELECT i, j, any_value(x) - sum(NL.l * r) AS e FROM c JOIN NL USING (i) JOIN R USING (j, k) GROUP BY i, j)
        SELECT j, k, round(any_value(r) + sum(2 * 0.001 * (e * l - 0.05 * r)), 6) + 0.0 AS r FROM e2 JOIN NL USING (i) JOIN R USING (j, k) GROUP BY j, k""",
}
