"""Matrix factorisation by stochastic gradient descent on sparse entries.

Entries are ``(i, j, x)``; factors ``(i, l)`` and ``(j, r)`` with arrays of
``rank`` values. Both sides can be larger than memory: entries meet factors
through joins, which adaptive execution turns into broadcasts where a side is
small by its measured size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import vec
from tidemark.runtime import hash_unit, staged


def fixed_problem(coo: DataFrame, rank: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries with factors that follow from the ids alone."""
    k = F.sequence(F.lit(0), F.lit(rank - 1))
    left = coo.select("i").distinct().select("i", F.transform(k, lambda k: ((F.col("i") * 3 + k) % 7) / F.lit(7.0)).alias("l"))
    right = coo.select("j").distinct().select("j", F.transform(k, lambda k: ((F.col("j") * 5 + k) % 9) / F.lit(9.0)).alias("r"))
    return coo, left, right


def random_factors(coo: DataFrame, rank: int, scale: float = 1.0, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Factors uniform in ±scale/rank, from ids and seed."""
    k = F.sequence(F.lit(0), F.lit(rank - 1))
    draw = lambda c: F.transform(k, lambda q: (2 * hash_unit(F.col(c), q, seed=seed) - 1) * F.lit(scale / rank))
    return coo.select("i").distinct().select("i", draw("i").alias("l")), coo.select("j").distinct().select("j", draw("j").alias("r"))


def with_factors(coo: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Entries with both factors and the residual ``e = x − l·r``."""
    return coo.join(left, "i").join(right, "j").withColumn("e", F.col("x") - vec.dot("l", "r"))


def losses(coo: DataFrame, left: DataFrame, right: DataFrame, lam: float) -> DataFrame:
    """``n, squared, objective``: squared loss, and with λ(Σ‖l‖² + Σ‖r‖²)."""
    fit = with_factors(coo, left, right).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("e") * F.col("e")), F.lit(0.0)).alias("squared"))
    norm = lambda df, c: df.agg(F.coalesce(F.sum(vec.dot(c, c)), F.lit(0.0)).alias(f"norm_{c}"))
    one = fit.crossJoin(norm(left, "l")).crossJoin(norm(right, "r"))  # one row each
    return one.select("n", "squared", (F.col("squared") + lam * (F.col("norm_l") + F.col("norm_r"))).alias("objective"))


def _mean_change(df: DataFrame, key: str, own: str, other: str, lam: float, eta: Column) -> DataFrame:
    """Per row of one side, the summed change 2η(e·other − λ·own) over its entries, by positions."""
    change = F.zip_with(vec.doubles(other), vec.doubles(own), lambda o, w: 2 * eta * (F.col("e") * o - lam * w))
    cells = df.select(key, F.posexplode(change).alias("k", "d"))
    sums = cells.groupBy(key, "k").agg(F.sum("d").alias("d"))
    return sums.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("k", "d"))).alias("c")).select(key, F.col("c.d").alias("change"))


def step(coo: DataFrame, left: DataFrame, right: DataFrame, eta: float, lam: float) -> tuple[DataFrame, DataFrame]:
    """One pass over all entries; every change uses the factors from before the pass (Jacobi).

    An entry changes its row by 2η(e·r − λ·l) and its column by 2η(e·l − λ·r),
    the latter from the row's old value too.
    """
    f = with_factors(coo, left, right)
    dl = _mean_change(f, "i", "l", "r", lam, F.lit(eta))
    dr = _mean_change(f, "j", "r", "l", lam, F.lit(eta))
    add = lambda df, d, key, c: df.join(d, key, "left").select(key, F.coalesce(F.zip_with(vec.doubles(c), "change", lambda a, b: a + b), vec.doubles(c)).alias(c))
    return add(left, dl, "i", "l"), add(right, dr, "j", "r")


def split_step(coo: DataFrame, left: DataFrame, right: DataFrame, eta: float, lam: float) -> tuple[DataFrame, DataFrame]:
    """As :func:`step`, but rows move first and columns' changes use the new rows, as where rows live with their entries."""
    f = with_factors(coo, left, right)
    dl = _mean_change(f, "i", "l", "r", lam, F.lit(eta))
    new_left = staged(left.join(dl, "i", "left").select("i", F.coalesce(F.zip_with(vec.doubles("l"), "change", lambda a, b: a + b), vec.doubles("l")).alias("l")), "left")
    g = with_factors(coo, new_left, right)
    dr = _mean_change(g, "j", "r", "l", lam, F.lit(eta))
    return new_left, right.join(dr, "j", "left").select("j", F.coalesce(F.zip_with(vec.doubles("r"), "change", lambda a, b: a + b), vec.doubles("r")).alias("r"))


def train(coo: DataFrame, rank: int, iterations: int, eta: float, lam: float, seed: int = 1, rows_first: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Iterations with rate η·(100 + t)^−½·10; returns both factors and ``iteration, n, squared, objective``."""
    spark = coo.sparkSession
    x = staged(coo.select("i", "j", F.col("x").cast("double").alias("x")), "entries")
    left, right = (staged(f, "factors") for f in random_factors(x, rank, float(rank), seed))
    history = []
    for t in range(iterations):
        rate = eta * 10 * (100 + t) ** -0.5
        left, right = (staged(f, "factors") for f in (split_step if rows_first else step)(x, left, right, rate, lam))
        row = losses(x, left, right, lam).first()
        history.append((t, row.n, row.squared, row.objective))
    return left, right, spark.createDataFrame(history, "iteration int, n bigint, squared double, objective double")
