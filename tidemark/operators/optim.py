"""Adaptive step sizes as window programs over ordered gradient streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ("row_id", "col_id")


def adagrad(gradients: DataFrame, eta: float, start: float = 0.0, order: str = "seq", key: tuple[str, ...] = KEY) -> DataFrame:
    """Adds ``h`` (start + running sum of g²), ``step`` = −η·g/√h and ``value`` (running sum of steps).

    With ``start`` 0 the first step is η times the gradient's sign. A zero
    gradient on a cell without history moves nothing.
    """
    w = W.partitionBy(*key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    g = F.col("g").cast("double")
    h = gradients.withColumn("h", F.lit(float(start)) + F.sum(g * g).over(w))
    s = h.withColumn("step", F.when(F.col("h") > 0, -eta * g / F.sqrt("h")).otherwise(0.0))
    return s.withColumn("value", F.sum("step").over(w))


def adarevision(gradients: DataFrame, eta0: float = 0.1, lag: int = 0, order: str = "seq", key: tuple[str, ...] = KEY) -> DataFrame:
    """AdaRevision of gradients ``g`` that were computed ``lag`` updates ago.

    Three stacked windows per cell: the running sum of gradients before an
    update (``before``), what of it the update's worker hadn't seen
    (``unseen``), the running square sum ``z``, its maximum ``zmax`` (both
    begin at 1), and from these the ``step`` and its running sum ``value``.
    A column ``g_old``, if there is one, gives the sum the worker had seen
    instead of the lag.
    """
    w = W.partitionBy(*key).orderBy(order)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    earlier = w.rowsBetween(W.unboundedPreceding, -1)
    g = F.col("g").cast("double")
    df = gradients.withColumn("before", F.coalesce(F.sum(g).over(earlier), F.lit(0.0)))
    if "g_old" in gradients.columns:
        seen = F.coalesce(F.col("g_old"), F.lit(0.0))
    elif lag:
        seen = F.coalesce(F.sum(g).over(w.rowsBetween(W.unboundedPreceding, -1 - lag)), F.lit(0.0))
    else:
        seen = F.col("before")
    df = df.withColumn("unseen", F.col("before") - seen)
    df = df.withColumn("z", 1 + F.sum(g * (g + 2 * F.col("unseen"))).over(upto))
    df = df.withColumn("zmax", F.greatest(F.lit(1.0), F.max("z").over(upto)))
    df = df.withColumn("eta_old", eta0 / F.sqrt(F.greatest(F.lit(1.0), F.coalesce(F.max("z").over(earlier), F.lit(1.0)))))
    eta = eta0 / F.sqrt("zmax")
    df = df.withColumn("step", -eta * g + (F.col("eta_old") - eta) * F.col("unseen"))
    return df.withColumn("value", F.sum("step").over(upto)).drop("eta_old")


def momentum(ordered: Column, mu: float, rate: float) -> Column:
    """History ``h ← μh + rate·g`` folded over an ordered array of gradients."""
    return F.aggregate(ordered.cast("array<double>"), F.lit(0.0), lambda h, g: mu * h + rate * g)


def inverse_root(eta: float, t: Column) -> Column:
    """η·(100 + t)^−½."""
    return eta * F.pow(F.lit(100.0) + t, F.lit(-0.5))


def geometric(eta: float, decay: float, t: Column) -> Column:
    """η·dᵗ."""
    return eta * F.pow(F.lit(float(decay)), t.cast("double"))


def inverse_power(eta: float, offset: float, power: float, t: Column) -> Column:
    """η·(t + o)^−p."""
    return eta * F.pow(t + F.lit(float(offset)), F.lit(-float(power)))


def policy_rate(policy: str, base: float, gamma: float, t: Column, step: int = 1, power: float = 1.0) -> Column:
    """Learning rate of the policies fixed, step, exp and inv at iteration ``t``."""
    x = t.cast("double")
    if policy == "fixed":
        return F.lit(float(base))
    if policy == "step":
        return base * F.pow(F.lit(float(gamma)), F.floor(x / step).cast("double"))
    if policy == "exp":
        return base * F.pow(F.lit(float(gamma)), x)
    if policy == "inv":
        return base * F.pow(1 + gamma * x, F.lit(-float(power)))
    raise ValueError(f"no policy {policy!r}")
