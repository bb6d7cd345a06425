"""Importance of pending rows, and which of them go first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.runtime import text_unit

POLICIES = ("fifo", "random", "relative_magnitude", "fifo_n_remag", "fixed_order")
# The flag's spellings of the policies.
POLICY_FLAGS = {"FIFO": "fifo", "Random": "random", "RelativeMagnitude": "relative_magnitude", "FIFO_N_RegMag": "fifo_n_remag", "FIFO_N_ReMag": "fifo_n_remag", "FixedOrder": "fixed_order"}


def magnitude(delta: Column | str) -> Column:
    """Importance of one increment: its absolute value."""
    return F.abs(F.col(delta) if isinstance(delta, str) else delta)


def relative_magnitude(delta: Column, value: Column) -> Column:
    """Importance against the value before the increment: |delta / value|, or |delta| where that is 0."""
    v = F.coalesce(value, F.lit(0.0))
    return F.abs(F.when(v == 0, delta).otherwise(delta / v))


def pending_rows(deltas: DataFrame, importance: Column | None = None) -> DataFrame:
    """``row_id, importance, min_clock, n``: merged pending rows; importance adds up, the earliest clock stays."""
    imp = magnitude("delta") if importance is None else importance
    clock = F.min("clock") if "clock" in deltas.columns else F.lit(0)
    return deltas.groupBy("row_id").agg(F.sum(imp).alias("importance"), clock.cast("int").alias("min_clock"), F.count(F.lit(1)).alias("n"))


def order_of(policy: str, cursor: int = 0, n_rows: int = 1, seed: int = 0) -> list[Column]:
    """Sort keys of a policy; the row id breaks every tie."""
    if policy == "fifo":
        return [F.asc("min_clock"), F.asc("row_id")]
    if policy == "random":
        return [text_unit("row_id", seed=seed).asc(), F.asc("row_id")]
    if policy in ("relative_magnitude", "fifo_n_remag"):
        return [F.desc("importance"), F.asc("row_id")]
    if policy == "fixed_order":
        return [F.pmod(F.col("row_id") - cursor, F.lit(n_rows)).asc(), F.asc("row_id")]
    raise ValueError(f"no policy {policy!r}")


def top_rows(pending: DataFrame, k: int, policy: str = "relative_magnitude", **options) -> DataFrame:
    """The first ``k`` rows by a policy: per-task heaps and one merge, never a full sort."""
    return pending.orderBy(*order_of(policy, **options)).limit(k)


def up_to_clock_then_top(pending: DataFrame, clock: int, capacity: int, policy: str = "relative_magnitude", **options) -> DataFrame:
    """All rows pending since ``clock`` or before; then, up to ``capacity`` rows in all, more by the policy."""
    due = pending.where(F.col("min_clock") <= clock).withColumn("due", F.lit(True))
    rest = pending.where(F.col("min_clock") > clock).withColumn("due", F.lit(False))
    room = due.agg(F.greatest(F.lit(0), F.lit(capacity) - F.count(F.lit(1))).alias("room"))
    best = rest.orderBy(*order_of(policy, **options)).limit(capacity)
    w = W.orderBy(*order_of(policy, **options))  # over at most ``capacity`` rows
    fill = best.withColumn("rn", F.row_number().over(w)).join(F.broadcast(room)).where("rn <= room").drop("rn", "room")
    return due.unionByName(fill)


def candidate_top(pending: DataFrame, k: int, factor: float, total: int | None = None, seed: int = 0) -> DataFrame:
    """Approximate top-k: of an independent sample with probability min(1, k · factor / total), the most important k.

    ``total`` is the number of pending rows; None counts them, inside the plan.
    The draw depends on the row id and the seed alone, so it can be repeated.
    """
    unit = text_unit("row_id", seed=seed)
    if total is not None:
        return top_rows(pending.where(unit < min(1.0, k * factor / max(total, 1))), k)
    counted = pending.agg((F.lit(float(k * factor)) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("__rate"))
    return top_rows(pending.crossJoin(F.broadcast(counted)).where(unit < F.col("__rate")).drop("__rate"), k)


def merge_pending(a: DataFrame, b: DataFrame, keep_min: bool = True) -> DataFrame:
    """Two sets of pending rows in one: importance and counts add up; the clock is the least, or else the newer set's."""
    both = a.withColumn("__new", F.lit(0)).unionByName(b.withColumn("__new", F.lit(1)))
    clock = F.min("min_clock") if keep_min else F.max_by("min_clock", "__new")
    return both.groupBy("row_id").agg(F.sum("importance").alias("importance"), clock.alias("min_clock"), F.sum("n").alias("n"))


def dirty_subscribed(deltas: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Changed rows (with a non-zero sum in some cell) that some client reads, with their importance."""
    dirty = deltas.groupBy("row_id", "col_id").agg(F.sum("delta").alias("delta")).where("delta <> 0")
    return dirty.join(subscriptions.select("row_id").distinct(), "row_id", "left_semi").groupBy("row_id").agg(F.sum(F.abs("delta")).alias("importance"))
