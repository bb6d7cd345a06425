"""Vector and scalar functions as built-in column expressions (double arithmetic inside)."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: values nearer to zero than this are taken as this.
TINY = 1e-15


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def doubles(v: Column | str) -> Column:
    return _c(v).cast("array<double>")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(v: Column) -> Column:
    """Sum of an array of doubles; null elements count as 0."""
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def dot(a: Column | str, b: Column | str) -> Column:
    """Dense · dense. Null if either is null or the lengths differ."""
    x, y = doubles(a), doubles(b)
    return F.when(F.size(x) == F.size(y), total(F.zip_with(x, y, lambda p, q: p * q)))


def dot_sparse_dense(ids: Column | str, values: Column | str, dense: Column | str) -> Column:
    """Sparse (zero-based ids, values) · dense; ids beyond the dense vector add nothing."""
    d = doubles(dense)
    return total(F.zip_with(_c(ids), doubles(values), lambda i, v: v * F.coalesce(F.get(d, i.cast("int")), F.lit(0.0))))


def dot_sparse_sparse(ids_a: Column | str, vals_a: Column | str, ids_b: Column | str, vals_b: Column | str) -> Column:
    """Sparse · sparse within one row; ids need no order but must not repeat."""
    other = F.map_from_arrays(_c(ids_b), doubles(vals_b))
    return total(F.zip_with(_c(ids_a), doubles(vals_a), lambda i, v: v * F.coalesce(F.try_element_at(other, i), F.lit(0.0))))


def axpy(alpha: Column | float, x: Column | str, y: Column | str) -> Column:
    """``y + alpha * x`` for dense vectors of one length."""
    a = F.lit(float(alpha)) if isinstance(alpha, (int, float)) else alpha
    return F.zip_with(doubles(x), doubles(y), lambda p, q: q + a * p)


def safe_log(x: Column | str) -> Column:
    """Natural logarithm; an argument within 1e-15 of zero counts as 1e-15."""
    v = _c(x).cast("double")
    return F.ln(F.when(F.abs(v) < TINY, TINY).otherwise(v))


def sigmoid(x: Column | str) -> Column:
    return 1 / (1 + F.exp(-_c(x).cast("double")))


def log_sum(a: Column | str, b: Column | str) -> Column:
    """log(e^a + e^b) without overflow."""
    x, y = _c(a).cast("double"), _c(b).cast("double")
    return F.greatest(x, y) + F.log1p(F.exp(F.least(x, y) - F.greatest(x, y)))


def log_sum_vec(v: Column | str) -> Column:
    """log of the sum of exponentials of an array; null if it is empty."""
    return let(doubles(v), lambda x: let(F.array_max(x), lambda top: top + F.ln(total(F.transform(x, lambda e: F.exp(e - top))))))


def softmax(v: Column | str) -> Column:
    """Softmax; entries within 1e-15 of zero count as 1e-15, results are at most 1."""
    x = F.transform(doubles(v), lambda e: F.when(F.abs(e) < TINY, TINY).otherwise(e))
    return let(x, lambda z: let(log_sum_vec(z), lambda lse: F.transform(z, lambda e: F.least(F.exp(e - lse), F.lit(1.0)))))


def argmax(v: Column | str) -> Column:
    """Zero-based place of the first largest element; null for an empty array."""
    x = doubles(v)
    return F.when(F.size(x) > 0, (F.array_position(x, F.array_max(x)) - 1).cast("int"))


def soft_threshold(x: Column | str, t: float) -> Column:
    """sign(x) · max(|x| − t, 0)."""
    v = _c(x).cast("double")
    return F.when(v > t, v - t).when(v < -t, v + t).when(v.isNotNull(), F.lit(0.0))


def l2_project(v: Column | str, c: float) -> Column:
    """Scale by √(c / Σx²) if the squared norm is over ``c``."""

    def scaled(x: Column) -> Column:
        norm = total(F.transform(x, lambda e: e * e))
        return let(F.when(norm > c, F.sqrt(F.lit(float(c)) / norm)).otherwise(1.0), lambda s: F.transform(x, lambda e: e * s))

    return let(doubles(v), scaled)


def lazy_decay(w: Column | str, rate: float, clock: Column | str, last: Column | str) -> Column:
    """``w`` decayed once for each clock since it was last touched."""
    return _c(w).cast("double") * F.pow(F.lit(float(rate)), (_c(clock) - _c(last)).cast("double"))


#: By so many unit steps arguments are raised before the asymptotic series of ln Γ and of its derivative are used.
_STEPS = 8


def ln_gamma(x: Column | str) -> Column:
    """ln Γ(x) for x > 0, to about twelve digits; null elsewhere."""
    v = _c(x).cast("double")
    z = v + _STEPS
    series = (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * F.pow(z, 3)) + 1 / (1260 * F.pow(z, 5)) - 1 / (1680 * F.pow(z, 7))
    return F.when(v > 0, functools.reduce(lambda s, k: s - F.ln(v + k), range(_STEPS), series))


def digamma(x: Column | str) -> Column:
    """The derivative of ln Γ for x > 0; null elsewhere."""
    v = _c(x).cast("double")
    z = v + _STEPS
    series = F.ln(z) - 1 / (2 * z) - 1 / (12 * z * z) + 1 / (120 * F.pow(z, 4)) - 1 / (252 * F.pow(z, 6)) + 1 / (240 * F.pow(z, 8))
    return F.when(v > 0, functools.reduce(lambda s, k: s - 1 / (v + k), range(_STEPS), series))


def log_rising(n: Column | str, a: float) -> Column:
    """lnΓ(n + a) − lnΓ(a) for a whole number n ≥ 0, in constant time; 0 for n ≤ 0."""
    k = _c(n).cast("double")
    return F.when(k > 0, ln_gamma(k + float(a)) - math.lgamma(a)).otherwise(0.0)


def not_nan(x: Column | str, what: str) -> Column:
    """The value; a NaN stops the query with a message."""
    v = _c(x).cast("double")
    return F.when(F.isnan(v), F.raise_error(F.lit(f"{what} is NaN")).cast("double")).otherwise(v)


def clip(x: Column | str, low: float, high: float) -> Column:
    v = _c(x).cast("double")
    return F.least(F.greatest(v, F.lit(float(low))), F.lit(float(high)))


def to_text(v: Column | str, sep: str = " ") -> Column:
    """Elements each followed by ``sep``, as text files of vectors have them."""
    return F.concat(F.array_join(_c(v).cast("array<string>"), sep), F.lit(sep))


def server_of_row(row: Column | str, channels: int, clients: int) -> Column:
    """Channel ``row mod C`` and client ``(row div C) mod N`` that hold a row."""
    r = _c(row)
    return F.struct(F.pmod(r, F.lit(channels)).cast("int").alias("channel"), F.pmod(F.floor(r / channels), F.lit(clients)).cast("int").alias("client"))
