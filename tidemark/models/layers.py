"""Layers of feed-forward networks over array columns and images.

Element-wise and loss layers are column expressions over ``ARRAY`` columns; the
spatial ones (convolution, pooling, local response normalisation, patches) work
on batches of images as arrays inside ``mapInArrow``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.vec import doubles, dot, let, safe_log, softmax, total
from tidemark.runtime import text_unit

# ---- element-wise -----------------------------------------------------------


def absval(v) -> Column:
    return F.transform(doubles(v), F.abs)


def bnll(v) -> Column:
    """log(1 + eˣ), without overflow."""
    return F.transform(doubles(v), lambda x: F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))))


def relu(v, slope: float = 0.0) -> Column:
    return F.transform(doubles(v), lambda x: F.greatest(x, F.lit(0.0)) + slope * F.least(x, F.lit(0.0)))


def sigmoid(v) -> Column:
    return F.transform(doubles(v), lambda x: 1 / (1 + F.exp(-x)))


def tanh(v) -> Column:
    return F.transform(doubles(v), F.tanh)


def power(v, power: float = 1.0, scale: float = 1.0, shift: float = 0.0) -> Column:
    """(shift + scale·x)^power."""
    return F.transform(doubles(v), lambda x: F.pow(shift + scale * x, F.lit(float(power))))


def threshold(v, t: float = 0.0) -> Column:
    return F.transform(doubles(v), lambda x: F.when(x > t, 1.0).otherwise(0.0))


def dropout(v, ratio: float, *keys: str, seed: int = 0) -> Column:
    """Elements kept with probability 1 − ratio and scaled up by its inverse; the mask follows from keys, place and seed."""
    return F.transform(doubles(v), lambda x, i: F.when(text_unit(*keys, i, seed=seed) >= ratio, x / (1 - ratio)).otherwise(0.0))


# ---- shape ------------------------------------------------------------------


def concat(*vs) -> Column:
    return F.concat(*[doubles(v) for v in vs])


def slice_at(v, *points: int) -> list[Column]:
    """The parts of an array between the given places."""
    x = doubles(v)
    ends = [*points, None]
    return [F.slice(x, a + 1, F.size(x) - a if b is None else b - a) for a, b in zip([0, *points], ends)]


def flatten(v) -> Column:
    return F.flatten(v)


def _times(v: Column, k: float) -> Column:
    return F.transform(v, lambda e: e * k)


def eltwise(op: str, *vs, coefficients: list[float] | None = None) -> Column:
    """Sum (with coefficients), product or maximum of arrays, place by place."""
    x = [doubles(v) for v in vs]
    if op == "sum":
        c = coefficients or [1.0] * len(x)
        x = [_times(v, k) for v, k in zip(x, c)]
    out = x[0]
    for v in x[1:]:
        out = F.zip_with(out, v, {"sum": lambda a, b: a + b, "prod": lambda a, b: a * b, "max": lambda a, b: F.greatest(a, b)}[op])
    return out


def mvn(v, variance: bool = True, eps: float = 1e-10) -> Column:
    """Less the mean, over the deviation plus ``eps``."""

    def centred(x: Column) -> Column:
        return let(total(x) / F.size(x), lambda m: F.transform(x, lambda e: e - m))

    def scaled(x: Column) -> Column:
        return let(F.sqrt(total(F.transform(x, lambda e: e * e)) / F.size(x)) + eps, lambda d: F.transform(x, lambda e: e / d))

    c = let(doubles(v), centred)
    return let(c, scaled) if variance else c


def inner_product(v, weights: Column, bias: Column | None = None) -> Column:
    """W·x + b of an array of weight rows."""
    y = F.transform(weights, lambda w: dot(v, w))
    return y if bias is None else F.zip_with(y, doubles(bias), lambda a, b: a + b)


# ---- losses (per row; average or sum over rows by the caller) ---------------


def euclidean_loss(a, b) -> Column:
    """Half the squared distance."""
    return let(F.zip_with(doubles(a), doubles(b), lambda x, y: x - y), lambda d: total(F.transform(d, lambda e: e * e))) / 2


def contrastive_loss(a, b, same: Column, margin: float = 1.0) -> Column:
    """Half the squared distance of a like pair; of an unlike one half of max(margin − squared distance, 0)."""
    return let(2 * euclidean_loss(a, b), lambda d: F.when(same, d).otherwise(F.greatest(margin - d, F.lit(0.0))) / 2)


def multinomial_loss(p, label) -> Column:
    """−log of the label's probability, which is at least 1e-20."""
    return -F.ln(F.greatest(F.get(doubles(p), label), F.lit(1e-20)))


def infogain_loss(p, row: Column) -> Column:
    """−Σ of a matrix row's weights times log probabilities."""
    return -total(F.zip_with(doubles(p), doubles(row), lambda q, h: h * F.ln(F.greatest(q, F.lit(1e-20)))))


def softmax_loss(scores, label) -> Column:
    return -safe_log(F.get(softmax(scores), label))


def hinge_loss(scores, label, norm: int = 1) -> Column:
    """Σ over classes of max(0, 1 ∓ score), the label's with +; or of its squares."""
    terms = F.transform(doubles(scores), lambda s, k: F.greatest(F.lit(0.0), 1 + F.when(k == label, -s).otherwise(s)))
    return total(terms) if norm == 1 else total(F.transform(terms, lambda t: t * t))


def sigmoid_cross_entropy(scores, targets) -> Column:
    """Σ of max(x, 0) − x·t + log(1 + e^−|x|)."""
    return total(F.zip_with(doubles(scores), doubles(targets), lambda x, t: F.greatest(x, F.lit(0.0)) - x * t + F.log1p(F.exp(-F.abs(x)))))


# ---- images -----------------------------------------------------------------


def im2col(x: np.ndarray, kernel: int, stride: int = 1, pad: int = 0) -> np.ndarray:
    """Patches of images [n, c, h, w] as [n, c·kernel², places]."""
    n, c, _, _ = x.shape
    x = np.pad(x, ((0, 0), (0, 0), (pad, pad), (pad, pad)))
    v = np.lib.stride_tricks.sliding_window_view(x, (kernel, kernel), axis=(2, 3))[:, :, ::stride, ::stride]
    h, w = v.shape[2:4]
    return v.transpose(0, 1, 4, 5, 2, 3).reshape(n, c * kernel * kernel, h * w)


def conv(x: np.ndarray, weights: np.ndarray, bias: np.ndarray | None = None, stride: int = 1, pad: int = 0) -> np.ndarray:
    """Correlation of images [n, c, h, w] with filters [f, c, k, k]."""
    f, _, k, _ = weights.shape
    cols = im2col(x, k, stride, pad)
    y = np.matmul(weights.reshape(f, -1), cols)
    if bias is not None:
        y = y + bias[:, None]
    h = (x.shape[2] + 2 * pad - k) // stride + 1
    return y.reshape(len(x), f, h, -1)


def pool(x: np.ndarray, kernel: int, stride: int, how: str = "max", seed: int = 0) -> np.ndarray:
    """Pooling with windows that may hang over the lower and right edge; means are over what lies inside.

    ``stochastic`` picks an element with a probability in proportion to its value.
    """
    n, c, h, w = x.shape
    oh, ow = -(-(h - kernel) // stride) + 1, -(-(w - kernel) // stride) + 1
    right, low = (ow - 1) * stride + kernel - w, (oh - 1) * stride + kernel - h
    fill = -np.inf if how == "max" else 0.0
    padded = np.pad(x.astype(float), ((0, 0), (0, 0), (0, max(low, 0)), (0, max(right, 0))), constant_values=fill)
    v = np.lib.stride_tricks.sliding_window_view(padded, (kernel, kernel), axis=(2, 3))[:, :, ::stride, ::stride]
    if how == "max":
        return v.max(axis=(4, 5))
    if how == "ave":
        inside = np.pad(np.ones((h, w)), ((0, max(low, 0)), (0, max(right, 0))))
        count = np.lib.stride_tricks.sliding_window_view(inside, (kernel, kernel))[::stride, ::stride].sum(axis=(2, 3))
        return v.sum(axis=(4, 5)) / count
    flat = np.maximum(v.reshape(*v.shape[:4], -1), 0)
    cum = flat.cumsum(axis=-1)
    draw = np.random.default_rng(seed).random(cum.shape[:-1])[..., None] * cum[..., -1:]
    return np.take_along_axis(flat, (cum < draw).sum(axis=-1)[..., None].clip(0, flat.shape[-1] - 1), -1)[..., 0]


def lrn(x: np.ndarray, size: int = 5, alpha: float = 1.0, beta: float = 0.75, across: bool = True) -> np.ndarray:
    """Local response normalisation across channels, or within squares of each channel."""
    sq = x.astype(float) ** 2
    half = size // 2
    if across:
        p = np.pad(sq, ((0, 0), (half, half), (0, 0), (0, 0)))
        s = np.lib.stride_tricks.sliding_window_view(p, size, axis=1).sum(axis=-1)
        return x / (1 + alpha / size * s) ** beta
    p = np.pad(sq, ((0, 0), (0, 0), (half, half), (half, half)))
    s = np.lib.stride_tricks.sliding_window_view(p, (size, size), axis=(2, 3)).sum(axis=(4, 5))
    return x / (1 + alpha / (size * size) * s) ** beta


def filler(shape: tuple[int, ...], kind: str, seed: int = 0, value: float = 0.0, low: float = -1.0, high: float = 1.0, mean: float = 0.0, std: float = 1.0) -> np.ndarray:
    """First weights: constant, uniform, gaussian, positive_unitball or xavier."""
    rng = np.random.default_rng(seed)
    fan_in = int(np.prod(shape[1:])) if len(shape) > 1 else shape[0]
    if kind == "constant":
        return np.full(shape, value)
    if kind == "uniform":
        return rng.uniform(low, high, shape)
    if kind == "gaussian":
        return rng.normal(mean, std, shape)
    if kind == "positive_unitball":
        x = rng.random(shape).reshape(shape[0], -1)
        return (x / x.sum(axis=1, keepdims=True)).reshape(shape)
    if kind == "xavier":
        b = np.sqrt(3.0 / fan_in)
        return rng.uniform(-b, b, shape)
    raise ValueError(f"no filler {kind!r}")


def images(datum: DataFrame) -> DataFrame:
    """Records whose data have the length of their shape, each ``datum_id`` once."""
    size = F.col("channels").cast("bigint") * F.col("height") * F.col("width")
    ok = datum.where((F.octet_length("data") > 0) & (F.octet_length("data") == size) & (F.col("datum_id").isNotNull()))
    return ok.select("datum_id", "channels", "height", "width", "data").dropDuplicates(["datum_id"])


def map_images(imgs: DataFrame, fn) -> DataFrame:
    """``datum_id, features``: ``fn`` of batches of images [n, c, h, w] of one shape, each result flattened."""

    def run(batches):
        for b in batches:
            shape = np.stack([b.column(i).to_numpy() for i in (1, 2, 3)], axis=1) if b.num_rows else np.zeros((0, 3), int)
            kinds, inverse = np.unique(shape, axis=0, return_inverse=True)
            for k, s in enumerate(kinds):
                rows = pa.array(np.flatnonzero(inverse.ravel() == k))
                x = np.frombuffer(b"".join(b.column(4).take(rows).to_pylist()), np.uint8).reshape(len(rows), *s)
                y = np.asarray(fn(x), float).reshape(len(rows), -1)
                offsets = np.arange(len(rows) + 1) * y.shape[1]
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(y.ravel()))], ["datum_id", "features"])

    return imgs.mapInArrow(run, "datum_id bigint, features array<double>")


def mean_image(imgs: DataFrame) -> DataFrame:
    """``channels, height, width, n, mean``: the mean image of each shape; sums are taken within tasks first."""

    def run(batches):
        sums: dict[tuple, list] = {}
        for b in batches:
            for c, h, w, data in zip(*[b.column(i).to_pylist() for i in (1, 2, 3, 4)]):
                x = np.frombuffer(data, np.uint8).astype(float)
                if (c, h, w) in sums:
                    sums[c, h, w][0] += 1
                    sums[c, h, w][1] += x
                else:
                    sums[c, h, w] = [1, x]
        k = list(sums)
        yield pa.RecordBatch.from_arrays([*[pa.array([s[i] for s in k], pa.int32()) for i in range(3)], pa.array([sums[s][0] for s in k], pa.int64()), pa.array([sums[s][1].tolist() for s in k], pa.list_(pa.float64()))], ["channels", "height", "width", "n", "total"])

    parts = imgs.mapInArrow(run, "channels int, height int, width int, n bigint, total array<double>")
    cells = parts.select("channels", "height", "width", "n", F.posexplode("total").alias("place", "s"))
    g = cells.groupBy("channels", "height", "width", "place").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return g.groupBy("channels", "height", "width").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("place", (F.col("s") / F.col("n")).alias("m")))).alias("t")).select("channels", "height", "width", "n", F.col("t.m").alias("mean"))
