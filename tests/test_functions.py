"""Vector functions, partitions, layers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import vec
from tidemark.models import layers as N
from tidemark.operators import optim as O
from tidemark.operators import partition as P
from tidemark.operators.ranking import prefix_sum_by_order


def value(spark, column, **columns):
    kinds = ", ".join(f"{k} {t}" for k, (t, _) in columns.items()) or "z int"
    df = spark.createDataFrame([tuple(v for _, v in columns.values()) or (0,)], kinds)
    return df.select(column.alias("x")).first().x


def test_axpy_numbers(spark):
    f1 = [2.0 if i in (0, 2, 4) else 0.0 for i in range(6)]
    ones = [1.0] * 6
    a = {"x": ("array<double>", f1), "y": ("array<double>", ones)}
    assert value(spark, vec.axpy(10, "x", "y"), **a) == [21.0, 1.0, 21.0, 1.0, 21.0, 1.0]
    assert value(spark, vec.axpy(10, "y", "x"), **a) == [12.0, 10.0, 12.0, 10.0, 12.0, 10.0]


def test_dots_agree(spark):
    d = [1.0, 2.0, 3.0, 4.0]
    cols = {"a": ("array<float>", d), "i": ("array<int>", [3, 0, 9]), "v": ("array<float>", [2.0, 5.0, 7.0]), "j": ("array<int>", [0, 3]), "w": ("array<float>", [1.0, 1.0]), "n": ("array<float>", None)}
    assert value(spark, vec.dot("a", "a"), **cols) == 30.0
    assert value(spark, vec.dot("a", "v"), **cols) is None
    assert value(spark, vec.dot("a", "n"), **cols) is None
    assert value(spark, vec.dot_sparse_dense("i", "v", "a"), **cols) == 13.0
    assert value(spark, vec.dot_sparse_sparse("i", "v", "j", "w"), **cols) == 7.0


def test_scalars(spark):
    x = {"x": ("double", 0.0), "v": ("array<double>", [1000.0, 1000.0])}
    assert value(spark, vec.safe_log("x"), **x) == pytest.approx(math.log(1e-15))
    assert value(spark, vec.log_sum(F.lit(1000.0), F.lit(1000.0)), **x) == pytest.approx(1000 + math.log(2))
    assert value(spark, vec.log_sum_vec("v"), **x) == pytest.approx(1000 + math.log(2))
    assert value(spark, vec.softmax("v"), **x) == pytest.approx([0.5, 0.5])
    assert value(spark, vec.argmax("v"), **x) == 0
    assert value(spark, vec.log_rising(F.lit(0), 0.7), **x) == 0.0
    assert value(spark, vec.log_rising(F.lit(4), 0.7), **x) == pytest.approx(math.lgamma(4.7) - math.lgamma(0.7))
    assert value(spark, vec.soft_threshold(F.lit(-0.3), 0.1), **x) == pytest.approx(-0.2)
    assert value(spark, vec.to_text(F.array(F.lit(1), F.lit(2))), **x) == "1 2 "
    w = {"w": ("double", 4.0)}
    assert value(spark, vec.lazy_decay("w", 0.5, F.lit(3), F.lit(1)), **w) == 1.0


def test_log_gamma(spark):
    from tidemark.models.lda import _log_gamma_column

    for n, a in ((0, 0.1), (3, 0.05), (1000, 12.5)):
        assert value(spark, _log_gamma_column(F.lit(n), a)) == pytest.approx(math.lgamma(n + a), abs=1e-8)


def test_momentum(spark):
    assert value(spark, O.momentum(F.col("g"), 0.5, 1.0), g=("array<double>", [1.0, 1.0, 1.0])) == 1.75
    assert value(spark, O.momentum(F.col("g"), 0.5, 1.0), g=("array<double>", [])) == 0.0


def test_adarevision_is_the_recurrence(spark):
    g = np.random.default_rng(1).normal(size=60)
    df = spark.createDataFrame([(0, 0, i, float(v)) for i, v in enumerate(g)], "row_id int, col_id int, seq int, g double")
    got = [r.value for r in O.adarevision(df, 0.1, lag=3).orderBy("seq").collect()]
    total, z, zmax, v, sums = 0.0, 1.0, 1.0, 0.0, [0.0]
    for i, u in enumerate(g):
        back = total - sums[max(0, i - 3)]
        old = 0.1 / math.sqrt(zmax)
        z += u * (u + 2 * back)
        zmax = max(zmax, z)
        eta = 0.1 / math.sqrt(zmax)
        v += -eta * u + (old - eta) * back
        total += u
        sums.append(total)
        assert got[i] == pytest.approx(v, abs=1e-9)


def test_first_adagrad_step_is_the_sign(spark):
    df = spark.createDataFrame([(0, 0, 0, -3.0), (0, 1, 0, 0.0)], "row_id int, col_id int, seq int, g double")
    assert sorted(r.step for r in O.adagrad(df, 0.1).collect()) == [0.0, pytest.approx(0.1)]


@pytest.mark.parametrize("total,workers", [(10, 4), (3, 5), (0, 2), (12, 3)])
def test_work_ranges_cover(spark, total, workers):
    for even in (True, False):
        got = [i for w in range(workers) for i in range(*P.work_range(total, workers, w, even))]
        assert got == list(range(total))
    df = spark.range(total).select(P.worker_of(F.col("id"), total, workers).alias("w"), "id")
    for r in df.collect():
        lo, hi = P.work_range(total, workers, r.w)
        assert lo <= r.id < hi


def test_cuts(spark):
    df = spark.createDataFrame([(i, 10) for i in range(20)], "k bigint, n int")
    assert [r.part for r in P.split_by_weight(df, "k", "n", 50).orderBy("k").collect()] == [i // 5 for i in range(20)]
    assert [r.part for r in P.greedy_parts(df, "k", "n", 40.0, 5.0, block=12).orderBy("k").collect()] == [i // 4 for i in range(20)]
    assert [r.row_no for r in P.numbered(df, "k").orderBy("k").collect()] == list(range(20))


def test_greedy_cut_is_one_pass_at_any_block(spark):
    rng = np.random.default_rng(4)
    weights = [int(w) for w in rng.integers(0, 30, 150)] + [300, 0, 0, 7, 45, 46]
    keys = sorted(rng.choice(10**12, len(weights), replace=False).tolist())
    want, part, total = [], 0, 0
    for w in weights:
        want.append(part)
        total += w
        if total > 45:
            part, total = part + 1, 0
    df = spark.createDataFrame(list(zip(keys, weights)), "k bigint, n int")
    for block in (1, 7, 10, 10**6):
        assert [r.part for r in P.greedy_parts(df, "k", "n", 50.0, 5.0, block=block).orderBy("k").collect()] == want
    assert P.greedy_parts(df.limit(0), "k", "n", 50.0, 5.0).count() == 0


def test_an_outlier_fills_no_slice(spark):
    """Values a billion apart fall into slices of like numbers, and ties are told apart by the key."""
    df = spark.range(40_000).select(F.col("id").alias("k"), F.when(F.col("id") == 7, 1e18).when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id").cast("double")).alias("v"))
    got = prefix_sum_by_order(df, ["v", "k"], None, "at")
    rows = sorted((r.v, r.k, r.at) for r in got.collect())
    assert [r[2] for r in rows] == list(range(40_000))
    slices = df.repartitionByRange(8, "v", "k").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in slices) < 8_000


def test_convolution_and_pooling():
    rng = np.random.default_rng(0)
    x, w = rng.random((2, 3, 7, 6)), rng.random((4, 3, 3, 3))
    y = N.conv(x, w, stride=2, pad=1)
    p = np.pad(x, ((0, 0), (0, 0), (1, 1), (1, 1)))
    for n in range(2):
        for f in range(4):
            for i in range(y.shape[2]):
                for j in range(y.shape[3]):
                    assert y[n, f, i, j] == pytest.approx((p[n, :, 2 * i : 2 * i + 3, 2 * j : 2 * j + 3] * w[f]).sum())
    m = N.pool(x, 3, 2, "max")
    a = N.pool(x, 3, 2, "ave")
    for i in range(m.shape[2]):
        for j in range(m.shape[3]):
            win = x[0, 1, 2 * i : 2 * i + 3, 2 * j : 2 * j + 3]
            assert m[0, 1, i, j] == win.max() and a[0, 1, i, j] == pytest.approx(win.mean())
    s = N.pool(x, 2, 2, "stochastic")
    assert ((s >= 0) & (s <= x.max())).all()


def test_normalisation_and_fillers():
    x = np.random.default_rng(0).random((1, 4, 3, 3))
    y = N.lrn(x, 3, 2.0, 0.5)
    assert y[0, 0, 1, 1] == pytest.approx(x[0, 0, 1, 1] / (1 + 2 / 3 * (x[0, :2, 1, 1] ** 2).sum()) ** 0.5)
    z = N.lrn(x, 3, 2.0, 0.5, across=False)
    assert z[0, 0, 0, 0] == pytest.approx(x[0, 0, 0, 0] / (1 + 2 / 9 * (x[0, 0, :2, :2] ** 2).sum()) ** 0.5)
    assert N.filler((2, 3), "constant", value=2.0).tolist() == [[2.0] * 3] * 2
    assert N.filler((2, 8), "positive_unitball").sum(axis=1) == pytest.approx([1, 1])
    assert np.abs(N.filler((50, 12), "xavier")).max() <= 0.5
    with pytest.raises(ValueError):
        N.filler((1,), "other")


def test_mean_image(spark):
    df = spark.createDataFrame([(1, 1, 1, 2, bytearray([0, 10])), (2, 1, 1, 2, bytearray([2, 30])), (3, 1, 1, 2, None), (4, 1, 1, 2, bytearray([1]))], "datum_id bigint, channels int, height int, width int, data binary")
    r = N.mean_image(N.images(df)).first()
    assert (r.n, list(r["mean"])) == (2, [1.0, 20.0])


def test_gamma_functions(spark):
    xs = [1e-3, 0.5, 1.0, 2.5, 30.0, 1e6, 1e8]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", vec.ln_gamma("x").alias("g"), vec.digamma("x").alias("d")).collect()
    for row in got:
        assert row.g == pytest.approx(math.lgamma(row.x), rel=1e-10, abs=1e-10)
        h = max(row.x, 1.0) * 1e-4 if row.x > 0.01 else 1e-7
        assert row.d == pytest.approx((math.lgamma(row.x + h) - math.lgamma(row.x - h)) / (2 * h), rel=1e-4, abs=1e-4)
    rising = spark.createDataFrame([(0,), (3,), (100_000_000,), (-2,)], "n int").select(vec.log_rising("n", 0.1).alias("v"))
    assert [r.v for r in rising.collect()] == pytest.approx([0.0, math.lgamma(3.1) - math.lgamma(0.1), math.lgamma(1e8 + 0.1) - math.lgamma(0.1), 0.0])


def test_nan_stops_a_query(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "x double")
    assert df.where("not isnan(x)").select(vec.not_nan("x", "loss").alias("x")).collect()[0].x == 1.0
    with pytest.raises(Exception, match="loss is NaN"):
        df.select(vec.not_nan("x", "loss")).collect()
