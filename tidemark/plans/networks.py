"""Queries on network layers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidemark.models import layers as N
from tidemark.plans.common import EMB_SQL, r, text_unit_sql
from tidemark.plans.vectors import _NEXT, _pairs
from tidemark.runtime import table


def _long(df, **columns):
    """Array columns of one length, one row per place."""
    names = list(columns)
    z = df.select("vec_id", F.posexplode(F.arrays_zip(*[c.alias(n) for n, c in columns.items()])).alias("fid", "z"))
    return z.select("vec_id", "fid", *[r(F.col("z").getField(n)).alias(n) for n in names])


def layer_elementwise(spark, root):
    e = table(spark, root, "embeddings")
    x = "embedding"
    e = e.select("vec_id", N.absval(x).alias("absval"), N.bnll(x).alias("bnll"), N.relu(x, 0.1).alias("relu"), N.sigmoid(x).alias("sigmoid"), N.tanh(x).alias("tanh"), N.power(x, 2, 3, 1).alias("power"), N.threshold(x, 0.05).alias("threshold"))
    return _long(e, **{c: F.col(c) for c in e.columns[1:]})


def layer_eltwise(spark, root):
    p = _pairs(spark, root).select("vec_id", N.eltwise("sum", "a", "b", coefficients=[2.0, -1.0]).alias("s"), N.eltwise("prod", "a", "b").alias("p"), N.eltwise("max", "a", "b").alias("m"))
    return _long(p, s=F.col("s"), p=F.col("p"), m=F.col("m"))


def layer_concat_slice(spark, root):
    p = _pairs(spark, root).select("vec_id", N.concat("a", "b").alias("c"))
    parts = N.slice_at("c", 10, 70)
    return p.select("vec_id", *[F.size(v).alias(f"n{i}") for i, v in enumerate(parts)], r(F.get(parts[1], F.lit(54))).alias("first_of_second"), r(F.get(parts[2], F.lit(0))).alias("x"))


def layer_mvn(spark, root):
    e = table(spark, root, "embeddings").select("vec_id", N.mvn("embedding").alias("v"))
    return _long(e, v=F.col("v"))


def layer_pair_losses(spark, root):
    e = table(spark, root, "embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("label").alias("other"))
    p = _pairs(spark, root).join(e, "vec_id")
    return p.select("vec_id", r(N.euclidean_loss("a", "b")).alias("euclidean"), r(N.contrastive_loss("a", "b", F.col("label") == F.col("other"), 2.5)).alias("contrastive"))


def layer_class_losses(spark, root):
    """Losses of all values as class scores."""
    e = table(spark, root, "embeddings").withColumn("s", F.col("embedding"))
    p = F.transform(F.col("s"), lambda x: F.abs(x.cast("double")))
    gain = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.when(k == F.col("label"), 1.0).otherwise(0.1))
    target = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.when(k == F.col("label"), 1.0).otherwise(0.0))
    return e.select(
        "vec_id", r(N.softmax_loss("s", F.col("label"))).alias("softmax"), r(N.hinge_loss("s", F.col("label"))).alias("hinge1"), r(N.hinge_loss("s", F.col("label"), 2)).alias("hinge2"),
        r(N.multinomial_loss(p, F.col("label"))).alias("multinomial"), r(N.infogain_loss(p, gain)).alias("infogain"), r(N.sigmoid_cross_entropy("s", target)).alias("bce"),
    )


def layer_inner_product(spark, root):
    """Eight outputs with weights and biases from places alone."""
    w = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda f: ((k * 5 + f * 3) % 7 - 3) / F.lit(3.0)))
    b = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: k / F.lit(8.0))
    e = table(spark, root, "embeddings").select("vec_id", F.posexplode(N.inner_product("embedding", w, b)).alias("k", "y"))
    return e.select("vec_id", "k", r("y").alias("y"))


def layer_dropout(spark, root):
    e = table(spark, root, "embeddings").select("vec_id", N.dropout("embedding", 0.4, "vec_id", seed=2).alias("v"))
    return _long(e, v=F.col("v"))


KERNEL = np.array([[[[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]]], float) / 8


def _features(y, name):
    return y.select("datum_id", F.size("features").alias("n"), r(F.aggregate("features", F.lit(0.0), lambda s, v: s + v), 4).alias(name))


def layer_conv(spark, root):
    """An edge filter over the mean of each image's channels."""
    imgs = N.images(table(spark, root, "datum"))
    return _features(N.map_images(imgs, lambda x: np.abs(N.conv(x.mean(axis=1, keepdims=True), KERNEL, pad=1))), "total")


def layer_pooling(spark, root):
    imgs = N.images(table(spark, root, "datum"))
    return _features(N.map_images(imgs, lambda x: np.concatenate([N.pool(x, 3, 2, "max"), N.pool(x, 3, 2, "ave")], axis=1)), "total")


def layer_lrn(spark, root):
    imgs = N.images(table(spark, root, "datum"))
    return _features(N.map_images(imgs, lambda x: N.lrn(x / 255.0, 3, 1.0, 0.75, across=x.shape[1] > 1)), "total")


def layer_im2col(spark, root):
    imgs = N.images(table(spark, root, "datum"))
    return _features(N.map_images(imgs, lambda x: N.im2col(x, 4, 4)), "total")


def mean_image(spark, root):
    m = N.mean_image(N.images(table(spark, root, "datum")))
    return m.select("channels", "height", "width", "n", F.posexplode("mean").alias("place", "mean")).select("channels", "height", "width", "n", "place", r("mean", 4).alias("mean"))


QUERIES = {
    q.__name__: q
    for q in (layer_elementwise, layer_eltwise, layer_concat_slice, layer_mvn, layer_pair_losses, layer_class_losses, layer_inner_product, layer_dropout, layer_conv, layer_pooling, layer_lrn, layer_im2col, mean_image)
}

_R = lambda x, n: f"round({x}, 6) + 0.0 AS {n}"

_PIXELS = """d AS (SELECT datum_id, any_value(channels) AS channels, any_value(height) AS height, any_value(width) AS width, any_value(hex(data)) AS h FROM datum
            WHERE datum_id IS NOT NULL AND octet_length(data) > 0 AND octet_length(data) = channels::BIGINT * height * width GROUP BY 1),
        u AS (SELECT *, unnest(range(0, channels::BIGINT * height * width)) AS place FROM d),
        px AS (SELECT datum_id, channels, height, width, place, place // width % height AS y, place % width AS z, ('0x' || substr(h, 2 * place + 1, 2))::INT::DOUBLE AS x FROM u)"""

ORACLE = {
    "layer_elementwise": f"""WITH {EMB_SQL} SELECT vec_id, fid, {_R('abs(x)', 'absval')}, {_R('ln(1 + exp(x))', 'bnll')}, {_R('greatest(x, 0) + 0.1 * least(x, 0)', 'relu')}, {_R('1 / (1 + exp(-x))', 'sigmoid')},
        {_R('tanh(x)', 'tanh')}, {_R('pow(1 + 3 * x, 2)', 'power')}, CASE WHEN x > 0.05 THEN 1.0 ELSE 0.0 END::DOUBLE AS threshold FROM emb""",
    "layer_eltwise": f"WITH {EMB_SQL}, {_NEXT} SELECT vec_id, fid, {_R('2 * x - y', 's')}, {_R('x * y', 'p')}, {_R('greatest(x, y)', 'm')} FROM emb JOIN b USING (vec_id, fid)",
    "layer_concat_slice": f"""SELECT a.vec_id, CAST(10 AS INT) AS n0, CAST(60 AS INT) AS n1, CAST(58 AS INT) AS n2, {_R('b.embedding[1]::DOUBLE', 'first_of_second')}, {_R('b.embedding[7]::DOUBLE', 'x')}
        FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "layer_mvn": f"""WITH {EMB_SQL}, m AS (SELECT vec_id, avg(x) AS m FROM emb GROUP BY 1), d AS (SELECT vec_id, sqrt(avg((x - m) * (x - m))) + 1e-10 AS d FROM emb JOIN m USING (vec_id) GROUP BY 1)
        SELECT vec_id, fid, {_R('(x - m) / d', 'v')} FROM emb JOIN m USING (vec_id) JOIN d USING (vec_id)""",
    "layer_pair_losses": f"""WITH {EMB_SQL}, b AS (SELECT vec_id - 1 AS vec_id, fid, x AS y, label AS other FROM emb), d AS (SELECT vec_id, any_value(label) AS l, any_value(other) AS o, sum((x - y) * (x - y)) AS d FROM emb JOIN b USING (vec_id, fid) GROUP BY 1)
        SELECT vec_id, {_R('d / 2', 'euclidean')}, {_R('CASE WHEN l = o THEN d ELSE greatest(2.5 - d, 0) END / 2', 'contrastive')} FROM d""",
    "layer_class_losses": f"""WITH {EMB_SQL}, s AS (SELECT * FROM emb)
        SELECT vec_id, {_R('ln(sum(exp(x))) - sum(CASE WHEN fid = label THEN x ELSE 0 END)', 'softmax')}, {_R('sum(greatest(0, 1 + CASE WHEN fid = label THEN -x ELSE x END))', 'hinge1')},
        {_R('sum(pow(greatest(0, 1 + CASE WHEN fid = label THEN -x ELSE x END), 2))', 'hinge2')}, {_R('-sum(CASE WHEN fid = label THEN ln(greatest(abs(x), 1e-20)) ELSE 0 END)', 'multinomial')},
        {_R('-sum(CASE WHEN fid = label THEN 1.0 ELSE 0.1 END * ln(greatest(abs(x), 1e-20)))', 'infogain')}, {_R('sum(greatest(x, 0) - CASE WHEN fid = label THEN x ELSE 0 END + ln(1 + exp(-abs(x))))', 'bce')} FROM s GROUP BY 1""",
    "layer_dropout": f"WITH {EMB_SQL} SELECT vec_id, fid, {_R(f"CASE WHEN {text_unit_sql(2, 'vec_id', 'fid')} >= 0.4 THEN x / 0.6 ELSE 0 END", 'v')} FROM emb",
    "layer_im2col": f"WITH {_PIXELS} SELECT datum_id, CAST(count(*) AS INT) AS n, round(sum(x), 4) + 0.0 AS total FROM px WHERE y < height // 4 * 4 AND z < width // 4 * 4 GROUP BY 1",
    "layer_conv": f"""WITH {_PIXELS}, g AS (SELECT datum_id, any_value(height) AS height, any_value(width) AS width, y, z, avg(x) AS x FROM px GROUP BY datum_id, y, z),
        k AS (SELECT a - 1 AS dy, b - 1 AS dz, (b - 1) * CASE WHEN a = 1 THEN 2 ELSE 1 END / 8.0 AS w FROM range(0, 3) s(a), range(0, 3) t(b)),
        o AS (SELECT datum_id, y - dy AS y, z - dz AS z, sum(x * w) AS v FROM g, k WHERE y - dy BETWEEN 0 AND height - 1 AND z - dz BETWEEN 0 AND width - 1 GROUP BY 1, 2, 3),
        c AS (SELECT datum_id, count(*) AS n FROM g GROUP BY 1)
        SELECT datum_id, CAST(any_value(n) AS INT) AS n, round(sum(abs(v)), 4) + 0.0 AS total FROM o JOIN c USING (datum_id) GROUP BY 1""",
    "mean_image": f"WITH {_PIXELS} SELECT channels, height, width, count(*) AS n, CAST(place AS INT) AS place, round(avg(x), 4) + 0.0 AS mean FROM px GROUP BY channels, height, width, place",
    "layer_inner_product": f"WITH {EMB_SQL} SELECT vec_id, CAST(k AS INT) AS k, {_R('sum(x * ((k * 5 + fid * 3) % 7 - 3) / 3.0) + k / 8.0', 'y')} FROM emb, range(0, 8) t(k) GROUP BY vec_id, k",
}
