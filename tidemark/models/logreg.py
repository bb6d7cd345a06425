"""Multiclass and binary logistic regression.

Data are ``(id, x ARRAY, y INT)``; class weights ``(k, fid, w)``, binary ones
``(fid, w)``. A model of classes × features is small by construction (its size
is a parameter of the problem, not of the data), so its weights travel with the
plan as one row; the data are never shuffled for a prediction.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import vec
from tidemark.operators.optim import geometric
from tidemark.runtime import staged

MODEL_BYTES = 64 << 20


def _model_row(weights: DataFrame, classes: int, dims: int) -> DataFrame:
    """One row: the weights as an array of ``classes`` arrays; cells without a weight are 0."""
    if classes * dims * 8 > MODEL_BYTES:
        raise ValueError("a model of this size must stay a table: use score_by_join")
    cell = (F.col("k") * dims + F.col("fid")).cast("int")
    m = weights.where((F.col("k") < classes) & (F.col("fid") < dims)).agg(F.map_from_entries(F.collect_list(F.struct(cell.alias("c"), "w"))).alias("m"))
    rows = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda f: F.coalesce(F.try_element_at("m", (k * dims + f).cast("int")), F.lit(0.0))))
    return m.select(rows.alias("__w"))


def score_by_join(data: DataFrame, weights: DataFrame) -> DataFrame:
    """``id, k, z`` of a model of any size: features are joined with their weights and summed."""
    x = data.select("id", F.posexplode("x").alias("fid", "v")).where("v <> 0")
    return x.join(weights, "fid").groupBy("id", "k").agg(F.sum(F.col("v").cast("double") * F.col("w")).alias("z"))


def class_probabilities(data: DataFrame, weights: DataFrame, classes: int, dims: int) -> DataFrame:
    """``id, y, p``: softmax of the class scores of each row."""
    d = data.crossJoin(F.broadcast(_model_row(weights, classes, dims)))  # one row, bounded by MODEL_BYTES
    return d.select("id", "y", vec.softmax(F.transform("__w", lambda w: vec.dot("x", w))).alias("p"))


def predicted_class() -> Column:
    """The first class of the largest probability."""
    return vec.argmax("p")


def class_losses(predictions: DataFrame) -> DataFrame:
    """``n, zero_one, cross_entropy``: count of rows, wrong classes, and mean negative log probability of the label."""
    wrong = (predicted_class() != F.col("y")).cast("bigint")
    return predictions.agg(F.count(F.lit(1)).alias("n"), F.sum(wrong).alias("zero_one"), F.avg(-vec.safe_log(F.get("p", F.col("y")))).alias("cross_entropy"))


def top_k_accuracy(predictions: DataFrame, k: int) -> DataFrame:
    """``n, accuracy``: share of rows whose label is among the k most probable classes; ties go to the smaller class."""
    mine = F.get("p", F.col("y"))
    ahead = F.aggregate(F.transform("p", lambda p, i: F.when((p > mine) | ((p == mine) & (i < F.col("y"))), 1).otherwise(0)), F.lit(0), lambda s, v: s + v)
    return predictions.agg(F.count(F.lit(1)).alias("n"), F.avg((ahead < k).cast("double")).alias("accuracy"))


def binary_probability(data: DataFrame, weights: DataFrame, dims: int) -> DataFrame:
    """``id, y, z, p``: the score and the probability of class 1."""
    w = _model_row(weights.select(F.lit(0).alias("k"), "fid", "w"), 1, dims)
    d = data.crossJoin(F.broadcast(w)).withColumn("z", vec.dot("x", F.get("__w", F.lit(0))))
    return d.select("id", "y", "z", vec.sigmoid("z").alias("p"))


def binary_margin(data: DataFrame, weights: DataFrame, dims: int) -> DataFrame:
    """``id, y, margin``: score times ±1."""
    return binary_probability(data, weights, dims).select("id", "y", (F.col("z") * (2 * F.col("y") - 1)).alias("margin"))


def binary_losses(predictions: DataFrame) -> DataFrame:
    """``n, zero_one, log_loss``; at a probability of exactly one half either label is an error."""
    right = F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p"))
    error = F.when((right >= 0.5) & (F.col("p") != 0.5), 0).otherwise(1)
    return predictions.agg(F.count(F.lit(1)).alias("n"), F.sum(error.cast("bigint")).alias("zero_one"), F.avg(-vec.safe_log(right)).alias("log_loss"))


def l2_penalty(weights: DataFrame, lam: float) -> DataFrame:
    """``penalty``: half λ times the squared norm."""
    return weights.agg((F.coalesce(F.sum(F.col("w") * F.col("w")), F.lit(0.0)) * lam / 2).alias("penalty"))


def class_gradient(data: DataFrame, weights: DataFrame, classes: int, dims: int) -> DataFrame:
    """``k, fid, g``: gradient of the summed cross-entropy at fixed weights.

    Per row the error ``p_k − [k = y]`` times each feature; sums are partial
    before the shuffle, which carries one value per task, class and feature.
    """
    p = class_probabilities(data, weights, classes, dims).select("id", "p")
    e = data.join(p, "id").select("x", F.posexplode(F.zip_with("p", F.sequence(F.lit(0), F.lit(classes - 1)), lambda q, k: q - F.when(k == F.col("y"), 1.0).otherwise(0.0))).alias("k", "e"))
    cells = e.select("k", "e", F.posexplode("x").alias("fid", "v"))
    return cells.groupBy("k", "fid").agg(F.sum(F.col("e") * F.col("v").cast("double")).alias("g"))


def class_step(data: DataFrame, weights: DataFrame, classes: int, dims: int, eta: float) -> DataFrame:
    """One step of full-batch descent: weights less η times the mean gradient."""
    n = data.agg(F.count(F.lit(1)).alias("n"))
    g = class_gradient(data, weights, classes, dims).crossJoin(F.broadcast(n))
    return weights.join(g, ["k", "fid"], "full").select("k", "fid", (F.coalesce("w", F.lit(0.0)) - eta * F.coalesce("g", F.lit(0.0)) / F.greatest(F.coalesce("n", F.lit(1)), F.lit(1))).alias("w"))


def binary_gradient(data: DataFrame, weights: DataFrame, dims: int, lam: float = 0.0) -> DataFrame:
    """``fid, g``: summed gradient of the log loss; each non-zero feature of a row also adds λ times its weight."""
    p = binary_probability(data, weights, dims).select("id", (F.col("p") - F.col("y")).alias("e"))
    cells = data.join(p, "id").select("e", F.posexplode("x").alias("fid", "v")).where("v <> 0")
    sums = cells.groupBy("fid").agg(F.sum(F.col("e") * F.col("v").cast("double")).alias("g"), F.count(F.lit(1)).alias("n"))
    return sums.join(weights, "fid", "left").select("fid", (F.col("g") + lam * F.col("n") * F.coalesce("w", F.lit(0.0))).alias("g"))


def binary_step(data: DataFrame, weights: DataFrame, dims: int, eta: float, lam: float = 0.0) -> DataFrame:
    """One step of full-batch descent on the summed gradient."""
    g = binary_gradient(data, weights, dims, lam)
    return weights.join(g, "fid", "full").select("fid", (F.coalesce("w", F.lit(0.0)) - eta * F.coalesce("g", F.lit(0.0))).alias("w"))


def train_classes(data: DataFrame, classes: int, dims: int, epochs: int, eta: float = 0.5, decay: float = 0.95, workers: int = 8, batch: int = 64, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Epochs of bulk-synchronous SGD; returns the weights and ``epoch, n, zero_one, cross_entropy``.

    A worker holds a hash share of the rows, in the order of their ids. In each
    epoch it starts from the shared weights and takes its minibatches in turn,
    so it reads its own writes; the workers' changes are averaged at the end of
    the epoch, which is the clock. The model of classes × dims values is all
    that moves.
    """
    return _train(data, classes, dims, epochs, eta, decay, workers, batch)


def _epoch_of_worker(start: np.ndarray, rate: float, batch: int):
    """A worker's epoch from given weights: the change of the weights and the number of rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = start.copy()
        pdf = pdf.sort_values("id")
        x, y = np.stack(pdf["x"].to_numpy()), pdf["y"].to_numpy()
        for s in range(0, len(y), batch):
            a, b = x[s : s + batch], y[s : s + batch]
            z = a @ own.T
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(b)), b] -= 1
            own -= rate * (p.T @ a) / len(b)
        return pd.DataFrame({"delta": [(own - start).tobytes()], "n": [len(y)]})

    return run


def _train(data: DataFrame, classes: int, dims: int, epochs: int, eta: float, decay: float, workers: int, batch: int) -> tuple[DataFrame, DataFrame]:
    spark = data.sparkSession
    rows = staged(data.select("id", F.col("x").cast("array<double>").alias("x"), "y", F.pmod(F.xxhash64("id"), F.lit(workers)).cast("int").alias("worker")), "train")
    w = np.zeros((classes, dims))
    history = []
    for epoch in range(epochs):
        parts = rows.groupBy("worker").applyInPandas(_epoch_of_worker(w, eta * decay**epoch, batch), "delta binary, n bigint").collect()  # one model per worker
        total = sum(p.n for p in parts)
        w = w + sum(np.frombuffer(p.delta).reshape(classes, dims) * (p.n / total) for p in parts) if total else w
        table = weights_table(spark, w)
        row = class_losses(class_probabilities(rows, table, classes, dims)).first()
        history.append((epoch, row.n, int(row.zero_one or 0), float(row.cross_entropy or 0.0)))
    return weights_table(spark, w), spark.createDataFrame(history, "epoch int, n bigint, zero_one bigint, cross_entropy double")


def weights_table(spark, w: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(int(k), int(f), float(w[k, f])) for k in range(w.shape[0]) for f in range(w.shape[1])], "k int, fid int, w double")


def train_binary(data: DataFrame, dims: int, steps: int, eta: float = 0.5, decay: float = 0.9, lam: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Steps of full-batch descent with rate η·d^(t+1); returns the weights and the losses after each step.

    The step is a plan over tables; the weights are written after each one.
    """
    spark = data.sparkSession
    rows = staged(data.select("id", "x", "y"), "train")
    n = max(rows.count(), 1)
    w = spark.createDataFrame([(f, 0.0) for f in range(dims)], "fid int, w double")
    history = []
    for t in range(steps):
        w = staged(binary_step(rows, w, dims, eta * decay ** (t + 1) / n, lam), "weights")
        row = binary_losses(binary_probability(rows, w, dims)).first()
        history.append((t, row.n, int(row.zero_one or 0), float(row.log_loss or 0.0)))
    return w, spark.createDataFrame(history, "step int, n bigint, zero_one bigint, log_loss double")
