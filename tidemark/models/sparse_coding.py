"""Sparse coding: a dictionary and sparse codes of rows, by alternating steps.

Rows are ``(id, x ARRAY)``. A dictionary of ``atoms`` × dims values is a model
of fixed size; rows and their codes stay in tables.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import staged

# Fixed value: output entries nearer to zero than this are written as 0.
SMALL = 1e-5


def soft(x: np.ndarray, t: float) -> np.ndarray:
    return np.sign(x) * np.maximum(np.abs(x) - t, 0)


def project(b: np.ndarray, c: float = 1.0) -> np.ndarray:
    """Each atom scaled down to squared norm ``c`` if over it."""
    n = (b * b).sum(axis=1, keepdims=True)
    return np.where(n > c, b * np.sqrt(c / np.where(n > 0, n, 1)), b)


def codes_of(x: np.ndarray, s: np.ndarray, b: np.ndarray, lam: float, rate: float, inner: int = 10) -> np.ndarray:
    """Proximal gradient steps on the codes of rows for a fixed dictionary."""
    for _ in range(inner):
        s = soft(s + 2 * rate * (x - s @ b) @ b.T, rate * lam)
    return s


def train(rows: DataFrame, atoms: int, iterations: int, lam: float = 0.1, rate: float = 0.05, eta: float = 0.1, seed: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Full-batch alternation; returns ``dictionary(atom, b)``, ``codes(id, s)`` and ``iteration, n, objective``.

    Each iteration every task improves the codes of its rows and adds up its
    share of the dictionary's gradient 2(x − sB)ᵀs; the sums, one dictionary per
    task, are added in a tree before the driver takes the step and projects.
    The objective is the mean of ‖x − sB‖² + λ‖s‖₁.
    """
    spark = rows.sparkSession
    data = staged(rows.select("id", F.col("x").cast("array<double>").alias("x"), F.array_repeat(F.lit(0.0), atoms).alias("s")), "rows")
    first = data.limit(1).collect()
    dims = len(first[0].x) if first else 0
    b = project(np.random.default_rng(seed).normal(0, 1, (atoms, dims)))
    history = []
    for t in range(iterations):

        def run(parts, b=b):
            for pdf in parts:
                if len(pdf):
                    s = codes_of(np.stack(pdf["x"].to_numpy()), np.stack(pdf["s"].to_numpy()), b, lam, rate)
                    yield pd.DataFrame({"id": pdf["id"], "x": pdf["x"], "s": list(s)})

        def gradient(parts, b=b):
            g, n, loss = np.zeros((atoms, dims)), 0, 0.0
            for pdf in parts:
                if len(pdf):
                    x, s = np.stack(pdf["x"].to_numpy()), np.stack(pdf["s"].to_numpy())
                    r = x - s @ b
                    g += 2 * s.T @ r
                    n += len(x)
                    loss += float((r * r).sum() + lam * np.abs(s).sum())
            if n:
                yield pd.DataFrame({"g": [g.tobytes()], "n": [n], "loss": [loss]})

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            g = sum(np.frombuffer(v) for v in pdf["g"])
            return pd.DataFrame({"g": [g.tobytes()], "n": [int(pdf["n"].sum())], "loss": [float(pdf["loss"].sum())]})

        data = staged(data.mapInPandas(run, data.schema), "codes")
        parts = data.mapInPandas(gradient, "g binary, n bigint, loss double")
        tree = parts.groupBy(F.pmod(F.spark_partition_id(), F.lit(16)).alias("node")).applyInPandas(add, "g binary, n bigint, loss double")
        sums = tree.collect()  # at most 16 dictionaries
        n = sum(r.n for r in sums)
        if not n:
            break
        history.append((t, n, sum(r.loss for r in sums) / n))
        b = project(b + eta * sum(np.frombuffer(r.g).reshape(atoms, dims) for r in sums) / n)
    dictionary = spark.createDataFrame([(k, [0.0 if abs(v) < SMALL else float(v) for v in b[k]]) for k in range(atoms)], "atom int, b array<double>")
    codes = data.select("id", F.transform("s", lambda v: F.when(F.abs(v) < SMALL, 0.0).otherwise(v)).alias("s"))
    return dictionary, codes, spark.createDataFrame(history, "iteration int, n bigint, objective double")
