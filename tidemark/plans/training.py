"""Queries that train a model; they return its evaluations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.models import lda, logreg, matfact, sparse_coding
from tidemark.plans.common import r
from tidemark.plans.etl import _coo
from tidemark.plans.losses import CLASSES, DIMS, _binary, _data
from tidemark.runtime import table


def train_mlr(spark, root):
    return logreg.train_classes(_data(spark, root), CLASSES, DIMS, epochs=4)[1]


def train_logreg(spark, root):
    return logreg.train_binary(_binary(spark, root), DIMS, steps=4, eta=2.0)[1]


def train_mf(spark, root):
    _, _, h = matfact.train(_coo(spark, root).withColumn("x", F.col("x") / 50), rank=4, iterations=3, eta=0.002, lam=0.05)
    return h.select("iteration", "n", r("squared", 4).alias("squared"), r("objective", 4).alias("objective"))


def train_mf_rows_first(spark, root):
    _, _, h = matfact.train(_coo(spark, root).withColumn("x", F.col("x") / 50), rank=4, iterations=2, eta=0.002, lam=0.05, rows_first=True)
    return h.select("iteration", "n", r("squared", 4).alias("squared"), r("objective", 4).alias("objective"))


def train_lda(spark, root):
    return lda.train(table(spark, root, "documents"), topics=8, rounds=2)[1]


def train_sparse_coding(spark, root):
    e = table(spark, root, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"))
    return sparse_coding.train(e, atoms=16, iterations=4)[2]


QUERIES = {q.__name__: q for q in (train_mlr, train_logreg, train_mf, train_mf_rows_first, train_lda, train_sparse_coding)}
ORACLE: dict[str, str] = {}
