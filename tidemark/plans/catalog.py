"""The queries of the core library, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import clocking, etl, losses, networks, optimisers, priorities, storage, store, streams, topics, training, vectors

MODULES = (store, clocking, priorities, vectors, etl, losses, optimisers, topics, networks, streams, training, storage)


def entry(spark: SparkSession) -> DataFrame:
    return store.flagship(spark, "/root/testdata/sf0.001")


def queries() -> dict:
    return {k: q for m in MODULES for k, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
