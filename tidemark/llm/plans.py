"""Queries over the test tables for the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.clusters import describe_groups, similarity_groups
from tidemark.llm.garbled import garbled_documents
from tidemark.llm.mixing import mix_sources
from tidemark.llm.neighbours import nearest
from tidemark.llm.overlap import overlap_counts, split_overlap
from tidemark.llm.sampling import distinct_records, proportional_sample
from tidemark.llm.subset import varied_subset
from tidemark.llm.tokens import token_ids
from tidemark.llm.vectors import unit_vectors
from tidemark.runtime import staged, table


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    _, report = proportional_sample(table(spark, root, "datum"), table(spark, root, "label_targets"))
    return report.where("available < wanted").select("plan_id", "label")


def p1_sample(spark: SparkSession, root: str) -> DataFrame:
    return proportional_sample(table(spark, root, "datum"), table(spark, root, "label_targets"))[0]


def p1_report(spark: SparkSession, root: str) -> DataFrame:
    return proportional_sample(table(spark, root, "datum"), table(spark, root, "label_targets"))[1]


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    pairs = split_overlap(table(spark, root, "datum"))
    return pairs.select(F.least("train_id", "other_id").alias("id_a"), F.greatest("train_id", "other_id").alias("id_b"))


def p2_report(spark: SparkSession, root: str) -> DataFrame:
    return overlap_counts(split_overlap(table(spark, root, "datum")))


def p3_subset(spark: SparkSession, root: str) -> DataFrame:
    return varied_subset(table(spark, root, "datum"), table(spark, root, "subset_jobs"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    v = staged(unit_vectors(table(spark, root, "datum")), "p5-vectors")
    probes = table(spark, root, "knn_probe").groupBy("datum_id").agg(F.max("k").alias("k"))
    queries = staged(v.join(probes, v.id == probes.datum_id).select(F.col("id").alias("query_id"), "vec", "k").dropDuplicates(["query_id"]), "p5-queries")
    n = nearest(v, queries)
    return n.select(F.least("query_id", "id").alias("id_a"), F.greatest("query_id", "id").alias("id_b")).distinct()


def _groups(spark: SparkSession, root: str) -> DataFrame:
    return staged(similarity_groups(unit_vectors(table(spark, root, "datum"))), "p6-groups")


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    g = _groups(spark, root)
    sizes = g.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).where("n > 1")
    return g.join(sizes, "group").select(F.col("id").alias("datum_id"), "first_id")


def p6_groups(spark: SparkSession, root: str) -> DataFrame:
    labels = distinct_records(table(spark, root, "datum"), "label").select(F.col("datum_id").alias("id"), "label")
    return describe_groups(_groups(spark, root), labels).select("first_id", "size", "typical", F.to_json("labels").alias("labels"))


def p7_ids(spark: SparkSession, root: str) -> DataFrame:
    return token_ids(table(spark, root, "documents"))


def p8_mixture(spark: SparkSession, root: str) -> DataFrame:
    return mix_sources(table(spark, root, "documents"), table(spark, root, "mix_targets"))[0]


def p8_shares(spark: SparkSession, root: str) -> DataFrame:
    return mix_sources(table(spark, root, "documents"), table(spark, root, "mix_targets"))[1]


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return garbled_documents(table(spark, root, "documents")).select("doc_id")


def p9_restored(spark: SparkSession, root: str) -> DataFrame:
    return garbled_documents(table(spark, root, "documents"))


def queries() -> dict:
    names = ["p1_found", "p1_sample", "p1_report", "p2_found", "p2_report", "p3_subset", "p5_found", "p6_found", "p6_groups", "p7_ids", "p8_mixture", "p8_shares", "p9_found", "p9_restored"]
    return {n: globals()[n] for n in names}
