"""Samples that follow target shares of categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranking import rank_by_unit, slices_for
from tidemark.runtime import norm_split, staged, text_unit


def distinct_records(datum: DataFrame, *cols: str) -> DataFrame:
    """One row per non-null ``datum_id``: the values of its first delivery.

    Only the named columns are read and shuffled, with partial aggregation.
    """
    order = F.struct(F.col("ingested_at").isNull(), F.col("ingested_at"), *[F.col(c) for c in cols])
    best = datum.where("datum_id is not null").groupBy("datum_id").agg(F.min_by(F.struct(*cols), order).alias("r"))
    return best.select("datum_id", *[F.col(f"r.{c}").alias(c) for c in cols])


def _quotas(records: DataFrame, targets: DataFrame) -> DataFrame:
    """Per plan and listed label: how many records there are and how many are wanted."""
    counts = records.groupBy("split", "label").agg(F.count(F.lit(1)).alias("available"))
    totals = counts.groupBy("split").agg(F.sum("available").alias("of_split"))
    t = targets.select("plan_id", norm_split("split").alias("split"), "sample_percent", "label", "target_share", "min_records")
    q = t.join(counts, ["split", "label"], "left").join(totals, "split", "left")
    share = F.col("target_share") * F.col("sample_percent") / F.lit(100.0) * F.coalesce("of_split", F.lit(0))
    q = q.withColumn("available", F.coalesce("available", F.lit(0)))
    q = q.withColumn("wanted", F.greatest(F.coalesce(F.col("min_records").cast("double"), F.lit(0.0)), F.coalesce(share, F.lit(0.0))))
    return q.withColumn("quota", F.least(F.col("available"), F.ceil(F.col("wanted") - F.lit(1e-9)).cast("bigint")))


def proportional_sample(datum: DataFrame, targets: DataFrame, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Draw a sample per plan whose label shares follow the targets; report what could not be met.

    Returns ``sample(plan_id, datum_id, label)`` and ``report(plan_id, label,
    available, wanted, drawn, deficit)`` with one row per row of ``targets``.

    Every record has one number in [0, 1) per plan. A label's acceptance
    probability is its quota over its records, a little raised so that the
    independent draws nearly always reach the quota; then the count is
    corrected exactly: of too many accepted, those with the largest numbers go,
    and a label whose draws fell short is drawn again with probability 1, of
    which again the quota's smallest numbers stay. The rank by which they stay
    is computed in slices of the numbers, so no label is ever sorted in one
    task. A label with fewer records than wanted gives all it has.

    Null labels and splits take part in no plan; a repeated ``datum_id`` counts
    once; empty tables give an empty sample, and deficits for every target.
    """
    records = distinct_records(datum, "split", "label").select("datum_id", norm_split("split").alias("split"), "label")
    records = staged(records.where("split is not null and label is not null"), "p1-records")
    quotas = staged(_quotas(records, targets), "p1-quotas")
    unit = text_unit("plan_id", "datum_id", seed=seed)
    need = F.col("quota").cast("double")
    rate = F.least(F.lit(1.0), (need + 4 * F.sqrt(need) + 4) / F.greatest(F.col("available"), F.lit(1)))
    wanted = quotas.where("quota > 0").select("plan_id", "split", "label", "quota", rate.alias("rate"))

    def draw(rates: DataFrame) -> DataFrame:
        return records.join(rates, ["split", "label"]).withColumn("u", unit).where("u < rate")

    accepted = draw(wanted)
    counted = accepted.groupBy("plan_id", "label").agg(F.count(F.lit(1)).alias("n"))
    short = wanted.join(counted, ["plan_id", "label"], "left").where("coalesce(n, 0) < quota").drop("n", "rate")
    short = staged(short, "p1-short")
    again = draw(short.withColumn("rate", F.lit(1.0)))
    first = accepted.join(short.select("plan_id", "label"), ["plan_id", "label"], "left_anti")
    ranked = rank_by_unit(first.unionByName(again, allowMissingColumns=True), ["plan_id", "label"], "u", "datum_id", buckets=slices_for(records.count()))
    sample = staged(ranked.where("rank <= quota").select("plan_id", "datum_id", "label"), "p1-sample")
    drawn = sample.groupBy("plan_id", "label").agg(F.count(F.lit(1)).alias("drawn"))
    report = quotas.join(drawn, ["plan_id", "label"], "left").select(
        "plan_id", "label", "available", "wanted", F.coalesce("drawn", F.lit(0)).cast("bigint").alias("drawn"), F.greatest(F.lit(0.0), F.col("wanted") - F.coalesce("drawn", F.lit(0))).alias("deficit")
    )
    return sample, report
