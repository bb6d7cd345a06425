"""Varied subsets by a round-robin over the cells of a grid; built-in expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.ranking import rank_by_unit
from tidemark.runtime import norm_split, text_unit

DIMS = 64


def usable(col: str) -> str:
    """SQL condition: 64 finite values that are not all zero."""
    return f"size({col}) = {DIMS} and forall({col}, v -> v is not null and not isnan(v) and abs(v) < float('infinity')) and exists({col}, v -> v <> 0)"


def grid_bits(bits: int) -> str:
    """SQL expression for the grid code of ``float_data``.

    Bit j compares two sums of three values each, so it ignores a vector's
    length; the sums run in double, exact for 32-bit values of like size.
    """
    x = "cast(float_data[{}] as double)"
    term = lambda j, o: " + ".join(x.format((j + bits * (o + p)) % DIMS) for p in range(3))
    return " + ".join(f"if({term(j, 0)} > {term(j, 3)}, {1 << j}, 0)" for j in range(bits))


def varied_subset(datum: DataFrame, jobs: DataFrame, bits: int = 10, seed: int = 3) -> DataFrame:
    """For each job, ``n_records`` usable vectors that cover directions and labels.

    The grid's cells are (label, code of ``bits`` comparisons). Records are
    ranked within their cell by a hash. Within one rank, cells come in the
    order: first one cell of each code, labels taking turns, then each code's
    second cell, and so on. The first ``n_records`` by (rank, cell) are kept.
    So a crowd of similar vectors, which shares few codes, weighs no more than
    its codes, and no label is left behind.

    Returns ``job_id, place, datum_id, label, code``; places run from 1. A job
    with fewer usable records than asked for gets them all. A null job split
    means all records; a null record split belongs only to those. Null labels
    are a label of their own. Repeated ``datum_id`` count once; ties fall to
    the smaller id.

    Ranks and cuts are computed from counts per hash slice, per cell and per
    rank; no group is sorted as a whole.
    """
    rows = datum.where(F.expr("datum_id is not null") & F.expr(usable("float_data")))
    rows = rows.select("datum_id", norm_split("split").alias("split"), "label", F.expr(grid_bits(bits)).alias("code"))
    rows = rows.groupBy("datum_id").agg(F.min(F.struct("split", "label", "code")).alias("r")).select("datum_id", "r.*")
    j = jobs.where("n_records > 0").select("job_id", norm_split("split").alias("want"), F.col("n_records").cast("bigint").alias("k"))
    # Jobs are a table of settings, a handful of rows; each record goes to the jobs of its split and to those for all.
    rows = rows.join(j, F.col("want").isNull() | (F.col("want") == F.col("split")))
    rows = rows.select("job_id", "k", "datum_id", "label", "code").withColumn("u", text_unit("datum_id", seed=seed))
    ranked = rank_by_unit(rows, ["job_id", "label", "code"], "u", "datum_id").where("rank <= k")
    cells = ranked.where("rank = 1").select("job_id", "label", "code", text_unit("label", "code", seed=seed + 1).alias("h"))
    cells = cells.withColumn("turn", F.row_number().over(W.partitionBy("job_id", "code").orderBy("h", "label")))
    cells = cells.withColumn("round", F.row_number().over(W.partitionBy("job_id", "turn", "label").orderBy("h", "code")))
    cell = cells.select(F.col("job_id").alias("j"), F.col("label").alias("l"), F.col("code").alias("c"), "turn", "round", "h")
    placed = ranked.join(cell, (F.col("job_id") == F.col("j")) & (F.col("code") == F.col("c")) & F.col("label").eqNullSafe(F.col("l"))).drop("j", "l", "c")
    # How many records come before each (rank, turn, round)?
    steps = placed.groupBy("job_id", "rank", "turn", "round").agg(F.count(F.lit(1)).alias("n"))
    per_rank = steps.groupBy("job_id", "rank").agg(F.sum("n").alias("of_rank"))
    before_rank = per_rank.select("job_id", "rank", (F.sum("of_rank").over(W.partitionBy("job_id").orderBy("rank")) - F.col("of_rank")).alias("earlier"))
    within = steps.select("job_id", "rank", "turn", "round", (F.sum("n").over(W.partitionBy("job_id", "rank").orderBy("turn", "round")) - F.col("n")).alias("ahead"))
    kept = placed.join(before_rank, ["job_id", "rank"]).where("earlier < k").join(within, ["job_id", "rank", "turn", "round"]).where("earlier + ahead < k")
    step = W.partitionBy("job_id", "rank", "turn", "round").orderBy("h", "label", "code")
    kept = kept.withColumn("place", F.col("earlier") + F.col("ahead") + F.row_number().over(step))
    return kept.where("place <= k").select("job_id", F.col("place").cast("bigint").alias("place"), "datum_id", "label", "code")
