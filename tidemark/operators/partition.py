"""Ranges, cuts, tilings and relabellings of rows and matrices."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranking import prefix_sum_by_order, rank_by_unit, slices_for
from tidemark.runtime import staged, text_unit


def work_range(total: int, workers: int, worker: int, even: bool = True) -> tuple[int, int]:
    """Rows ``[start, end)`` of a worker: near-even ranges, or equal ones of which the last takes the rest."""
    if even:
        base, more = divmod(total, workers)
        start = worker * base + min(worker, more)
        return start, start + base + (worker < more)
    size = total // workers
    return worker * size, total if worker == workers - 1 else (worker + 1) * size


def batches_of(total: int, size: int) -> int:
    """Batches in one pass; the last wraps around."""
    return math.ceil(total / size)


def numbered(df: DataFrame, order: str, out: str = "row_no") -> DataFrame:
    """Zero-based row numbers by a unique column, without one task that sorts everything (:func:`prefix_sum_by_order`)."""
    return prefix_sum_by_order(df, [order], None, out)


def worker_of(row_no: Column, total: Column | int, workers: int) -> Column:
    """Worker whose near-even range holds a row number."""
    n = F.lit(total) if isinstance(total, int) else total
    base, more = F.floor(n / workers), n % workers
    big = more * (base + 1)
    late = more + F.floor((row_no - big) / F.greatest(base, F.lit(1)))
    return F.when(row_no < big, F.floor(row_no / (base + 1))).otherwise(late).cast("int")


def coo_dims(coo: DataFrame, i: str = "i", j: str = "j") -> DataFrame:
    """``n_rows, n_cols``: largest ids plus one; 0 of an empty matrix."""
    return coo.agg(F.coalesce(F.max(i) + 1, F.lit(0)).cast("int").alias("n_rows"), F.coalesce(F.max(j) + 1, F.lit(0)).cast("int").alias("n_cols"))


def tile(coo: DataFrame, down: int, across: int, n_rows: int, n_cols: int) -> DataFrame:
    """The matrix repeated ``down`` × ``across`` times with shifted ids."""
    copies = F.explode(F.sequence(F.lit(0), F.lit(down * across - 1))).alias("__t")
    t = coo.select("i", "j", "x", copies)
    return t.select((F.col("i") + F.floor(F.col("__t") / across) * n_rows).cast("int").alias("i"), (F.col("j") + F.col("__t") % across * n_cols).cast("int").alias("j"), "x")


def relabel(coo: DataFrame, mapping: DataFrame, col: str = "i") -> DataFrame:
    """New ids of one side by a table ``(old, new)``; ids without a new one are dropped."""
    other = [c for c in coo.columns if c != col]
    return coo.join(mapping, F.col(col) == F.col("old")).select(F.col("new").alias(col), *other)


def hash_permutation(ids: DataFrame, col: str, seed: int = 0) -> DataFrame:
    """``old, new``: a permutation of the distinct ids onto 0…n−1 that depends only on ids and seed."""
    d = ids.select(F.col(col).alias("old")).distinct().withColumn("__u", text_unit("old", seed=seed)).withColumn("__all", F.lit(0))
    return rank_by_unit(d, ["__all"], "__u", "old", "__rank", buckets=slices_for(d.count())).select("old", (F.col("__rank") - 1).cast("int").alias("new"))


def split_by_weight(rows: DataFrame, key: str, weight: str, target: Column | int, out: str = "part") -> DataFrame:
    """Number of the part of each row: running weight in the order of a key, over the target, rounded down.

    No row is cut; a part is over the target by less than one row.
    """
    placed = prefix_sum_by_order(rows, [key], weight, "__before")
    t = F.lit(target) if isinstance(target, int) else target
    return placed.withColumn(out, F.floor(F.col("__before") / t).cast("int")).drop("__before")


def greedy_parts(sizes: DataFrame, key: str, weight: str, target: float, mean: float, block: int = 65_536) -> DataFrame:
    """``key, weight, part``: sequential cut by a unique key; a part ends when its weight passes target − mean.

    The cut begins anew at each part, so it can't come from one running sum.
    Rows lie in blocks of ``block`` by their order, a task each. All that a
    block needs to know of those before it is the weight of the part that is
    open at its first row. Which row then closes that part is among the rows
    whose sum stays within the limit, no more than a part has; each block tells
    for each of these how many parts follow and what weight is open at its end.
    One task hands the weight on through these few rows a block, and each block
    is cut. The result is that of one pass over all rows, whatever ``block``.
    Weights are not negative; a null counts as 0 and stays null.
    """
    limit = target - mean
    kinds = {c: sizes.schema[c].dataType.simpleString() for c in (key, weight)}
    rows = numbered(sizes.select(key, weight), key, "__at").withColumn("__block", F.floor(F.col("__at") / block))
    rows = staged(rows, "greedy-rows")

    def ordered(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        pdf = pdf.sort_values("__at")
        return pdf, np.concatenate([[0.0], np.cumsum(pdf[weight].fillna(0).to_numpy(float))])

    def close(total: np.ndarray, start: int, held: float) -> int:
        """Rows up to the one that ends a part with so much weight before ``start``; past the last if none does."""
        return int(np.searchsorted(total[1:], total[start] + limit - held, side="right")) + 1

    def answers(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, total = ordered(pdf)
        n, known, out = len(total) - 1, {}, []
        for end in range(1, min(close(total, 0, 0.0), n) + 1):
            at, path = end, []
            while at not in known and at <= n and (after := close(total, at, 0.0)) <= n:
                path.append(at)
                at = after
            parts, tail = known.get(at, (0, total[n] - total[min(at, n)]))
            for p in reversed(path):
                parts += 1
                known[p] = parts, tail
            out.append((int(pdf["__block"].iloc[0]), end, float(total[end]), parts + 1, float(tail)))
        out.append((int(pdf["__block"].iloc[0]), n + 1, float(total[n]), 0, float(total[n])))
        return pd.DataFrame(out, columns=["__block", "end", "reach", "parts", "tail"])

    def hand_on(pdf: pd.DataFrame) -> pd.DataFrame:
        held, part, out = 0.0, 0, []
        for number, group in pdf.sort_values(["__block", "end"]).groupby("__block", sort=True):
            out.append((number, held, part))
            closing = group[:-1][group["reach"][:-1] + held > limit]
            if len(closing):
                part, held = part + int(closing["parts"].iloc[0]), float(closing["tail"].iloc[0])
            else:
                held += float(group["reach"].iloc[-1])
        return pd.DataFrame(out, columns=["__block", "__held", "__part"])

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, total = ordered(pdf)
        n, part, at, held = len(total) - 1, int(pdf["__part"].iloc[0]), 0, float(pdf["__held"].iloc[0])
        parts = np.empty(n, np.int64)
        while at < n:
            end = min(close(total, at, held), n)
            parts[at:end] = part
            at, part, held = end, part + 1, 0.0
        return pd.DataFrame({key: pdf[key], weight: pdf[weight], "part": parts})

    told = rows.groupBy("__block").applyInPandas(answers, "__block bigint, end int, reach double, parts bigint, tail double")
    entered = told.withColumn("__all", F.lit(0)).groupBy("__all").applyInPandas(hand_on, "__block bigint, __held double, __part bigint")
    return rows.join(entered, "__block").groupBy("__block").applyInPandas(cut, f"{key} {kinds[key]}, {weight} {kinds[weight]}, part int")


def quantile_labels(scores: DataFrame, score: str, buckets: int, key: str, out: str = "label") -> DataFrame:
    """Label of each row: the number of the first cut point not below its score.

    Cut point l is the score at sorted place ``(l + 1) * n / buckets`` (from 0),
    the last the largest score. Places are exact and come from counts per slice
    of the ordered scores; rows are then labelled by comparing with ``buckets``
    values.
    """
    n = scores.count()
    per = [min((l + 1) * n // buckets, n - 1) if l < buckets - 1 else n - 1 for l in range(buckets)] if n else []
    placed = prefix_sum_by_order(scores.select(score, key), [score, key], None, "__place")
    at = placed.where(F.col("__place").isin(sorted(set(per)))).select("__place", F.col(score).alias("__v"))  # as many rows as buckets
    found = at.agg(F.map_from_entries(F.collect_list(F.struct("__place", "__v"))).alias("__m"))
    cuts = found.select(F.array(*[F.try_element_at("__m", F.lit(p).cast("bigint")) for p in per]).alias("__cuts")) if per else found.select(F.array(F.lit(0.0)).alias("__cuts"))
    low = F.array_min(F.filter(F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda i: F.when(F.get("__cuts", i) >= F.col(score), i)), lambda v: v.isNotNull()))
    return scores.crossJoin(F.broadcast(cuts)).withColumn(out, F.coalesce(low, F.lit(buckets - 1)).cast("int")).drop("__cuts")
