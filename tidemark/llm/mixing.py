"""Mixtures of sources that reach target shares of tokens."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tokens import token_counts
from tidemark.operators.ranking import prefix_sum_by_unit, slices_for
from tidemark.runtime import hash_unit, staged

STEPS, HIGHEST = 60, 16.0


def entropy(shares: np.ndarray) -> float:
    """Entropy in nats."""
    p = shares[shares > 0]
    return float(-(p * np.log(p)).sum())


def tempered(natural: np.ndarray, e: float) -> np.ndarray:
    """Token shares to the power of ``e``, normalised; sources without tokens have none."""
    out = np.zeros(len(natural))
    some = natural > 0
    if some.any():
        logs = e * np.log(natural[some])
        out[some] = np.exp(logs - logs.max())
    return out / max(out.sum(), 1e-300)


def mixture_weights(natural: np.ndarray, target: np.ndarray, most: np.ndarray) -> tuple[float, np.ndarray]:
    """One exponent, and the weight of each source of a mixture.

    ``natural`` are the sources' shares of the tokens, ``target`` what they are
    to give, ``most`` the share at which a source would pass its repetition
    limit. Targets are taken to sum to 1. A source gives its target, or its
    limit where that is less; what limited sources and those without tokens
    leave open goes to the others, in proportion to ``natural ** e``. The
    exponent is the one at which the whole mixture has the entropy of the
    targets, as nearly as one in [0, :data:`HIGHEST`] can; if a source would
    then pass its limit, it is raised, towards the sources with most tokens,
    until none does. Where no exponent will do, those over their limits stay at
    it and the rest is shared out again. So weights sum to 1 unless all sources
    are at their limits. The exponent is NaN if the targets left nothing open.
    """
    target = target / max(target.sum(), 1e-300)
    able = (natural > 0) & (target > 0)
    weight = np.where(able, np.minimum(target, most), 0.0)
    wanted, exponent = entropy(target), float("nan")
    while (rest := 1 - weight.sum()) > 1e-12 and (free := able & (weight < most * (1 - 1e-12))).any():
        part = np.where(free, natural, 0)

        def at(e: float, held: np.ndarray = weight, part: np.ndarray = part, rest: float = rest) -> np.ndarray:
            return held + rest * tempered(part, e)

        exponent = _bisect(lambda e: entropy(at(e)) <= wanted, 0.0)  # noqa: B023
        if (at(exponent) > most).any():
            exponent = _bisect(lambda e: not (at(e) > most).any(), exponent)  # noqa: B023
        weight = np.minimum(at(exponent), np.where(able, most, 0))
    return exponent, weight


def _bisect(holds, low: float) -> float:
    """The smallest number from ``low`` to :data:`HIGHEST` from which a condition holds; the latter if it doesn't hold there."""
    if holds(low):
        return low
    high = HIGHEST
    for _ in range(STEPS):
        mid = (low + high) / 2
        low, high = (low, mid) if holds(mid) else (mid, high)
    return high


def source_budgets(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """Tokens each source of each mixture is to give.

    ``sources`` has ``source, tokens`` of the whole corpus. Tables of settings
    by source; one small task per mixture.
    """
    totals = sources.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all_tokens"))
    once = targets.groupBy("mix_id", "source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"), F.max("size_percent").alias("size_percent"))
    t = once.join(sources, "source", "left").crossJoin(totals)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        tokens = pdf.tokens.fillna(0).to_numpy(float)
        size = pdf.size_percent.fillna(0).to_numpy(float).max() / 100 * float(pdf.all_tokens.iloc[0])
        target = pdf.target_share.fillna(0).to_numpy(float)
        most = pdf.max_repeats.fillna(0).to_numpy(float) * tokens / size if size > 0 else np.zeros(len(pdf))
        exponent, weight = mixture_weights(tokens / max(float(pdf.all_tokens.iloc[0]), 1), target, most)
        return pd.DataFrame({"mix_id": pdf.mix_id, "source": pdf.source, "target_share": pdf.target_share, "size": size, "available": tokens, "exponent": None if np.isnan(exponent) else exponent, "budget": np.floor(weight * size + 1e-6)})

    return t.groupBy("mix_id").applyInPandas(one, "mix_id bigint, source string, target_share double, size double, available double, exponent double, budget double")


def mix_sources(documents: DataFrame, targets: DataFrame, vocabulary: str | None = None, seed: int = 8) -> tuple[DataFrame, DataFrame]:
    """Documents of each mixture, copy by copy, and the shares reached.

    Returns ``mixture(mix_id, source, doc_id, pass, start, n_tokens)`` with one
    row per copy of a document: ``pass`` is the block it belongs to, ``start``
    how many tokens its source gives before it. And ``shares(mix_id, source,
    target_share, available_tokens, budget_tokens, tokens, share, deficit,
    exponent)`` with one row per source of a mixture: ``share`` is of the
    tokens that were drawn, ``deficit`` how many tokens its target lacks.

    A source's budget is its weight (:func:`mixture_weights`) times the size.
    It is met in blocks. A block is one pass over the source, each in an order
    of its own, of a hash: as many whole passes as fit, then the start of one
    more, up to the document nearest to the budget. So no document comes more
    often than the limit, and the budget is missed by at most half a document.
    Orders are cut by running sums per hash slice; no source is sorted in one
    task.

    Null sources, and documents without tokens, take part in no mixture. A
    source without documents gets a row of shares with 0 tokens. A source
    listed repeatedly in a mixture counts once: its targets are added, the
    smallest limit holds. Targets count relative to their sum.
    """
    docs = documents.where("source is not null and doc_id is not null").select("doc_id", "source", "text")
    counts = staged(token_counts(docs, ["doc_id", "source"], "text", vocabulary).where("n_tokens > 0"), "p8-counts")
    sources = counts.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    budgets = staged(source_budgets(targets, sources), "p8-budgets")
    whole = F.floor(F.col("budget") / F.col("available")).cast("bigint")
    b = budgets.where("budget > 0 and available > 0").select("mix_id", "source", "available", whole.alias("whole"), (F.col("budget") - whole * F.col("available")).alias("rest"))
    copies = counts.join(b, "source").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("whole"))))
    ordered = prefix_sum_by_unit(copies.withColumn("u", hash_unit("mix_id", "pass", "doc_id", seed=seed)), ["mix_id", "source", "pass"], "u", "doc_id", "n_tokens", buckets=slices_for(counts.count()))
    drawn = ordered.where("pass < whole or before + n_tokens / 2 <= rest")
    start = (F.col("pass") * F.col("available") + F.col("before")).cast("bigint").alias("start")
    mixture = staged(drawn.select("mix_id", "source", "doc_id", F.col("pass").cast("int").alias("pass"), start, "n_tokens"), "p8-mixture")
    given = mixture.groupBy("mix_id", "source").agg(F.sum("n_tokens").alias("tokens"))
    totals = given.groupBy("mix_id").agg(F.sum("tokens").alias("total"))
    tokens = F.coalesce("tokens", F.lit(0)).cast("bigint")
    shares = budgets.join(given, ["mix_id", "source"], "left").join(totals, "mix_id", "left").select(
        "mix_id", "source", "target_share", F.col("available").cast("bigint").alias("available_tokens"), F.col("budget").cast("bigint").alias("budget_tokens"), tokens.alias("tokens"),
        F.coalesce(tokens / F.col("total"), F.lit(0.0)).alias("share"), F.greatest(F.lit(0.0), F.coalesce(F.col("target_share") * F.col("size"), F.lit(0.0)) - tokens).alias("deficit"), "exponent",
    )
    return mixture, shares
