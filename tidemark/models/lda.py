"""Topic models by Gibbs sampling.

A corpus is a table of tokens ``(doc_id, pos, word, topic)``. Counts are plain
aggregations; log likelihoods use rising factorials, so that no gamma function
is needed for the counts; sampling runs over hash shares of the documents
against counts of the last round.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import vec
from tidemark.runtime import discard, staged

# Tokens of a group of documents that a task has in memory, about 30 bytes each and as much again for the counts of its words.
SHARE_TOKENS = 1 << 18


def tokens(documents: DataFrame, topics: int, text: str = "text") -> DataFrame:
    """Lower-case runs of a–z as words, with a first topic that follows from document and place; null texts have none."""
    words = F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: w != "")
    t = documents.where(F.col(text).isNotNull()).select("doc_id", F.posexplode(words).alias("pos", "word"))
    return t.withColumn("topic", ((F.col("doc_id") * 31 + F.col("pos") * 17) % topics).cast("int"))


def random_topics(tokens_: DataFrame, topics: int, seed: int = 0) -> DataFrame:
    """Topics drawn evenly by a hash of document, place and seed."""
    return tokens_.withColumn("topic", F.pmod(F.xxhash64("doc_id", "pos", F.lit(seed)), F.lit(topics)).cast("int"))


def word_topic_counts(t: DataFrame) -> DataFrame:
    return t.groupBy("word", "topic").agg(F.count(F.lit(1)).alias("n"))


def topic_counts(t: DataFrame) -> DataFrame:
    return t.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


def doc_topic_counts(t: DataFrame) -> DataFrame:
    return t.groupBy("doc_id", "topic").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(t: DataFrame) -> DataFrame:
    return t.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def doc_llh(t: DataFrame, topics: int, alpha: float) -> DataFrame:
    """``doc_id, llh``: lnΓ(Kα) − K·lnΓ(α) + Σ lnΓ(n_dk + α) − lnΓ(n_d + Kα); the constants cancel."""
    per = doc_topic_counts(t).groupBy("doc_id").agg(F.sum("n").alias("n"), F.sum(vec.log_rising("n", alpha)).alias("s"))
    return per.select("doc_id", (F.col("s") - vec.log_rising("n", topics * alpha)).alias("llh"))


def _log_gamma_column(n: Column, a: float) -> Column:
    """lnΓ(n + a) by its asymptotic series after a shift to at least 8; error below 1e-10."""
    x = n.cast("double") + F.lit(a)
    shift = F.greatest(F.lit(0), F.ceil(F.lit(8.0) - x)).cast("int")
    y = x + shift
    series = (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0))) - 1 / (1680 * F.pow(y, F.lit(7.0)))
    down = F.when(shift > 0, F.aggregate(F.sequence(F.lit(0), F.greatest(shift, F.lit(1)) - 1), F.lit(0.0), lambda s, i: s + F.ln(x + i))).otherwise(0.0)
    return series - down


def word_llh(t: DataFrame, topics: int, beta: float) -> DataFrame:
    """``llh``: K(lnΓ(Vβ) − V·lnΓ(β)) + Σ over words and topics of lnΓ(n_wk + β) − Σ over topics of lnΓ(n_k + Vβ).

    V is the number of words that occur; a word's topics without tokens add
    lnΓ(β) each, which is what cancels the constant.
    """
    v = vocabulary(t).agg(F.count(F.lit(1)).alias("v"))
    words = word_topic_counts(t).agg(F.coalesce(F.sum(vec.log_rising("n", beta)), F.lit(0.0)).alias("w"))
    # Topics without tokens weigh as much as the constant gives for them, so only those with tokens count.
    per = topic_counts(t).crossJoin(F.broadcast(v))  # one row
    lg = lambda n: _log_gamma_column(n, 0.0)
    tops = per.agg(F.coalesce(F.sum(lg(F.col("n") + F.col("v") * beta) - lg(F.col("v") * F.lit(beta))), F.lit(0.0)).alias("t"))
    return words.crossJoin(tops).select((F.col("w") - F.col("t")).alias("llh"))


def gibbs_mass(t: DataFrame, topics: int, alpha: float, beta: float) -> DataFrame:
    """``doc_id, pos, s, r, q``: the three parts of each token's sampling mass at the given counts.

    s = Σ αβ/(n_k + Vβ), r = Σ n_dk·β/(n_k + Vβ), q = Σ (n_dk + α)·n_wk/(n_k + Vβ).
    """
    v = vocabulary(t).agg((F.count(F.lit(1)) * beta).alias("vb"))
    tops = topic_counts(t).crossJoin(F.broadcast(v)).select("topic", (1 / (F.col("n") + F.col("vb"))).alias("inv"))
    # Every topic has a term of s, also one without tokens; there are `topics` of them in all.
    used = tops.agg(F.sum("inv").alias("si"), F.count(F.lit(1)).alias("c")).crossJoin(v).select((alpha * beta * (F.coalesce("si", F.lit(0.0)) + (topics - F.col("c")) / F.col("vb"))).alias("s"))
    docs = doc_topic_counts(t).join(F.broadcast(tops), "topic")
    per_doc = docs.groupBy("doc_id").agg(F.sum(F.col("n") * beta * F.col("inv")).alias("r"))
    words = word_topic_counts(t).withColumnRenamed("n", "nw").join(F.broadcast(tops), "topic")
    base = words.groupBy("word").agg(F.sum(alpha * F.col("nw") * F.col("inv")).alias("qa"))
    pairs = t.select("doc_id", "word").distinct()
    cross = pairs.join(doc_topic_counts(t), "doc_id").join(words, ["word", "topic"]).groupBy("doc_id", "word").agg(F.sum(F.col("n") * F.col("nw") * F.col("inv")).alias("qd"))
    return t.join(per_doc, "doc_id").join(base, "word").join(cross, ["doc_id", "word"], "left").crossJoin(F.broadcast(used)).select("doc_id", "pos", "s", "r", (F.col("qa") + F.coalesce("qd", F.lit(0.0))).alias("q"))


def share_of(tokens_: float, shares: int) -> Column:
    """The share of a document: a hash into ``shares``, or into as many as hold ``SHARE_TOKENS`` tokens each."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(max(shares, -(-int(tokens_) // SHARE_TOKENS))))


def _draw(t: pa.Table, words: pa.Table, totals: np.ndarray, alpha: float, beta: float, seed: int) -> pa.Table:
    """A share's tokens with new topics; documents go abreast, the first tokens of all, then the second ones, and so on."""
    topics = len(totals)
    t = t.take(pa.array(np.lexsort((t.column("pos").to_numpy(), t.column("doc_id").to_numpy()))))
    ids, z = t.column("doc_id").to_numpy(), t.column("topic").to_numpy().astype(np.int64)
    word = pc.index_in(t.column("word"), value_set=words.column("known").combine_chunks()).to_numpy()
    entries = words.column("counts").combine_chunks()
    of_word = np.repeat(np.arange(len(words)), pc.list_value_length(entries).to_numpy())
    counts = np.zeros((len(words), topics))
    counts[of_word, entries.flatten().field("topic").to_numpy()] = entries.flatten().field("n").to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(ids)))
    nd = np.zeros((len(starts), topics))
    np.add.at(nd, (np.repeat(np.arange(len(starts)), sizes), z), 1.0)
    draws = [np.random.default_rng([seed, int(ids[s]) & 0x7FFFFFFF]).random(n) for s, n in zip(starts, sizes)]
    draws = np.concatenate(draws) if draws else np.zeros(0)
    longest = np.argsort(-sizes, kind="stable")
    starts, sizes, nd = starts[longest], sizes[longest], nd[longest]
    for step in range(int(sizes.max(initial=0))):
        k = int(np.searchsorted(-sizes, -step))  # so many documents are longer
        at, doc = starts[:k] + step, np.arange(k)
        own = np.zeros((k, topics))
        own[doc, z[at]] = 1
        nd[:k] -= own
        p = np.cumsum((nd[:k] + alpha) * np.maximum(counts[word[at]] - own + beta, beta) / (totals - own), axis=1)
        z[at] = np.minimum((p < (draws[at] * p[:, -1])[:, None]).sum(axis=1), topics - 1)
        nd[doc, z[at]] += 1
    return pa.table([t.column("doc_id"), t.column("pos"), t.column("word"), pa.array(z, pa.int32())], ["doc_id", "pos", "word", "topic"])


def gibbs_round(t: DataFrame, topics: int, alpha: float, beta: float, seed: int, shares: int = 32) -> DataFrame:
    """Every token drawn anew once, document by document, against the last round's counts.

    Documents go to at least ``shares`` groups of about ``SHARE_TOKENS`` tokens
    (:func:`share_of`), which a task takes one by one. A group meets the count
    rows of its own words, each once, so no task needs the whole vocabulary's
    and no token carries any. Draws see each other's changes of document counts
    at once and of word counts at the end of the round (a staleness of one
    clock), so they don't depend on the shares.
    """
    v = vocabulary(t).count()
    nk = np.zeros(topics)
    for row in topic_counts(t).collect():  # one number per topic
        nk[row.topic] = row.n
    rows = t.select(share_of(nk.sum(), shares).alias("share"), "doc_id", "pos", "word", "topic")
    words = word_topic_counts(t).groupBy("word").agg(F.collect_list(F.struct("topic", "n")).alias("counts"))
    known = rows.select("share", "word").distinct().join(words, "word").select(F.col("share").alias("to"), F.col("word").alias("known"), "counts")
    totals = nk + v * beta

    def run(mine: pa.Table, own: pa.Table) -> pa.Table:
        return _draw(mine, own, totals, alpha, beta, seed)

    return rows.groupBy("share").cogroup(known.groupBy("to")).applyInArrow(run, "doc_id bigint, pos int, word string, topic int")


def train(documents: DataFrame, topics: int, rounds: int, alpha: float = 0.1, beta: float = 0.1, seed: int = 1, shares: int = 32) -> tuple[DataFrame, DataFrame]:
    """Rounds of Gibbs sampling from random topics; returns tokens with topics and ``round, llh`` of the documents' and words' parts."""
    spark = documents.sparkSession
    t = staged(random_topics(tokens(documents, topics), topics, seed), "tokens")
    history = []
    for n in range(rounds):
        last, t = t, staged(gibbs_round(t, topics, alpha, beta, seed + n, shares), "tokens")
        discard(last)
        d = doc_llh(t, topics, alpha).agg(F.coalesce(F.sum("llh"), F.lit(0.0)).alias("llh")).first().llh
        history.append((n, float(d), float(word_llh(t, topics, beta).first().llh)))
    return t, spark.createDataFrame(history, "round int, doc_llh double, word_llh double")
