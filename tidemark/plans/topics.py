"""Queries on topic models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.models import lda
from tidemark.plans.common import r
from tidemark.runtime import table

K, ALPHA, BETA = 5, 0.7, 0.1


def _tokens(spark, root):
    return lda.tokens(table(spark, root, "documents").where("text is not null"), K)


def word_topic_counts(spark, root):
    return lda.word_topic_counts(_tokens(spark, root))


def topic_counts(spark, root):
    return lda.topic_counts(_tokens(spark, root))


def doc_topic_counts(spark, root):
    return lda.doc_topic_counts(_tokens(spark, root))


def vocab(spark, root):
    return lda.vocabulary(_tokens(spark, root))


def corpus_totals(spark, root):
    t = _tokens(spark, root)
    return t.agg(F.count(F.lit(1)).alias("tokens"), F.count_distinct("word").alias("words"), F.count_distinct("doc_id").alias("docs"))


def doc_llh(spark, root):
    return lda.doc_llh(_tokens(spark, root), K, ALPHA).select("doc_id", r("llh", 4).alias("llh"))


def word_llh(spark, root):
    return lda.word_llh(_tokens(spark, root), K, BETA).select(r("llh", 2).alias("llh"))


def token_offsets(spark, root):
    """Where each word's tokens begin in its document, words in order."""
    from pyspark.sql import Window as W

    c = _tokens(spark, root).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("doc_id").orderBy("word")
    return c.select("doc_id", "word", "n", (F.sum("n").over(w) - F.col("n")).alias("offset"))


def gibbs_mass(spark, root):
    m = lda.gibbs_mass(_tokens(spark, root), K, ALPHA, BETA)
    return m.groupBy("doc_id").agg(r(F.sum("s"), 4).alias("s"), r(F.sum("r"), 4).alias("r"), r(F.sum("q"), 4).alias("q"))


QUERIES = {q.__name__: q for q in (word_topic_counts, topic_counts, doc_topic_counts, vocab, corpus_totals, doc_llh, word_llh, token_offsets, gibbs_mass)}

_T = """ws AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL),
    t AS (SELECT doc_id, pos, word, CAST((doc_id * 31 + pos * 17) % 5 AS INT) AS topic FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM ws))"""

ORACLE = {
    "word_topic_counts": f"WITH {_T} SELECT word, topic, count(*) AS n FROM t GROUP BY 1, 2",
    "topic_counts": f"WITH {_T} SELECT topic, count(*) AS n FROM t GROUP BY 1",
    "doc_topic_counts": f"WITH {_T} SELECT doc_id, topic, count(*) AS n FROM t GROUP BY 1, 2",
    "vocab": f"WITH {_T} SELECT word, count(*) AS n FROM t GROUP BY 1",
    "corpus_totals": f"WITH {_T} SELECT count(*) AS tokens, count(DISTINCT word) AS words, count(DISTINCT doc_id) AS docs FROM t",
    "doc_llh": f"""WITH {_T}, c AS (SELECT doc_id, topic, count(*) AS n FROM t GROUP BY 1, 2)
        SELECT doc_id, round(sum(lgamma(n + 0.7) - lgamma(0.7)) - (lgamma(sum(n) + 3.5) - lgamma(3.5)), 4) + 0.0 AS llh FROM c GROUP BY 1""",
    "word_llh": f"""WITH {_T}, v AS (SELECT count(DISTINCT word) * 0.1::DOUBLE AS vb FROM t), c AS (SELECT word, topic, count(*) AS n FROM t GROUP BY 1, 2), k AS (SELECT topic, count(*) AS n FROM t GROUP BY 1)
        SELECT round((SELECT sum(lgamma(n + 0.1) - lgamma(0.1)) FROM c) - (SELECT sum(lgamma(n + vb) - lgamma(vb)) FROM k, v), 2) + 0.0 AS llh""",
    "token_offsets": f"WITH {_T}, c AS (SELECT doc_id, word, count(*) AS n FROM t GROUP BY 1, 2) SELECT doc_id, word, n, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY word) - n AS BIGINT) AS \"offset\" FROM c",
    "gibbs_mass": f"""WITH {_T}, v AS (SELECT count(DISTINCT word) * 0.1::DOUBLE AS vb FROM t), k AS (SELECT topic, 1 / (count(*) + any_value(vb)) AS inv FROM t, v GROUP BY 1),
        s AS (SELECT 0.7 * 0.1 * sum(inv) AS s FROM k), d AS (SELECT doc_id, topic, count(*) AS n FROM t GROUP BY 1, 2), w AS (SELECT word, topic, count(*) AS n FROM t GROUP BY 1, 2),
        rr AS (SELECT doc_id, sum(n * 0.1 * inv) AS r FROM d JOIN k USING (topic) GROUP BY 1),
        p AS (SELECT doc_id, word, count(*) AS m FROM t GROUP BY 1, 2),
        q AS (SELECT p.doc_id, p.word, any_value(m) AS m, sum((coalesce(d.n, 0) + 0.7) * w.n * inv) AS q FROM p JOIN w ON w.word = p.word JOIN k ON k.topic = w.topic LEFT JOIN d ON d.doc_id = p.doc_id AND d.topic = w.topic GROUP BY 1, 2)
        SELECT doc_id, round(any_value(s) * sum(m), 4) + 0.0 AS s, round(any_value(r) * sum(m), 4) + 0.0 AS r, round(sum(q * m), 4) + 0.0 AS q FROM q JOIN rr USING (doc_id), s GROUP BY 1""",
}
