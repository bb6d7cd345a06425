"""Iterative models on small data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.models import lda, logreg, matfact
from tidemark.models.sparse_coding import codes_of, project, soft


def test_gibbs_keeps_tokens_and_raises_likelihood(spark):
    rng = np.random.default_rng(0)
    themes = ["apple pear plum fig".split(), "bolt nut gear cog".split()]
    docs = [(i, " ".join(rng.choice(themes[i % 2], 30)) + (" É7" if i == 3 else "")) for i in range(30)] + [(99, None), (98, "")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    t, history = lda.train(df, 2, 6, 0.1, 0.1)
    first = lda.tokens(df, 2)
    assert t.count() == first.count() == 900
    assert sorted(map(tuple, lda.vocabulary(t).collect())) == sorted(map(tuple, lda.vocabulary(first).collect()))
    h = [r.doc_llh + r.word_llh for r in history.orderBy("round").collect()]
    assert h[-1] > h[0]
    top = {r.word: r.topic for r in lda.word_topic_counts(t).groupBy("word").agg(F.max_by("topic", "n").alias("topic")).collect()}
    assert len({top[w] for w in themes[0]}) == 1 and len({top[w] for w in themes[1]}) == 1


def one_by_one(rows, topics, alpha, beta, seed):
    """A round of Gibbs sampling token by token."""
    words, nk = {}, np.zeros(topics)
    for _, _, w, z in rows:
        words.setdefault(w, np.zeros(topics))[z] += 1
        nk[z] += 1
    out, totals = [], nk + len(words) * beta
    for doc in sorted({r[0] for r in rows}):
        mine = sorted(r for r in rows if r[0] == doc)
        nd = np.bincount([r[3] for r in mine], minlength=topics).astype(float)
        rng = np.random.default_rng([seed, doc & 0x7FFFFFFF])
        for _, pos, w, z in mine:
            own = np.eye(topics)[z]
            nd -= own
            c = np.cumsum((nd + alpha) * np.maximum(words[w] - own + beta, beta) / (totals - own))
            new = int(np.searchsorted(c, rng.random() * c[-1]))
            nd[new] += 1
            out.append((doc, pos, w, new))
    return out


def test_gibbs_round_in_shares_of_bounded_size(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = [f"{a}{b}" for a in "abcdefg" for b in "hijklmnop"]
    docs = [(i * 7 - 3, " ".join(rng.choice(words, int(rng.integers(0, 60))))) for i in range(80)]
    t = lda.random_topics(lda.tokens(spark.createDataFrame(docs, "doc_id bigint, text string"), 5), 5, 9).cache()
    want = one_by_one([tuple(r) for r in t.collect()], 5, 0.3, 0.1, 11)
    n = t.count()
    for most in (1 << 19, 100):
        monkeypatch.setattr(lda, "SHARE_TOKENS", most)
        got = sorted(map(tuple, lda.gibbs_round(t, 5, 0.3, 0.1, 11, shares=1).collect()))
        assert got == want
        assert t.groupBy(lda.share_of(n, 1)).count().count() > (10 if most < n else 0)


def test_no_documents(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    t, history = lda.train(df, 3, 1)
    assert t.count() == 0 and history.first().doc_llh == 0.0


def test_classes_are_learned(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    y = (x[:, 0] > 0).astype(int) + (x[:, 1] > 1).astype(int)
    df = spark.createDataFrame([(i, [float(v) for v in r], int(k)) for i, (r, k) in enumerate(zip(x, y))], "id bigint, x array<float>, y int")
    w, h = logreg.train_classes(df, 3, 3, 6, eta=1.0, batch=16)
    rows = h.orderBy("epoch").collect()
    assert rows[-1].cross_entropy < rows[0].cross_entropy and w.count() == 9
    by_join = {(r.id, r.k): r.z for r in logreg.score_by_join(df.limit(20), w).collect()}
    m = np.zeros((3, 3))
    for r in w.collect():
        m[r.k, r.fid] = r.w
    for (i, k), z in by_join.items():
        assert z == pytest.approx(float(x[i].astype(np.float32) @ m[k]), abs=1e-6)
    with pytest.raises(ValueError):
        logreg.class_probabilities(df, w, 10**6, 10**6)


def test_factors_fit(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(12, 2)), rng.normal(size=(9, 2))
    coo = spark.createDataFrame([(i, j, float(a[i] @ b[j])) for i in range(12) for j in range(9) if (i + j) % 3], "i int, j int, x double")
    for rows_first in (False, True):
        left, right, h = matfact.train(coo, 2, 8, 0.02, 0.01, rows_first=rows_first)
        o = [r.objective for r in h.orderBy("iteration").collect()]
        assert o[-1] < o[0] and left.count() == 12 and right.count() == 9


def test_sparse_code_pieces():
    rng = np.random.default_rng(3)
    b = project(rng.normal(size=(6, 10)))
    assert (b**2).sum(axis=1).max() <= 1 + 1e-9
    x = rng.normal(size=(5, 10))
    cost = lambda s: ((x - s @ b) ** 2).sum() + 0.1 * np.abs(s).sum()
    zero = np.zeros((5, 6))
    assert cost(codes_of(x, zero, b, 0.1, 0.05, 20)) < cost(codes_of(x, zero, b, 0.1, 0.05, 2)) < cost(zero)
    assert soft(np.array([-2.0, 0.5, 2.0]), 1.0).tolist() == [-1.0, 0.0, 1.0]
