"""Samples, overlaps, mixtures on small tables."""

from collections import Counter
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing, overlap, sampling

AT = datetime(2024, 1, 1)
DATUM = "datum_id bigint, split string, label int, source string, ingested_at timestamp, u double, rank int, available bigint, quota bigint"
TARGETS = "plan_id bigint, split string, sample_percent double, label int, target_share double, min_records bigint, rate string"


def records(spark, rows):
    return spark.createDataFrame([(i, s, l, "x", AT, 0.5, 3, 1, 2) for i, s, l in rows], DATUM)


def test_sample_meets_targets(spark):
    rows = [(i, " TRAIN " if i % 2 else "train", 0 if i % 3 else 1 + i % 7) for i in range(3000)]
    rows += [(5000 + i, "train", None) for i in range(50)] + [(6000 + i, None, 0) for i in range(50)] + rows[:20] + [(None, "train", 0)]
    targets = [(1, "Train", 20.0, 0, 0.5, 5), (1, "Train", 20.0, 1, 0.2, 5), (1, "Train", 20.0, 2, 0.29, 5), (1, "Train", 20.0, 99, 0.01, 4), (2, "val", 10.0, 0, 1.0, 1)]
    sample, report = sampling.proportional_sample(records(spark, rows), spark.createDataFrame([(*t, "z") for t in targets], TARGETS))
    total = 3000
    have = {l: sum(1 for i, _, k in rows[:3000] if k == l) for l in (0, 1, 2)}
    rep = {(r.plan_id, r.label): r for r in report.collect()}
    assert len(rep) == 5
    for _, _, pct, label, share, least in targets[:3]:
        wanted = max(least, share * pct / 100 * total)
        r = rep[1, label]
        assert r.available == have[label] and r.wanted == pytest.approx(wanted)
        assert r.drawn == min(have[label], -(-wanted // 1))
        assert (r.deficit > 0) == (have[label] < wanted)
    assert rep[1, 99].drawn == 0 and rep[1, 99].deficit == 6.0
    assert rep[2, 0].available == 0 and rep[2, 0].deficit == 1.0
    got = sample.collect()
    assert len({(r.plan_id, r.datum_id) for r in got}) == len(got) == sum(r.drawn for r in rep.values())
    by_id = {i: k for i, _, k in rows if i is not None}
    assert all(by_id[r.datum_id] == r.label for r in got)


def test_sample_of_nothing(spark):
    targets = spark.createDataFrame([(1, "train", 10.0, 3, 1.0, 2, "z")], TARGETS)
    sample, report = sampling.proportional_sample(records(spark, []), targets)
    assert sample.count() == 0 and report.first().deficit == 2.0
    sample, report = sampling.proportional_sample(records(spark, [(1, "train", 1)]), targets.limit(0))
    assert sample.count() == 0 and report.count() == 0


IMAGE = "datum_id bigint, split string, source string, channels int, height int, width int, data binary, label int, content string, cid int, code int, bits0 int"


def images(spark, rows):
    return spark.createDataFrame([(i, s, src, c, h, w, None if d is None else bytearray(d), 1, "a", 1, 2, 3) for i, s, src, c, h, w, d in rows], IMAGE)


def smooth(rng, c, h, w):
    y, x = np.mgrid[0:h, 0:w] / max(h, w)
    z = sum(rng.normal(0, 30) * np.cos(rng.uniform(0, 6) * x + rng.uniform(0, 6) * y + rng.uniform(0, 6)) for _ in range(5))
    return np.clip(rng.uniform(60, 190) + z[None] + rng.normal(0, 8, (c, h, w)), 6, 249).astype(np.uint8)


def test_overlap_is_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = []

    def add(split, img, src="s"):
        rows.append((len(rows), split, src, *img.shape, img.tobytes()))

    for k in range(150):
        shape = [(1, 16, 16), (3, 8, 8), (1, 12, 12)][k % 3]
        a = smooth(rng, *shape)
        add("train", a)
        b = a.astype(int)
        kind = k % 8
        if kind == 1:
            b = b + rng.integers(-4, 5, shape)
        elif kind == 2:
            b = b + rng.integers(-3, 4)
        elif kind == 3:
            b[0, 2:4, 3:5] += 100
        elif kind == 4:
            b = rng.integers(0, 256, shape)
        elif kind == 5:
            b = b + 7
        elif kind == 6:
            b = b + rng.integers(-2, 3, shape)
        b = np.clip(b, 0, 255).astype(np.uint8)
        add(["val", " Test", "TEST "][k % 3], b[..., ::-1] if k % 5 == 0 else b, "t" if k % 2 else None)
    flat = np.full((1, 16, 16), 7, np.uint8)
    for s in ("train",) * 4 + ("val",) * 3 + (None, "other"):
        add(s, flat, "f")
    add("val", flat.reshape(1, 8, 32), "f")
    good = list(rows)
    rows += [(900, "val", "s", 1, 16, 16, None), (901, "val", "s", 1, 16, 16, b""), (902, "train", "s", 1, 16, 15, flat.tobytes()), (903, "val", "s", None, 16, 16, flat.tobytes()), (None, "val", "s", 1, 16, 16, flat.tobytes()), rows[0], rows[1]]
    want = set()
    for i, s, _, c, h, w, d in good:
        for j, t, _, c2, h2, w2, e in good:
            if s == "train" and (t or "").strip().lower() in ("val", "test") and (c, h, w) == (c2, h2, w2):
                a, b = (np.frombuffer(z, np.uint8).reshape(c, h, w).astype(int) for z in (d, e))
                if min(np.abs(a - b).mean(), np.abs(a - b[..., ::-1]).mean()) <= 3:
                    want.add((i, j))
    pairs = overlap.split_overlap(images(spark, rows))
    got = [(r.train_id, r.other_id) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 80
    counts = overlap.overlap_counts(pairs).collect()
    assert sum(r.pairs for r in counts) == len(want)
    assert {(r.split, r.source): (r.pairs, r.records, r.train_records) for r in counts}["val", "f"] == (12, 3, 4)


def test_overlap_keeps_large_and_uniform_changes(spark):
    rng = np.random.default_rng(7)
    rows, want = [], set()
    for k in range(240):
        shape = [(3, 8, 8), (1, 12, 12), (1, 16, 16), (6, 5, 7)][k % 4]
        a = smooth(rng, *shape)
        if k % 5 == 4:
            a = (120 + a.astype(int) % 2).astype(np.uint8)
        b = a.astype(int)
        if k % 5 == 0:  # one column of pixels moves, as far as the average allows
            b[..., k % shape[2]] += 3 * shape[2]
        elif k % 5 == 1:
            b[0, :, k % shape[2]] = 255 - b[0, :, k % shape[2]]
        elif k % 5 == 2:  # a few bytes turn black or white
            at = rng.permutation(b.size)[: b.size // 45]
            b.ravel()[at] = rng.choice([0, 255], len(at))
        elif k % 5 == 3:
            b[:, k % shape[1]] -= 3 * shape[1]
        else:
            b += 3
        b = np.clip(b, 0, 255)
        if np.abs(a - b).mean() <= 3:
            want.add((2 * k, 2 * k + 1))
        rows += [(2 * k, "train", "s", *shape, a.tobytes()), (2 * k + 1, "val", "s", *shape, (b[..., ::-1] if k % 3 else b).astype(np.uint8).tobytes())]
    got = {(r.train_id, r.other_id) for r in overlap.split_overlap(images(spark, rows)).collect()}
    assert len(want) > 120 and not want - got


def test_no_overlap(spark):
    assert overlap.split_overlap(images(spark, [])).count() == 0
    assert overlap.split_overlap(images(spark, [(1, "train", "s", 1, 1, 1, b"a"), (2, "train", "s", 1, 1, 1, b"a")])).count() == 0
    assert overlap.split_overlap(images(spark, [(1, "train", "s", 1, 1, 1, b"a"), (2, "val", "s", 1, 1, 1, b"b")])).count() == 1


DOCS = "doc_id bigint, text string, source string, pass int, tokens string, n_tokens string"
MIX = "mix_id bigint, source string, target_share double, max_repeats int, size_percent double, available string"


def test_mixture_budgets(spark):
    docs = [(i, "one two three four five " * (1 + i % 4), "big") for i in range(400)] + [(1000 + i, "a b c d " * 5, "small") for i in range(20)] + [(2000, "", "big"), (2001, None, "big"), (2002, "x", None), (2003, "x y", "unnamed")]
    docs += [(3000 + i, "p q r " * 6, "third") for i in range(90)]
    df = spark.createDataFrame([(*d, 1, "z", "z") for d in docs], DOCS)
    listed = [(1, "big", 0.7, 1, 50.0, "z"), (1, "small", 0.3, 2, 50.0, "z"), (2, "small", 0.4, 30, 30.0, "z"), (2, "big", 0.3, 2, 30.0, "z"), (2, "third", 0.1, 9, 30.0, "z"), (2, "third", 0.1, 7, 30.0, "z"), (2, "gone", 0.1, 2, 30.0, "z")]
    mixture, shares = mixing.mix_sources(df, spark.createDataFrame(listed, MIX))
    s = {(r.mix_id, r.source): r for r in shares.collect()}
    m = mixture.collect()
    limits = {(1, "big"): 1, (1, "small"): 2, (2, "small"): 30, (2, "big"): 2, (2, "third"): 7, (2, "gone"): 2}
    assert set(s) == set(limits) and s[2, "gone"].tokens == 0 and s[2, "gone"].deficit > 0 and s[2, "third"].target_share == pytest.approx(0.2)
    largest = max(r.n_tokens for r in m)
    for (mix, source), r in s.items():
        own = [x for x in m if (x.mix_id, x.source) == (mix, source)]
        repeats = Counter(x.doc_id for x in own)
        assert max(repeats.values(), default=0) <= limits[mix, source]
        assert max(repeats.values(), default=0) - min(repeats.values(), default=0) <= 1
        assert sum(x.n_tokens for x in own) == r.tokens and abs(r.tokens - r.budget_tokens) <= largest / 2 + 1
        at = 0
        for x in sorted(own, key=lambda x: x.start):  # the copies follow each other without a gap, pass by pass
            assert x.start == at and x["pass"] == at // max(r.available_tokens, 1)
            at += x.n_tokens
    for mix in (1, 2):
        assert sum(r.share for (k, _), r in s.items() if k == mix) == pytest.approx(1)
    assert s[1, "small"].tokens == 2 * s[1, "small"].available_tokens and s[1, "small"].deficit > 0  # the limit binds
    assert s[1, "big"].share > 0.7 and s[1, "big"].deficit == 0
    order = [[x.doc_id for x in sorted(m, key=lambda x: x.start) if (x.mix_id, x.source, x["pass"]) == (2, "small", k)] for k in (0, 1)]
    assert sorted(order[0]) == sorted(order[1]) and order[0] != order[1]
    assert not {2000, 2001, 2002, 2003} & {x.doc_id for x in m}


def test_mixture_of_nothing(spark):
    targets = spark.createDataFrame([(1, "big", 0.7, 1, 50.0, "z")], MIX)
    m, s = mixing.mix_sources(spark.createDataFrame([], DOCS), targets)
    assert m.count() == 0 and s.first().tokens == 0
    m, s = mixing.mix_sources(spark.createDataFrame([(1, "a", "big", 1, "z", "z")], DOCS), targets.limit(0))
    assert m.count() == 0 and s.count() == 0


def test_weights_of_a_mixture():
    natural, target = np.array([0.6, 0.3, 0.1, 0.0]), np.array([0.3, 0.3, 0.3, 0.1])
    e, w = mixing.mixture_weights(natural, target, np.array([9.0, 9.0, 0.1, 0.0]))
    assert w.sum() == pytest.approx(1) and w[2] == pytest.approx(0.1) and w[3] == 0
    assert not np.allclose(w, np.minimum(target, [9.0, 9.0, 0.1, 0.0])) and w[0] / w[1] == pytest.approx((0.3 + 0.3 * 0.6**e / (0.6**e + 0.3**e)) / (0.3 + 0.3 * 0.3**e / (0.6**e + 0.3**e)))
    # The exponent brings the entropy to that of the targets where it can.
    target = np.array([0.5, 0.2, 0.2, 0.1])
    e, w = mixing.mixture_weights(np.array([0.5, 0.3, 0.2, 0.0]), target, np.array([9.0, 9.0, 9.0, 0.0]))
    assert e == 0 or mixing.entropy(w) == pytest.approx(mixing.entropy(target), abs=1e-6)
    e, w = mixing.mixture_weights(np.array([0.5, 0.45, 0.05]), np.array([0.3, 0.3, 0.4]), np.array([0.4, 9.0, 0.1]))
    assert w == pytest.approx([0.4, 0.5, 0.1])  # no exponent will do: one stays at its limit, the other takes the rest
    e, w = mixing.mixture_weights(np.array([0.5, 0.5]), np.array([0.25, 0.75]), np.array([9.0, 9.0]))
    assert np.isnan(e) and w == pytest.approx([0.25, 0.75])
    e, w = mixing.mixture_weights(np.array([0.5, 0.5]), np.array([0.5, 0.5]), np.array([0.2, 0.3]))
    assert w == pytest.approx([0.2, 0.3])
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(1, 9))
        natural, target, most = rng.dirichlet(np.ones(n)), rng.dirichlet(np.ones(n)), rng.uniform(0, 1.5, n)
        natural[rng.random(n) < 0.2] = 0
        most[natural == 0] = 0
        _, w = mixing.mixture_weights(natural, target, most)
        assert (w <= most + 1e-9).all() and (w >= np.minimum(target, most) - 1e-9).all()
        assert w.sum() == pytest.approx(min(1, most.sum()), abs=1e-6)


def test_shares_follow_from_token_counts(spark, data):
    """The report of the whole tables, from the library's token counts and plain Python."""
    from public_tokenizers import path
    from tokenizers import Tokenizer

    docs, targets = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/mix_targets.parquet")
    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    tokens: Counter = Counter()
    for r in docs.where("source is not null").select("source", "text").collect():
        tokens[r.source] += len(t.encode(r.text or "", add_special_tokens=False).ids)
    total = sum(tokens.values())
    shares = {(r.mix_id, r.source): r for r in mixing.mix_sources(docs, targets)[1].collect()}
    for mix in {k for k, _ in shares}:
        own = [r for r in targets.collect() if r.mix_id == mix]
        size = own[0].size_percent / 100 * total
        e, w = mixing.mixture_weights(np.array([tokens[r.source] / total for r in own]), np.array([r.target_share for r in own]), np.array([r.max_repeats * tokens[r.source] / size for r in own]))
        for r, x in zip(own, w):
            got = shares[mix, r.source]
            assert got.available_tokens == tokens[r.source] and abs(got.budget_tokens - x * size) <= 1
            assert got.deficit == pytest.approx(max(0, r.target_share * size - got.tokens))
