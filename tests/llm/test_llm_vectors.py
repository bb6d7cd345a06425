"""Nearest vectors, clusters, subsets, on small tables and against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import runtime
from tidemark.llm import clusters, graph, neighbours, subset, vectors
from tidemark.llm.vectors import unit_vectors

DATUM = "datum_id bigint, split string, label int, float_data array<float>, ingested_at timestamp, id int, vec string, r string, k int, code string, h string"


def datum(spark, rows):
    return spark.createDataFrame([(i, s, l, None if v is None else [float(x) for x in v], None, 0, "a", "b", 1, "c", "d") for i, s, l, v in rows], DATUM)


def grouped(seed=0, sizes=(400, 150, 40, 9, 3, 2, 1, 1, 1), spread=0.045):
    """Tight groups in random directions; ids in random order, vectors of varied length."""
    rng = np.random.default_rng(seed)
    x, g = [], []
    for k, n in enumerate(sizes):
        c = rng.normal(size=64)
        c /= np.linalg.norm(c)
        x.append((c + rng.normal(0, spread, (n, 64))) * rng.uniform(0.1, 30, (n, 1)))
        g += [k] * n
    order = rng.permutation(len(g))
    return np.concatenate(x)[order].astype(np.float32), np.array(g)[order]


def unit(x):
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


BAD = [(9001, "train", 1, None), (9002, "train", 1, []), (9003, "train", 1, [0.0] * 64), (9004, "train", 1, [1.0] * 63), (9005, "train", 1, [float("nan")] + [1.0] * 63), (9006, "train", 1, [float("inf")] + [1.0] * 63), (None, "train", 1, [1.0] * 64)]


def test_usable_vectors_only(spark):
    ok = [(1, "train", None, [1e-30] * 64), (2, None, 3, [3e38] * 64), (2, None, 3, [3e38] * 64)]
    got = unit_vectors(datum(spark, BAD + ok)).collect()
    assert sorted(r.id for r in got) == [1, 2, 2]
    for r in got:
        assert np.frombuffer(r.vec, np.float32) == pytest.approx(np.full(64, 0.125))
    assert unit_vectors(datum(spark, [])).count() == 0
    by_expression = datum(spark, BAD + ok).where(F.expr(subset.usable("float_data")) & F.col("datum_id").isNotNull()).select("datum_id")
    assert sorted(r.datum_id for r in by_expression.collect()) == [1, 2, 2]


def pairs_by_brute_force(x, ids, k, asked):
    s = x @ x.T
    np.fill_diagonal(s, -9)
    return {(i, ids[j]) for i in asked for j in np.argsort(-s[list(ids).index(i)], kind="stable")[:k]}


def test_recall_of_the_graph():
    x = unit(grouped(1, (900, 700, 200, 60, 30) + (5,) * 80 + (1,) * 200)[0])
    ids = np.arange(len(x))
    q = np.arange(0, len(x), 7)
    row, got, sim = graph.nearest_in_shard(x, ids, x[q], q, np.full(len(q), 8))
    exact = np.sort(np.where(q[:, None] == ids[None], -9, x[q] @ x.T), axis=1)[:, -8]
    hit = np.bincount(row[sim >= exact[row] - 1e-6], minlength=len(q)).clip(max=8)
    assert hit.mean() / 8 > 0.95
    assert (got != q[row]).all()
    assert np.bincount(row, minlength=len(q)).max() <= 8


def test_nearest_over_shards(spark):
    x, _ = grouped(2)
    df = datum(spark, BAD + [(i, "train", 0, v) for i, v in enumerate(x)] + [(5, "train", 0, x[5])])
    v = unit_vectors(df)
    asked = list(range(0, len(x), 10))
    q = v.where(F.col("id").isin(asked)).dropDuplicates(["id"]).select(F.col("id").alias("query_id"), "vec", F.lit(5).alias("k"))
    want = pairs_by_brute_force(unit(x), np.arange(len(x)), 5, asked)
    for options in ({"shard_rows": 60, "probed": 12}, {"shard_rows": 20, "sample_rows": 60, "probed": 64, "query_rows": 7}):
        got = neighbours.nearest(v, q, **options).collect()
        found = {(r.query_id, r.id) for r in got}
        assert len(found & want) / len(want) > 0.95 and len(found) == len(got) == 5 * len(asked)


def test_nearest_with_copies_and_few_rows(spark):
    one = [1.0] + [0.0] * 63
    two = [0.0, 1.0] + [0.0] * 62
    df = datum(spark, [(i, "train", 0, one) for i in range(500)] + [(1000, "train", 0, two)])
    v = unit_vectors(df)
    q = spark.createDataFrame([(7, 3), (1000, 2), (8, 0), (9, None)], "query_id bigint, k int").join(v.select(F.col("id").alias("query_id"), "vec"), "query_id")
    got = [(r.query_id, r.id, round(r.similarity, 3)) for r in neighbours.nearest(v, q, shard_rows=100_000).orderBy("query_id", "place").collect()]
    assert got == [(7, 0, 1.0), (7, 1, 1.0), (7, 2, 1.0), (1000, 0, 0.0), (1000, 1, 0.0)]
    alone = unit_vectors(datum(spark, [(1, "train", 0, one)]))
    assert neighbours.nearest(alone, alone.select(F.col("id").alias("query_id"), "vec", F.lit(4).alias("k"))).count() == 0
    none = unit_vectors(datum(spark, []))
    assert neighbours.nearest(none, none.select(F.col("id").alias("query_id"), "vec", F.lit(4).alias("k"))).count() == 0


@pytest.mark.parametrize("node_rows", [100_000, 120])
def test_groups_are_found(spark, node_rows):
    x, g = grouped(3, (700, 300, 60, 30) + (4,) * 30 + (1,) * 40)
    df = datum(spark, BAD + [(i, "train", 0, v) for i, v in enumerate(x)] + [(5, "train", 0, x[5])])
    got = {r.id: r.group for r in clusters.similarity_groups(unit_vectors(df), node_rows=node_rows, sample_rows=400).collect()}
    assert set(got) == set(range(len(x)))
    mine: dict = {}
    for i, k in enumerate(g):
        mine.setdefault(k, set()).add(got[i])
    assert all(len(v) == 1 for v in mine.values())
    assert len({next(iter(v)) for v in mine.values()}) == len(mine)


@pytest.mark.parametrize("node_rows", [100_000, 50])
def test_equal_vectors_are_one_group(spark, node_rows):
    one, two = [1.0] + [0.0] * 63, [0.0, -2.0] + [0.0] * 62
    df = datum(spark, [(i, "train", 0, one) for i in range(200)] + [(500, "train", 0, two)])
    got = {r.id: r.group for r in clusters.similarity_groups(unit_vectors(df), node_rows=node_rows).collect()}
    assert len({got[i] for i in range(200)}) == 1 and got[500] != got[0] and len(got) == 201


def test_pairs_meet_at_every_size(spark):
    rng = np.random.default_rng(9)
    one = unit(rng.normal(size=(1200, 64)))
    off = rng.normal(size=(1200, 64))
    off = unit(off - (off * one).sum(axis=1, keepdims=True) * one)
    x = np.concatenate([one, 0.8 * one + 0.6 * off])
    df = datum(spark, [(i, "train", 0, v) for i, v in enumerate(x)])
    got = {r.id: r.group for r in clusters.similarity_groups(unit_vectors(df), node_rows=60, sample_rows=600).collect()}
    assert all(got[i] == got[1200 + i] for i in range(1200)) and len(set(got.values())) == 1200


def chains(rng, n, steps, similarity):
    """Rows of vectors, each so similar to the one before and going its own way."""
    out = []
    for _ in range(n):
        v = unit(rng.normal(size=(1, 64)))[0]
        out.append(v)
        for _ in range(steps - 1):
            off = rng.normal(size=64)
            off -= (off @ v) * v
            v = similarity * v + np.sqrt(1 - similarity**2) * off / np.linalg.norm(off)
            out.append(v)
    return np.array(out, np.float32)


@pytest.mark.parametrize("node_rows,block_leaves", [(100_000, 100_000), (40, 64)])
def test_links_of_any_form_are_kept(spark, node_rows, block_leaves):
    rng = np.random.default_rng(12)
    wide = unit(rng.normal(size=(1, 64)) + rng.normal(0, 0.6, (60, 64)))  # a loose group whose members only touch
    x = np.concatenate([chains(rng, 20, 6, 0.955), chains(rng, 10, 12, 0.85), chains(rng, 15, 4, 0.79), wide, unit(grouped(3, (60, 20, 5))[0])])
    link = x @ x.T >= 0.78
    group = np.arange(len(x))
    while True:
        new = np.array([group[link[i]].min() for i in range(len(x))])
        if (new == group).all():
            break
        group = new
    df = datum(spark, [(i, "train", 0, v) for i, v in enumerate(x)])
    got = {r.id: r.group for r in clusters.similarity_groups(unit_vectors(df), node_rows=node_rows, sample_rows=100, block_leaves=block_leaves).collect()}
    assert len({(got[i], group[i]) for i in range(len(x))}) == len(set(group.tolist())) == len(set(got.values()))


def test_members_of_large_leaves_meet_in_chunks(spark):
    rng = np.random.default_rng(13)
    a = unit(rng.normal(size=64) + rng.normal(0, 0.3, (30, 64)))
    b = unit(rng.normal(size=64) + rng.normal(0, 0.3, (25, 64)))
    rows = [(1, 2, False, i, v.tobytes()) for i, v in enumerate(a)] + [(2, 1, False, 100 + i, v.tobytes()) for i, v in enumerate(b)]
    df = spark.createDataFrame(rows, "a bigint, b bigint, sure boolean, id bigint, vec binary")
    top = float((a @ b.T).max())
    assert [tuple(r) for r in clusters._member_links(df, top - 1e-5, 8).collect()] == [(1, 2)]
    assert clusters._member_links(df, top + 1e-3, 8).count() == 0


def test_only_links_are_written_for_pairs_of_leaves(spark, monkeypatch):
    """Many leaves near each other but not linked: what is written grows with the rows, not with the pairs, and the vectors are kept once."""
    rng = np.random.default_rng(14)
    hub = unit(rng.normal(size=(60, 64)))
    x = np.concatenate([unit(h + rng.normal(0, 0.045, (4, 64))) for h in unit(hub + unit(hub.sum(axis=0, keepdims=True)) * 0.8)])
    written: dict = {}

    def staged(df, name, *args):
        out = runtime.staged(df, name, *args)
        written[name] = out
        return out

    monkeypatch.setattr(clusters, "staged", staged)
    df = datum(spark, [(i, "train", 0, v) for i, v in enumerate(x)])
    got = clusters.similarity_groups(unit_vectors(df)).collect()
    link = x @ x.T >= 0.78
    group = np.arange(len(x))
    while not ((new := np.array([group[r].min() for r in link])) == group).all():
        group = new
    assert len({(r.group, group[r.id]) for r in got}) == len(set(group.tolist())) == len({r.group for r in got})
    assert sum(t.count() for n, t in written.items() if n in ("p6-links", "p6-pairs", "p6-unsure", "p6-reaching")) <= len(x)
    at = {n: spark._jvm.org.apache.hadoop.fs.Path(t.staged_path) for n, t in written.items() if n in ("p6-vectors", "p6-members")}
    assert [n for n, p in at.items() if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)] == ["p6-members"]


def test_parts_of_large_leaves_are_decided_by_their_own_members():
    rng = np.random.default_rng(15)
    a, b = (unit(rng.normal(size=(1, 64)) + rng.normal(0, 0.3, (30, 64))) for _ in range(2))
    far = unit(-(a.sum(axis=0, keepdims=True) + b.sum(axis=0, keepdims=True)))
    block = object.__new__(clusters._Block)
    block.x, block.ids = np.concatenate([a, b, far]), np.arange(61)
    block.starts, block.keys = np.array([0, 12, 30, 60]), np.array([1, 1, 2, 3])
    block.counts = np.array([12, 18, 30, 1])
    block.centres = clusters._unit(np.add.reduceat(block.x, block.starts, axis=0))
    dots = np.einsum("ij,ij->i", block.x, np.repeat(block.centres, block.counts, axis=0))
    block.angle = np.arccos(np.minimum.reduceat(dots, block.starts).clip(-1, 1).astype(np.float64))
    block.pivots = block.x[[s + int(dots[s : s + n].argmax()) for s, n in zip(block.starts, block.counts)]]
    top = float((a @ b.T).max())
    for chunk in (4, 1000):
        rows = clusters._links_of_blocks(block, block, top - 1e-5, chunk).to_pylist()
        assert {(r["a"], r["b"]) for r in rows} - {(1, 2), (2, 1)} == set() and rows
    assert clusters._links_of_blocks(block, block, top + 1e-3, 1000).num_rows == 0


def test_no_vectors(spark):
    assert clusters.similarity_groups(unit_vectors(datum(spark, []))).count() == 0


def test_groups_described(spark):
    x, g = grouped(4, (50, 5, 1))
    df = datum(spark, [(i, "train", int(k) if i % 2 else None, v) for i, (v, k) in enumerate(zip(x, g))])
    v = unit_vectors(df)
    d = clusters.describe_groups(clusters.similarity_groups(v), df.select(F.col("datum_id").alias("id"), "label")).collect()
    assert sorted(r.size for r in d) == [1, 5, 50]
    big = next(r for r in d if r.size == 50)
    mid = unit(x[g == 0].mean(axis=0)[None])[0]
    close = np.flatnonzero(g == 0)[np.argsort(-(unit(x[g == 0]) @ mid))[:8]]
    assert len(big.typical) == 3 and set(big.typical) <= set(close.tolist())
    assert big.labels == {0: int(((g == 0) & (np.arange(len(g)) % 2 == 1)).sum())}
    assert big.first_id == int(np.flatnonzero(g == 0).min())


JOBS = "job_id bigint, split string, n_records bigint, datum_id string"


def test_varied_subset(spark):
    x, g = grouped(5, (600, 100) + (3,) * 60)
    rows = [(i, " Train" if i % 2 else "test", int(i % 5) if i % 7 else None, v) for i, v in enumerate(x)]
    df = datum(spark, BAD + rows + rows[:3])
    jobs = spark.createDataFrame([(1, "train", 40, "x"), (2, None, 30, "x"), (3, "val", 5, "x"), (4, None, 0, "x"), (5, "test", 10_000, "x")], JOBS)
    got = subset.varied_subset(df, jobs).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r.job_id, []).append(r)
    assert sorted(by) == [1, 2, 5]
    assert [len(by[j]) for j in (1, 2)] == [40, 30] and len(by[5]) == len([i for i in range(len(x)) if i % 2 == 0])
    for rs in by.values():
        assert sorted(r.place for r in rs) == list(range(1, len(rs) + 1)) and len({r.datum_id for r in rs}) == len(rs)
    assert all(r.datum_id % 2 == 1 for r in by[1])
    assert len({r.label for r in by[2]}) == 6
    assert sum(g[r.datum_id] == 0 for r in by[2]) / 30 < 0.5 < (g == 0).mean() + 0.2
    again = subset.varied_subset(df, jobs).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, got), key=repr)


def test_subset_of_nothing(spark):
    jobs = spark.createDataFrame([(1, "train", 40, "x")], JOBS)
    assert subset.varied_subset(datum(spark, BAD), jobs).count() == 0
    assert subset.varied_subset(datum(spark, [(1, "train", 1, [1.0] * 64)]), jobs.limit(0)).count() == 0


def test_pack_keeps_directions():
    import pyarrow as pa

    x = np.random.default_rng(0).normal(size=(10, 64)).astype(np.float32)
    at, u = vectors.pack(pa.array(range(10)), pa.array(list(x), pa.list_(pa.float32())))
    assert at.tolist() == list(range(10)) and np.allclose(u, unit(x), atol=1e-6)
    assert np.array_equal(vectors.from_binary(vectors.to_binary(u)), u)
