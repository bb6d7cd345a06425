"""Logs of increments, clocks, priorities, table groups."""

import os

import pytest
from oracle import rows
from pyspark.sql import functions as F

from tidemark.operators import clocks as C
from tidemark.operators import deltas as D
from tidemark.operators import priority as P
from tidemark.operators.tables import TableGroup
from tidemark.plans.common import EVENT_TYPES
from tidemark.plans.streams import stream_window_counts


def log(spark, cells):
    return spark.createDataFrame(cells, "row_id int, col_id int, delta double")


def test_dense_store(spark):
    v = D.merge(log(spark, [(0, 1, 5.0), (0, 2, 10.0), (0, 1, -2.0)]))
    assert rows(D.dense_rows(v, 4)) == [(0, [0.0, 3.0, 10.0, 0.0])]


def test_sparse_store(spark):
    v = D.merge(log(spark, [(0, 1, 2.0), (0, 2, 0.0), (0, 3, -9.0), (0, 15, 8.0), (0, 3, 12.0)]))
    assert rows(v.select("col_id", "value")) == [(1, 2.0), (15, 8.0), (3, 3.0)]


def test_zero_removal(spark):
    cells = [(0, i, float(i % 17)) for i in range(300)] + [(0, i, -float(i % 17)) for i in range(151)]
    v = {r.col_id: r.value for r in D.sparse_rows(D.merge(log(spark, cells))).collect()}
    assert v == {i: float(i % 17) for i in range(151, 300) if i % 17}


def test_batches_with_nulls_and_offset(spark):
    df = spark.createDataFrame([(1, [0, 2], [1.0, None]), (None, [0], [4.0]), (1, [2], [3.0])], "r int, c array<int>, d array<double>")
    assert rows(D.merge(D.batch_inc(df, "r", "c", "d"))) == [(1, 0, 1.0), (1, 2, 3.0)]
    dense = spark.createDataFrame([(1, [1.0, 2.0])], "r int, v array<double>")
    assert rows(D.merge(D.dense_batch_inc(dense, "r", "v", 5))) == [(1, 5, 1.0), (1, 6, 2.0)]
    assert D.merge(log(spark, [])).count() == 0


def test_vector_clock(spark):
    c = spark.createDataFrame([(i, 0) for i in range(3)], "worker int, clock int")
    for w, want in ((0, 0), (0, 0), (1, 0), (2, 1)):
        c = C.tick(c, w)
        assert C.min_clock(c).first().min_clock == want
    assert C.unique_min(c).first().n_slowest == 2
    assert C.min_clock(c.limit(0)).count() == 0


def test_staleness(spark):
    cells = [(0, 0, 1.0, w, c) for w in range(2) for c in range(6)]
    df = spark.createDataFrame(cells, "row_id int, col_id int, delta double, worker int, clock int")
    assert C.stale_read(df, 5, 2).first().value == 6.0
    assert C.stale_read(df, 5, 2, 0).first().value == 9.0
    assert C.stale_read(df, 1, 2).count() == 0


def test_priority_ties_and_policies(spark):
    df = spark.createDataFrame([(3, 2.0, 1, 1), (1, 2.0, 4, 1), (2, 5.0, 2, 1)], "row_id int, importance double, min_clock int, n bigint")
    first = lambda *a, **k: [r.row_id for r in P.top_rows(df, *a, **k).collect()]
    assert first(3) == [2, 1, 3]
    assert first(3, "fifo") == [3, 2, 1]
    assert first(3, "fixed_order", cursor=2, n_rows=4) == [2, 3, 1]
    assert sorted(first(3, "random", seed=3)) == [1, 2, 3]
    with pytest.raises(ValueError):
        P.order_of("newest")
    got = P.up_to_clock_then_top(df, 1, 2).collect()
    assert {(r.row_id, r.due) for r in got} == {(3, True), (2, False)}
    assert P.candidate_top(df, 2, 10.0, 3).count() == 2


def test_table_group(spark, tmp_path):
    g = TableGroup(spark, 2)
    g.register_row(0, "sparse")
    assert g.create_table(7, 0, staleness=1) and not g.create_table(7, 0)
    with pytest.raises(KeyError):
        g.table(8)
    one = spark.createDataFrame([(0, 1, 5.0)], "r int, c int, d double")
    t = g.table(7)
    t.inc(0, one, "r", "c", "d")
    assert t.get(0, 0).first().value == 5.0  # reads its own write
    assert t.read(1).count() == 0
    assert g.clock(0) == 0
    assert t.read(1).count() == 0
    g.global_barrier()
    assert t.read(1).first().value == 5.0
    clock = t.snapshot(str(tmp_path / "snap"))
    from tidemark.sources import snapshots

    assert snapshots.clocks(spark, str(tmp_path / "snap"), 7) == [clock]
    assert snapshots.load(spark, str(tmp_path / "snap"), 7).first().value == 5.0
    with pytest.raises(KeyError):
        snapshots.load(spark, str(tmp_path / "snap"), 9)
    more = spark.createDataFrame([(0, 1, 2.0, 0, clock)], "row_id int, col_id int, delta double, worker int, clock int")
    assert snapshots.resume(snapshots.load(spark, str(tmp_path / "snap"), 7), more, clock).first().value == 7.0
    snapshots.to_text(snapshots.load(spark, str(tmp_path / "snap"), 7), str(tmp_path / "text"), 3)
    assert [r.value for r in spark.read.text(str(tmp_path / "text")).collect()] == ["0 0.0 5.0 0.0"]


def test_windows_of_files_out_of_order(spark, tmp_path):
    for k in range(20):  # the newest day comes first, two triggers of files before the oldest
        day = f"2024-03-{28 - k:02d} 12:00:00"
        one = spark.createDataFrame([(k, EVENT_TYPES[0], 1.0, day)], "user_id bigint, event_type string, value double, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
        one.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
        for f in (tmp_path / "events.parquet").glob("part-*.parquet"):
            if f.stat().st_mtime > 1_600_000_000:
                os.utime(f, (1_500_000_000 + k, 1_500_000_000 + k))
    got = {r.day: r.n for r in stream_window_counts(spark, str(tmp_path)).collect()}
    assert got == {f"2024-03-{28 - k:02d}": 1 for k in range(20)}


def test_components(spark):
    from tidemark.operators.components import connected_components

    links = [(1, 2), (2, 3), (10, 11), (5, 5), (None, 4)] + [(100 + i, 101 + i) for i in range(40)]
    got = dict(connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect())
    assert got[3] == 1 and got[11] == 10 and got[140] == 100 and 5 not in got and 4 not in got
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_ranks_of_one_group(spark):
    from tidemark.operators.ranking import prefix_sum_by_unit, rank_by_unit
    from tidemark.runtime import hash_unit

    df = spark.range(1000).withColumn("k", F.lit(None).cast("int")).withColumn("u", hash_unit("id")).withColumn("n", F.lit(2))
    r = rank_by_unit(df, ["k"], "u", "id").orderBy("rank").collect()
    assert [x["rank"] for x in r] == list(range(1, 1001)) and [x.u for x in r] == sorted(x.u for x in r)
    p = prefix_sum_by_unit(df.withColumn("k", F.lit(1)), ["k"], "u", "id", "n").orderBy("before").collect()
    assert [x.before for x in p] == list(range(0, 2000, 2))
