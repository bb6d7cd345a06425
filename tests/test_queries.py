"""Every core query runs on the smallest tables; those with SQL agree with it."""

import pytest

from oracle import connect, same
from tidemark.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, data, con, name):
    same(QUERIES[name](spark, data), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark, data):
    assert catalog.entry(spark).count() == 5


def test_permutations_are_whole(spark, data):
    rows = QUERIES["permute_hash"](spark, data).collect()
    assert sorted(r.new for r in rows) == list(range(len(rows)))


@pytest.mark.parametrize("name", ["train_logreg", "train_mf", "train_sparse_coding"])
def test_training_lowers_the_loss(spark, data, name):
    rows = sorted(QUERIES[name](spark, data).collect(), key=lambda r: r[0])
    column = {"train_logreg": "log_loss", "train_mf": "objective", "train_sparse_coding": "objective"}[name]
    assert rows[-1][column] < rows[0][column]
