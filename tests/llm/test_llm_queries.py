"""Every query of the subpackage runs on the smallest tables; some against SQL or brute force."""

import numpy as np
import pytest

from oracle import connect, same
from tidemark.llm import oracle, plans

QUERIES, SQL = plans.queries(), oracle.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, data, con, name):
    same(QUERIES[name](spark, data), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    rows = QUERIES[name](spark, data).collect()
    assert len(rows) == len({tuple(map(str, r)) for r in rows}) > 0


def usable(con):
    t = con.execute("SELECT datum_id, any_value(float_data) AS v FROM datum WHERE len(float_data) = 64 GROUP BY 1").fetchall()
    ids, x = np.array([r[0] for r in t]), np.array([r[1] for r in t], float)
    ok = np.isfinite(x).all(axis=1) & (np.abs(x).sum(axis=1) > 0)
    x = x[ok]
    return ids[ok], x / np.linalg.norm(x, axis=1, keepdims=True)


def test_groups_are_brute_force(spark, data, con):
    ids, x = usable(con)
    s = x @ x.T >= 0.78
    group = np.arange(len(ids))
    for _ in range(len(ids)):
        new = np.array([group[s[i]].min() for i in range(len(ids))])
        if (new == group).all():
            break
        group = new
    sizes = np.bincount(group, minlength=len(ids))
    want = {(int(ids[i]), int(min(ids[group == group[i]]))) for i in range(len(ids)) if sizes[group[i]] > 1}
    assert {tuple(r) for r in QUERIES["p6_found"](spark, data).collect()} == want


def test_neighbours_are_brute_force(spark, data, con):
    ids, x = usable(con)
    at = {int(i): n for n, i in enumerate(ids)}
    want = set()
    for d, k in con.execute("SELECT datum_id, max(k) FROM knn_probe GROUP BY 1").fetchall():
        if d in at:
            s = x @ x[at[d]]
            s[at[d]] = -9
            want |= {(min(d, int(ids[j])), max(d, int(ids[j]))) for j in np.argsort(-s)[:k]}
    got = {tuple(r) for r in QUERIES["p5_found"](spark, data).collect()}
    assert len(got & want) / len(want) >= 0.97


def test_ids_are_the_library_s(spark, data, con):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    want = {d: t.encode(x or "", add_special_tokens=False).ids for d, x in con.execute("SELECT doc_id, text FROM documents").fetchall()}
    assert {r.doc_id: r.ids for r in QUERIES["p7_ids"](spark, data).collect()} == want
