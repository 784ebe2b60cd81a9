"""Every core query beside its SQL on the smallest tables."""

import importlib

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

BASE = "/root/testdata/sf0.001"
REGISTRIES = [importlib.import_module(f"memquarry.queries.{m}").R for m in entry.CORE]
QUERIES = {k: f for r in REGISTRIES for k, f in r.queries.items()}
SQL = {k: s for r in REGISTRIES for k, s in r.sql.items()}


@pytest.fixture(scope="module")
def duck():
    return connect(BASE)


def _sample(rows, duck):
    members = {tuple(r) for r in duck.execute("SELECT DISTINCT o_orderstatus, o_custkey FROM orders").fetchall()}
    got = [(r.key, r.member) for r in rows]
    per = {k: sum(x == k for x, _ in members) for k, _ in members}
    assert set(got) <= members and len(set(got)) == len(got)
    assert all(sum(x == k for x, _ in got) == min(5, n) for k, n in per.items())


def _probed(rows, duck):
    exact = dict()
    for q in (0, 7, 11):
        exact[q] = dict(duck.execute(f"SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) FROM embeddings e, embeddings q WHERE q.vec_id = {q} AND e.vec_id <> q.vec_id").fetchall())
    assert all(r.score == pytest.approx(exact[r.query][r.id], abs=1e-6) for r in rows) and {r.query for r in rows} == {0, 7, 11}


def _recall(rows, duck):
    assert len(rows) == 1 and rows[0].n > 0 and 0.92 <= rows[0]["mean"] <= 1 and rows[0].p05 >= 0.8


def _diff(rows, duck):
    """The old text with the steps applied is the new one."""
    pairs = {d: (a, b) for d, a, b in duck.execute("SELECT n.doc_id, o.text, n.text FROM documents n JOIN documents o ON o.doc_id = n.supersedes").fetchall()}
    steps = {}
    for r in rows:
        steps.setdefault(r.doc_id, []).append(r)
    for d, (old, new) in pairs.items():
        a, b = (old or "").splitlines(), (new or "").splitlines()
        for r in sorted(steps.get(d, []), key=lambda r: -r.old_first):
            a[r.old_first : r.old_past] = b[r.new_first : r.new_past]
        assert a == b
    assert set(steps) <= set(pairs)


#: What is asked of the queries that SQL cannot express.
CHECKS = {"set_sample": _sample, "vsearch_ivf": _probed, "ivf_recall": _recall, "document_diff": _diff}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    if name in SQL:
        assert compare(spark, duck, QUERIES[name], SQL[name], BASE) == ""
    else:
        CHECKS[name](QUERIES[name](spark, BASE).collect(), duck)


def test_entry(spark):
    assert entry.entry(spark).count() == 10
