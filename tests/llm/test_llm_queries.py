"""The queries of this subpackage on the smallest tables, beside their SQL where there is one."""

import pytest

from memquarry.llm.queries import R
from tests.oracle import compare, connect

BASE = "/root/testdata/sf0.001"
#: The classifier needs labels.
LABELLED = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def duck():
    return connect(BASE)


def _pieces(rows, duck):
    ids = {tuple(r) for r in duck.execute("SELECT 'documents', doc_id FROM documents WHERE trim(text) <> '' UNION SELECT 'hits', hit_id FROM hits WHERE trim(text) <> ''").fetchall()}
    assert {(r.rec_kind, r.rec_id) for r in rows} >= ids
    assert all(len(r.text) <= (4000 if r.rec_kind == "documents" else 900) and 0 <= r.piece_no < r.n_pieces for r in rows)


def _packed(rows, duck):
    used = {}
    for r in rows:
        used[r.container] = used.get(r.container, 0) + r.n_tokens
    assert max(used.values()) <= 2048 and sum(used.values()) / (2048 * len(used)) > 0.9


def _containers(rows, duck):
    assert all(r.used + r.unused == 2048 and r.unused >= 0 and r.n_items > 0 for r in rows)


def _mixed(rows, duck):
    most = dict(duck.execute("SELECT source, max(max_repeats) FROM mix_targets GROUP BY source").fetchall())
    assert all(0 <= r.copy_no < most[r.source] for r in rows) and [r.place for r in rows] == sorted(r.place for r in rows)


def _shares(rows, duck):
    assert sum(r.actual_share for r in rows) == pytest.approx(1) and all(r.most_uses <= r.max_repeats for r in rows)


def _kinds(rows, duck):
    assert {r.pii_kind for r in rows} == {"email", "phone", "id_number", "address", "person"} and len(set(rows)) == len(rows)


def _redacted(rows, duck):
    n = duck.execute("SELECT (SELECT count(*) FROM documents) + (SELECT count(DISTINCT note_id) FROM notes)").fetchone()[0]
    assert len(rows) == n and all(r.n_spans <= (r.text or "").count("[") for r in rows)


def _neighbours(rows, duck):
    per = {}
    for r in rows:
        per.setdefault(r.id, []).append((r.place, -r.cosine, r.other))
    assert all([p for p, *_ in sorted(x)] == list(range(1, len(x) + 1)) and len(x) <= 10 and i % 20 == 0 for i, x in per.items())


def _harmful(rows, duck):
    labels = dict(connect(LABELLED).execute("SELECT doc_id, avg(toxic) FROM doc_labels WHERE toxic IN (0, 1) GROUP BY doc_id HAVING avg(toxic) <> 0.5").fetchall())
    found = {r.doc_id for r in rows}
    known = found & labels.keys()
    good = sum(labels[i] > 0.5 for i in known)
    assert good / len(known) > 0.93 and good / sum(x > 0.5 for x in labels.values()) > 0.75
    assert len(found) < 600


def _rates(rows, duck):
    assert sum(r.n_docs for r in rows) == connect(LABELLED).execute("SELECT count(*) FROM documents").fetchone()[0] and all(0 <= r.rate < 0.5 and 0 <= r.mean_score <= 1 for r in rows)


#: What is asked of the queries that SQL cannot express.
CHECKS = {
    "p2_pieces": _pieces, "p8_packed": _packed, "p8_containers": _containers, "p9_mixed": _mixed, "p9_shares": _shares, "p6_found": _kinds,
    "p6_redacted": _redacted, "p5_neighbours": _neighbours, "p10_found": _harmful, "p10_rates": _rates,
}


@pytest.mark.parametrize("name", sorted(R.queries))
def test_query(spark, duck, name):
    if name in R.sql:
        assert compare(spark, duck, R.queries[name], R.sql[name], BASE) == ""
    else:
        CHECKS[name](R.queries[name](spark, LABELLED if name.startswith("p10_") else BASE).collect(), duck)
