import random

import pytest

from memquarry.llm.splitting import BLANKS, cuts, pieces


def text_of(rng, n):
    parts = []
    while sum(map(len, parts)) < n:
        parts.append(rng.choice(["word ", "longer-word, ", "end. ", "line\n", "para.\n\n", "\r\n", "é" * 30, "🔒", "é", "\x0c", "x" * 200, ""]))
    return "".join(parts)[:n]


@pytest.mark.parametrize(("limit", "overlap"), [(100, 0), (100, 10), (100, 49), (900, 80), (7, 3)])
def test_round_trip_and_limits(limit, overlap):
    rng = random.Random(limit + overlap)
    for n in [1, limit - 1, limit, limit + 1, 2 * limit, 2 * limit - overlap, 5 * limit + 3, 40 * limit]:
        t = text_of(rng, n)
        spans = cuts(t, limit, overlap)
        assert spans[0][0] == 0 and spans[-1][1] == len(t)
        assert all(0 < b - a <= limit for a, b in spans)
        assert all(y[0] == x[1] - overlap and y[1] > x[1] for x, y in zip(spans, spans[1:]))
        assert len(spans) == 1 if n <= limit else len(spans) >= -(-(n - overlap) // (limit - overlap))


def test_cuts_at_the_strongest_boundary_near():
    t = "a" * 45 + ". " + "b" * 5 + "\n\n" + "c" * 10 + " " + "d" * 40
    assert cuts(t, 80, 0)[0] == (0, 54)
    assert cuts("a" * 50 + ". " + "b" * 4 + " " + "c" * 50, 80, 0)[0] == (0, 52)
    assert cuts("a" * 50 + " " + "c" * 50, 80, 0)[0] == (0, 51)
    assert cuts("é" * 50, 51, 0)[0][1] % 2 == 0  # no character loses its accent


def test_table(spark):
    long = "Sentence one is here. " * 60
    rows = [(1, long), (1, long), (2, " \t\r\n\f" + "x" * 900 + "\n"), (3, None), (4, ""), (5, " \n"), (6, "🔒" * 901), (None, "short")]
    df = spark.createDataFrame([(*r, "k", 3) for r in rows], "rec_id long, text string, rec_kind string, first int")
    got = pieces(df, "hits", "rec_id", "text", 900, 80).collect()
    by = {}
    for r in got:
        by.setdefault(r.rec_id, []).append(r)
    assert set(by) == {1, 2, 6, None}
    assert len(by[1]) == 4 and {r.n_pieces for r in by[1]} == {2}
    assert [(r.piece_no, len(r.text)) for r in by[2]] == [(0, 900)]
    one = sorted({(r.piece_no, r.first, r.text) for r in by[1]})
    assert one[0][2] + one[1][2][80:] == long.strip(BLANKS)
    assert all(len(r.text) <= 900 for r in got)
    assert pieces(df.limit(0), "hits", "rec_id", "text", 900, 80).count() == 0
    with pytest.raises(ValueError):
        pieces(df, "hits", "rec_id", "text", 80, 80)
