"""Shared spans against all windows in plain Python."""

import random

import pytest

from memquarry.llm.shared_spans import SharedSpans, difference_set, plan, spans


def windows(t, n):
    return {t[i : i + n] for i in range(len(t or "") - n + 1)} if t else set()


def truth(rows, n):
    rows = list({(i, g, t) for i, g, t in rows if t and i is not None})
    w = {(i, g, t): windows(t, n) for i, g, t in rows}
    return {(min(a[0], b[0]), max(a[0], b[0])) for k, a in enumerate(rows) for b in rows[:k] if a[1] != b[1] and a[0] != b[0] and w[a] & w[b]}


def shared_chars(rows, n):
    """Characters of each record in windows that a text of another group has too; all of
    a record with a copy in another group."""
    rows = [r for r in {(i, g, t) for i, g, t in rows if t and i is not None} if len(r[2]) >= n]
    at = {}
    for _, g, t in rows:
        for w in windows(t, n):
            at.setdefault(w, (set(), set()))
            at[w][0].add(t)
            at[w][1].add(g)
    out = set()
    for i, g, t in rows:
        marked = set()
        for k in range(len(t) - n + 1):
            texts, groups = at[t[k : k + n]]
            if len(texts) > 1 and len(groups) > 1:
                marked.update(range(k, k + n))
        copied = any(u == t and h != g for _, h, u in rows)
        out.add((i, len(t) if copied else len(marked)))
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    letters = "abcde é🔒\n"
    text = lambda k: "".join(rng.choice(letters) for _ in range(k))
    passages = [text(k) for k in (n - 1, n, n, n + 1, 2 * n, 3 * n)]
    rows = []
    for i in range(60):
        parts = [text(rng.randrange(n))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(passages), text(rng.randrange(n))]
        rows.append((i, i, "".join(parts)))
    return rows


def test_difference_sets_are_perfect():
    for q in (2, 3, 5, 7, 11, 13):
        d, v = difference_set(q), q * q + q + 1
        assert len(d) == q + 1 and {(a - b) % v for a in d for b in d} == set(range(v))
    with pytest.raises(ValueError):
        difference_set(6)
    q, window = plan(300)
    assert q * q + q + window == 300


@pytest.mark.parametrize("n", [40, 300])
def test_pairs_equal_all_windows(spark, n):
    rows = corpus(n, n)
    rows += [(100, 100, None), (101, 101, ""), (102, 102, "ab" * 3000), (103, 103, "ba" * 2000), (104, 104, "x" * n), (105, 105, "x" * n), rows[3], (106, 3, rows[3][2]), (None, 9, "x" * n)]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "id long, grp long, text string, kind int, anchor string").repartition(3)
    found = SharedSpans({"r": (df, "id", "text", "grp")}, n)
    assert {(r.id_a, r.id_b) for r in found.pairs().collect()} == truth(rows, n)


@pytest.mark.parametrize("hot", [3, 15])
def test_a_passage_in_most_texts(spark, monkeypatch, hot):
    """A passage shorter than a span in most texts makes no pairs; longer ones still do."""
    from memquarry.llm import shared_spans as m

    monkeypatch.setattr(m, "HOT", hot)
    rows = corpus(300, 300)
    common = "".join(chr(400 + i) for i in range(260))
    rng = random.Random(6)
    rows = [(i, g, t[:200] + common + t[200:] if i % 3 else t + t[:1] + common + str(i % 7) * (60 if i % 2 else 20)) for i, g, t in rows]
    rng.shuffle(rows)
    found = SharedSpans({"r": (spark.createDataFrame(rows, "id long, grp long, text string").repartition(3), "id", "text", "grp")}, 300)
    want = truth(rows, 300)
    assert len(want) > 20 and {(r.id_a, r.id_b) for r in found.pairs().collect()} == want
    assert {(r.id, r.shared_chars) for r in found.shared_by_record().collect()} == shared_chars(rows, 300)


def test_a_passage_in_all_texts_makes_few_pairs(spark):
    from pyspark.sql import functions as F

    passage = "".join(chr(300 + i) for i in range(450))
    df = spark.range(0, 3000, 1, 4).select("id", F.concat(F.repeat(F.concat(F.col("id").cast("string"), F.lit(" ")), 8), F.lit(passage), F.repeat(F.concat(F.lit("."), F.col("id").cast("string")), 8)).alias("text"))
    found = SharedSpans({"r": (df, "id", "text", None)}, 300)
    got = found.shared_by_record().groupBy("shared_chars", "n_spans").count().collect()
    # Of 4,498,500 pairs only those that share more around the passage, at most HOT for an anchor.
    assert found.close.count() < 100_000 and sum(r["count"] for r in got) == 3000 and all(r.shared_chars >= 450 and r.n_spans == 1 for r in got)


def test_spans_are_whole(spark):
    a, b, c = "A" + "xyz" * 5, "".join(chr(300 + i) for i in range(500)), "tail"
    rows = [(1, a + b + c), (2, "other" + b), (3, b[:250] + "?" + b[250:])]
    found = SharedSpans({"r": (spark.createDataFrame(rows, "id long, text string"), "id", "text", None)}, 200)
    got = {r.id: (r.shared_chars, r.n_spans) for r in found.shared_by_record().collect()}
    assert got == {1: (500, 1), 2: (500, 1), 3: (500, 2)}
    assert {(r.id, r.first, r.past) for r in found.spans_by_record().collect()} == {(1, 16, 516), (2, 5, 505), (3, 0, 250), (3, 251, 501)}


def test_kinds_stay_apart_and_copies(spark):
    t = "".join(chr(200 + i % 300) for i in range(400))
    a = spark.createDataFrame([(1, t), (2, t)], "id long, text string")
    b = spark.createDataFrame([(1, 7, t), (2, 7, t), (3, 8, t), (3, 8, t)], "id long, g long, text string")
    found = SharedSpans({"a": (a, "id", "text", None), "b": (b, "id", "text", "g")}, 300)
    assert {tuple(r) for r in found.pairs().collect()} == {("a", 1, 2), ("b", 1, 3), ("b", 2, 3)}
    assert {(r.kind, r.id, r.n_copies) for r in found.shared_by_record().collect()} == {("a", 1, 1), ("a", 2, 1), ("b", 1, 1), ("b", 2, 1), ("b", 3, 2)}


def test_empty_table(spark):
    found = SharedSpans({"r": (spark.createDataFrame([], "id long, text string"), "id", "text", None)}, 300)
    assert found.pairs().count() == found.shared_by_record().count() == 0


def test_joining_windows():
    import numpy as np

    assert spans(np.array([0, 1, 5, 30]), 10) == [(0, 15), (30, 40)]
