"""Links against all pairs in plain Python."""

import random
import re

import pytest

from memquarry.llm.near_duplicates import NearDuplicates

WORD = re.compile(r"[^\W_]+")


def shingles(text, n):
    w = WORD.findall((text or "").lower())
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def truth(rows, n, t):
    sets = [(i, s) for i, x in rows if (s := shingles(x, n))]
    return {(min(a, b), max(a, b)) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if len(x & y) >= t * len(x | y)}


def corpus(seed, count, lengths):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(2000)] + ["Straße", "l'été", "ÅB_c"]
    texts = []
    for _ in range(count):
        base = [rng.choice(vocabulary) for _ in range(rng.choice(lengths))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(3)):
            w = list(base)
            for _ in range(rng.randrange(4)):
                op = rng.randrange(4)
                at = rng.randrange(len(w) + 1)
                if op == 0:
                    w.insert(at, rng.choice(vocabulary))
                elif op == 1 and w:
                    w.pop(at % len(w))
                elif op == 2 and w:
                    w[at % len(w)] = rng.choice(vocabulary)
                else:
                    w = w[at:] + w[:at]
            texts.append(" ".join(w))
    return list(enumerate(texts))


@pytest.mark.parametrize(("n", "t", "exact"), [(3, 0.6, False), (5, 0.8, False), (3, 0.6, True), (2, 0.3, True)])
def test_pairs_equal_all_pairs(spark, n, t, exact):
    rows = corpus(n, 120, [1, 2, 3, 4, 5, 6, 8, 12, 30, 90, 300])
    rows += [(len(rows) + i, x) for i, x in enumerate([None, "", " \n", "one two", "x y z", "X, y; z!", "x y z", "a " * 20_000])]
    df = spark.createDataFrame([(i, x, "c", 1) for i, x in rows], "doc_id long, text string, set_id string, n int").repartition(3)
    found = NearDuplicates(df, n_words=n, threshold=t, exact=exact)
    assert {(r.id_a, r.id_b) for r in found.pairs().collect()} == truth(rows, n, t)


def test_copies_are_one_class(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(i, text if i < 300 else text + " more words here") for i in range(303)] + [(None, text)]
    found = NearDuplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    docs = found.documents().collect()
    assert len(docs) == 303
    assert {(r.id < 300, r.class_id, r.n_links) for r in docs} == {(True, 0, 1), (False, 300, 1)}
    assert found.links.count() == 1


def test_empty_table(spark):
    found = NearDuplicates(spark.createDataFrame([], "doc_id long, text string"))
    assert found.pairs().count() == found.documents().count() == 0


def test_low_threshold_is_refused(spark):
    with pytest.raises(ValueError):
        NearDuplicates(spark.createDataFrame([], "doc_id long, text string"), threshold=0.3)
