"""Heads of texts found anywhere in texts of other tenants."""

import random

from memquarry.operators.leaks import leaked_heads


def test_shifted_short_and_own(spark):
    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choice("abcdefgäß") for _ in range(6)) for _ in range(n))
    a, b, c = words(60), words(60), words(60)
    rows = [("t", a), ("u", "Before it. " + a[:90].upper().replace("SS", "ß") + b), ("t", c), ("t", "x" + c), ("u", "  Short one "), ("t", "no SHORT ONE here"), (None, b), ("v", None), ("v", " "), ("u", "xyz")]
    got = {(r.tenant, r.head): r.leaked for r in leaked_heads(spark.createDataFrame(rows, "tenant_id string, text string"), "tenant_id", "text").collect()}
    texts = [(t, x.lower()) for t, x in rows if t and x]
    heads = {(t, x.strip()[:80]) for t, x in texts if x.strip()}
    assert got == {(t, h): any(o != t and h in x for o, x in texts) for t, h in heads}
    assert got["t", a[:80]] and got["u", "short one"] and not got["t", c[:80]]


def test_windows_across_chunks(spark, monkeypatch):
    from memquarry.operators import leaks

    monkeypatch.setattr(leaks, "CHUNK", 50)
    text = "".join(random.Random(6).choice("abcdefgh ") for _ in range(700))
    wanted = {text[i : i + n] for i, n in ((0, 80), (49, 80), (620, 80), (30, 41), (699, 1))}
    assert leaks._found(text, [1, 41, 80], lambda s: s >= 0) >= wanted
