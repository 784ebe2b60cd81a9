"""Defined cases of commands on keys, collections and texts."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from memquarry.operators import collections as C
from memquarry.operators import keyspace as K
from memquarry.operators import tenancy as T
from memquarry.operators import text as X
from memquarry.operators import vectors as V
from memquarry.plans import files
from memquarry.plans.scratch import new_path, release
from memquarry.streaming import feeds


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_slots_of_nested_braces(spark):
    keys = ["a{b{c}", "{}x", "a{b}c", "}a{b}", "a{b", "", None, "ключ{é}", "a{}{b}"]
    got = {r.k: r.s for r in spark.createDataFrame([(k,) for k in keys], "k string").select("k", T.hash_slot("k").alias("s")).collect()}

    def slot(b: bytes) -> int:
        import binascii

        return binascii.crc_hqx(b, 0) % 16384

    assert got == {"a{b{c}": slot(b"c"), "{}x": slot(b"{}x"), "a{b}c": slot(b"b"), "}a{b}": slot(b"b"), "a{b": slot(b"a{b"), "": slot(b""), None: None, "ключ{é}": slot("é".encode()), "a{}{b}": slot(b"a{}{b}")}
    assert got["a{b{c}"] == 7365


def test_sets_with_conditions_and_flushes(spark):
    log = spark.createDataFrame([("a", 1, "XX", "x"), ("a", 2, "NX", "n"), ("a", 3, "XX", "y"), ("a", 4, "NX", "z"), ("b", 1, "SET", "s"), ("b", 2, "DEL", None), ("b", 3, "XX", "t"), (None, 1, "SET", "u")], "key string, seq int, op string, value string")
    assert {(r.key, r.value) for r in K.set_state(log, "key", "seq", "op", "value").collect()} == {("a", "y"), (None, "u")}
    flush = spark.createDataFrame([(1, "set", 0), (2, "db", 0), (3, "set", 0), (4, "set", 1), (5, "all", 1), (6, "set", 1)], "seq int, op string, db int")
    assert rows(K.flushed(flush, "db", "seq", F.col("op") == "db").where("op = 'set'").select("seq")) == [(3,), (4,), (6,)]
    assert rows(K.flushed(flush, "db", "seq", F.col("op") == "db", F.col("op") == "all").select("seq")) == [(6,)]
    assert K.set_state(log.limit(0), "key", "seq", "op", "value").count() == 0


def test_watches(spark):
    w = spark.createDataFrame([(1, "a", 5, 9), (2, "a", 9, 12), (3, "b", 0, 99), (4, "a", 4, 4)], "txn int, key string, seen long, at long")
    log = spark.createDataFrame([("a", 5), ("a", 9), ("a", 13)], "key string, version long")
    assert rows(K.watch_results(w, log, "key", "version")) == [(1, True, 1), (2, False, 0), (3, False, 0), (4, False, 0)]


def test_json_set(spark):
    docs = [('{"a":{"b":1},"c":[1]}', "2"), (None, '"x"'), ("not json", "1"), ('{"a":5}', "true"), ("[1]", "1"), ('{"a":{}}', "{bad")]
    df = spark.createDataFrame(docs, "d string, v string")
    got = [r.r for r in df.select(C.json_set(F.col("d"), "a.b", F.col("v")).alias("r")).collect()]
    assert got == ['{"a":{"b":2},"c":[1]}', '{"a":{"b":"x"}}', None, '{"a":{"b":true}}', None, None]
    whole = [r.r for r in df.select(C.json_set(F.col("d"), "$", F.col("v")).alias("r")).collect()]
    assert whole[0] == "2" and json.loads(whole[1]) == "x"


def test_pops_of_short_lists(spark):
    df = spark.createDataFrame([("a", 0), ("b", 0), ("b", 1), ("b", 2)], "key string, pos int")
    assert rows(C.popped(df, "key", 1, 1).select("key", "pos", F.coalesce("end", F.lit("-")))) == [("a", 0, "left"), ("b", 0, "left"), ("b", 1, "-"), ("b", 2, "right")]
    assert rows(C.element_set(df.withColumn("v", F.lit(1)), "key", -2, "v", F.lit(9)).select("key", "pos", "v")) == [("a", 0, 1), ("b", 0, 1), ("b", 1, 9), ("b", 2, 1)]


def test_geo_score_is_the_walk_over_the_bits(spark):
    def walk(lon, lat):
        x, y, score = (lon + 180) / 360, (lat + 90) / 180, 0.0
        for i in range(26):
            for part, weight in ((x, 2.0 ** -(i + 1)), (y, 2.0 ** -(i + 2))):
                score += weight * (part >= 0.5)
            x, y = (v * 2 - (v >= 0.5) for v in (x, y))
        return score

    points = [(13.4, 52.5), (-180.0, -90.0), (180.0, 90.0), (0.0, 0.0), (-73.9, 40.7), (179.999999, -0.000001)]
    got = [r.s for r in spark.createDataFrame(points, "lon double, lat double").select(C.geo_score(F.col("lon"), F.col("lat")).alias("s")).collect()]
    assert got == [walk(*p) for p in points]


def test_numbers_and_thresholds(spark):
    texts = ["Cap of three (4) months' fees. Liability ends.", "liability of sixty\ndays", "LIABILITY twenty-four months", "none", None, "", "liability 99999999999999999999 months, 7months"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.n for r in df.select(X.numbers_before(F.col("t"), "months?").alias("n")).collect()]
    assert got[:6] == [[4], [], [24], [], None, []] and got[6][-1] == 7
    states = [r.s for r in df.select(X.threshold_state(F.col("t"), "liabilit", "months?", 12, True).alias("s")).collect()]
    assert states[:6] == ["medium", "medium", "clear", "missing", "missing", "missing"]


def test_features_equal_the_definition(spark):
    import hashlib

    def slow(t, dim=64):
        found = [w for w in __import__("re").findall("[a-z0-9]+", (t or "").lower()) if len(w) > 1 and w not in X.STOP_WORDS]
        v = np.zeros(dim)
        for name, weight in [(w, 1.0) for w in found] + [(f"{a}_{b}", 0.65) for a, b in zip(found, found[1:])]:
            d = hashlib.sha256(name.encode()).digest()
            v[int.from_bytes(d[:4], "big") % dim] += weight * (1 if d[4] & 1 else -1)
        if not found:
            v[0] = 1
        return v / (np.linalg.norm(v) or 1)

    texts = ["Notice of the escrow escrow deposit", "", None, "a", "§ 7 notice", "x1 y2 " * 500]
    got = {r.id: r.embedding for r in X.embedded(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text").collect()}
    for i, t in enumerate(texts):
        assert np.allclose(got[i], slow(t)) and (t is None or np.allclose(X.embed_text(t), slow(t)))


def test_visible_text():
    page = "<html><head><title>T</title><style>x{}</style></head><!-- c --><body><nav>menu <b>deep</b></nav></nav><p>One &amp; two<br>three</p><SCRIPT>if (a<b) {}</SCRIPT><footer>f<header>h</header>g</footer>last <i>word</i></body>"
    assert X.html_text(page) == "T\nOne & two\nthree\nlast\nword"
    assert X.html_text(None) is None and X.html_text("") == "" and X.html_text("plain  text") == "plain text"
    assert X.html_text("<p>a<script>never closed <p>b") == "a" and X.html_text("a &lt;b&gt; <nav>x") == "a <b>"


def test_migration(spark):
    live = spark.createDataFrame([(1, [1.0, 0.0])], "id long, embedding array<double>")
    m = V.Migration(live)
    with pytest.raises(ValueError):
        m.swap()
    with pytest.raises(ValueError):
        m.start().swap()
    with pytest.raises(ValueError):
        m.start().start()
    with pytest.raises(ValueError):
        m.add(live.withColumn("seq", F.lit(1).cast("bigint")))
    full = m.start().add(spark.createDataFrame([(2, [0.0, 1.0], 1), (2, [0.5, 0.5], 2)], "id long, embedding array<double>, seq long"))
    assert [r.id for r in full.live.collect()] == [1] and [(r.id, r.embedding) for r in full.swap().live.collect()] == [(2, [0.5, 0.5])]
    assert [r.id for r in full.cancel().live.collect()] == [1]


def test_dead_letters_and_cache(spark):
    df = spark.createDataFrame([("a", i, True) for i in range(4)] + [("b", 1, True), ("b", 2, False), ("b", 3, True), (None, 9, True)], "job string, at long, failed boolean")
    assert rows(T.dead_letters(df, "job", "at", F.col("failed"), 2, 5)) == [("a", 4, 3)]
    acc = spark.createDataFrame([("k", 0)] * 5 + [("k", 2)] + [("l", 1)], "key string, w int")
    assert rows(T.admitted(acc, "key", F.col("w"), 3)) == [("k", 2), ("l", 0)]


def test_a_feed_goes_on_where_it_was(spark, tmp_path):
    from memquarry.operators.change_store import ChangeStore

    schema = "tenant_id string, seq long, effect_no int, ts_ns long, type int, key string, space string, id string, value string, vector array<float>, expires_at long"
    put = lambda n: spark.createDataFrame([("t", n, 0, 1, 1, f"k{n}", None, None, "v", None, 0)], schema).write.mode("append").parquet(f"{tmp_path}/in")
    path = f"file://{tmp_path}/store"
    put(1)
    feeds.follow(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), ChangeStore(spark, path))
    put(2)
    again = feeds.follow(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), ChangeStore(spark, path))
    assert len(again.runs()) == 2 and again.changes().count() == 2 and again.state(0).count() == 2


def test_released_tables_are_gone(spark):
    path = new_path(spark, "x")
    spark.range(3).write.parquet(path)
    assert files.names(spark, path)
    release()
    assert not files.names(spark, path)


def test_places_in_keys_of_any_size(spark):
    from memquarry.plans.ranking import numbered

    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(F.lit(-1)).alias("k"), ((F.col("id") * 7919) % 1000).alias("v"), "id")
    df = df.unionAll(spark.createDataFrame([(None, 5, -1), (None, None, -2), (-1, None, -3)], "k long, v long, id long"))
    for falls in (False, True):
        got = numbered(df, "k", ["v", "id"], descending=falls)
        groups = {}
        for r in got.collect():
            groups.setdefault(r.k, []).append(r)
        low = lambda x: -1 if x is None else x
        for rows_of in groups.values():
            want = sorted(rows_of, key=lambda r: (low(r.v), r.id), reverse=falls)
            assert [r.pos for r in want] == list(range(len(rows_of)))
        assert len(groups[-1]) > 13_000 and len(groups[None]) == 2
    assert numbered(df.limit(0), "k", ["v"]).count() == 0


def test_sums_and_values_before_in_keys_of_any_size(spark):
    from memquarry.plans.ranking import last_known, running_sum, value_before

    k = F.when(F.col("id") % 4 == 0, F.col("id") % 30).otherwise(F.lit(-1))
    v = F.when(F.col("id") % 7 < 3, F.lit(None)).otherwise((F.col("id") * 31) % 101)
    df = spark.range(6_000).select(k.alias("k"), ((F.col("id") * 7919) % 6007).alias("o"), v.alias("v"))
    df = df.unionAll(spark.createDataFrame([(None, 1, 5), (None, 2, None), (None, 3, 7)], "k long, o long, v long"))
    groups = {}
    for r in df.collect():
        groups.setdefault(r.k, []).append((r.o, r.v))
    want = {}
    for key, x in groups.items():
        total, some, last, before = 0, False, None, None
        for o, value in sorted(x):
            want[key, o] = [last, before]
            total, some = total + (value or 0), some or value is not None
            last, before = (last if value is None else value), value
            want[key, o] += [total if some else None, last]
    got = {(r.k, r.o): [r.x] for r in last_known(df, "k", ["o"], F.col("v"), "x", inclusive=False).collect()}
    for made in (value_before(df, "k", ["o"], F.col("v"), "x"), running_sum(df, "k", ["o"], F.col("v"), "x"), last_known(df, "k", ["o"], F.col("v"), "x")):
        assert made.columns == ["k", "o", "v", "x"]
        for r in made.collect():
            got[r.k, r.o].append(r.x)
    assert got == want and len(groups[-1]) == 4500
    assert running_sum(df.limit(0), "k", ["o"], F.col("v"), "x").count() == 0
