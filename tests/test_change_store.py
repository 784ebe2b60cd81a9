"""The change store against a replay in plain Python, and its defined cases."""

import random

import pytest
from pyspark.sql import functions as F

from memquarry.operators.change_store import ChangeStore
from memquarry.plans import files

SCHEMA = "tenant_id string, seq long, effect_no int, ts_ns long, type tinyint, key string, space string, id string, value string, vector array<float>, expires_at long, received_at timestamp, extra string"
NOW = 1000


def replay(rows):
    """One effect after another, in log order."""
    keys, vectors = {}, {}
    seen = {}
    for r in rows:
        t, seq, eff, _, kind, key, space, vid, *_rest = r
        if key is None or seq is None or kind not in (1, 2, 3, 4, 6, 7):
            continue
        seen.setdefault((t, seq, eff or 0), r)
    for (t, seq, _), r in sorted(seen.items(), key=lambda x: (x[0][0] or "", x[0][1], x[0][2])):
        kind, key, space, vid, e = r[4], r[5], r[6] or "", r[7], r[10] or 0
        if kind == 1:
            keys[t, key] = seq
        elif kind == 2:
            keys.pop((t, key), None)
        elif kind == 4:
            vectors[t, key, space, vid] = seq
        elif kind == 6:
            vectors.pop((t, key, space, vid), None)
        elif kind == 7:
            for k in [k for k in vectors if k[:3] == (t, key, space)]:
                del vectors[k]
        if kind in (1, 3) and 0 < e <= NOW:
            keys.pop((t, key), None)
    return {(t, k, "", "", s) for (t, k), s in keys.items()} | {(*k, s) for k, s in vectors.items()}


def random_log(n, seed):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        for eff in range(rng.choice([1, 1, 2, 3])):
            kind = rng.choice([1, 1, 1, 2, 3, 3, 4, 4, 6, 7, 42, 0])
            row = (rng.choice(["a", "b", None]), seq, eff, None, kind, rng.choice(["k1", "k2", "k3", None]), rng.choice([None, "", "s"]), rng.choice(["x", "y", "z"]), "v", None, rng.choice([None, 0, -5, 10, 999, 1000, 1001, 5000]), None, "e")
            rows += [row] * rng.choice([1, 1, 2])
    rng.shuffle(rows)
    return rows


def state(df):
    return {tuple(r) for r in df.select("tenant_id", "key", "space", "id", "seq").collect()}


def test_any_order_and_repeats(spark):
    for seed in range(3):
        rows = random_log(250, seed)
        store = ChangeStore(spark)
        store.append(spark.createDataFrame(rows, SCHEMA).repartition(3))
        assert state(store.state(NOW)) == replay(rows)


def test_runs_and_compaction_change_nothing(spark):
    rows = random_log(300, 9)
    store = ChangeStore(spark, compact_after=2)
    for i in range(4):
        store.append(spark.createDataFrame(rows[i::4], SCHEMA))
    assert len(store.runs()) <= 2
    assert state(store.state(NOW)) == replay(rows)
    before = store.changes().count()
    store.compact()
    assert store.changes().count() <= before
    # A late delivery that lies before a deletion does not bring the key back.
    store.append(spark.createDataFrame(rows, SCHEMA))
    assert state(store.state(NOW)) == replay(rows)


def test_payload_has_value_and_deadline(spark):
    rows = [("a", 1, 0, 5, 1, "k", None, None, "old", None, None, None, ""), ("a", 3, 0, 7, 3, "k", None, None, None, None, 2000, None, ""), ("a", 2, 0, 6, 1, "k", None, None, "new", None, None, None, "")]
    store = ChangeStore(spark)
    store.append(spark.createDataFrame(rows, SCHEMA))
    got = store.state(NOW, payload=True).collect()
    assert [(r["key"], r["value"], r["expires_at"], r["seq"]) for r in got] == [("k", "new", 2000, 2)]


def test_empty_log_and_nulls(spark):
    store = ChangeStore(spark)
    store.append(spark.createDataFrame([], SCHEMA))
    assert store.state(NOW).count() == 0
    nulls = [(None,) * 13, ("a", None, 0, 1, 1, "k", None, None, "v", None, None, None, None), ("a", 1, None, None, 1, "k", None, None, None, None, None, None, None)]
    store = ChangeStore(spark)
    store.append(spark.createDataFrame(nulls, SCHEMA).drop("value", "vector").withColumn("rank", F.lit(1)))
    assert state(store.state(NOW)) == {("a", "k", "", "", 1)}


def test_buckets_too_large_for_a_task(spark):
    rows = random_log(300, 4)
    for mixed in (False, True):
        store = ChangeStore(spark, compact_after=2, hot_bytes=1, buckets=4)
        for i in range(4):
            store.append(spark.createDataFrame(rows[i::4], SCHEMA))
        while mixed and store._parts(store.runs())[1] is None:
            store.hot_bytes += 500
        hot, rest = store._parts(store.runs())
        assert hot is not None and (rest is not None) == mixed
        assert state(store.state(NOW)) == replay(rows)
        payload = store.state(NOW, payload=True).select("key", "id", "seq", "value", "expires_at").collect()
        store.compact()
        assert state(store.state(NOW)) == replay(rows)
        assert sorted(map(str, store.state(NOW, payload=True).select("key", "id", "seq", "value", "expires_at").collect())) == sorted(map(str, payload))


def test_reading_does_not_shuffle(spark):
    rows = random_log(200, 5)
    store = ChangeStore(spark)
    for i in range(3):
        store.append(spark.createDataFrame(rows[i::3], SCHEMA))
    for df in (store.state(NOW), store.state(NOW, payload=True)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert state(store.state(NOW, payload=True)) == replay(rows)


def test_a_later_session_opens_the_store(spark, tmp_path):
    rows = random_log(200, 6)
    path = f"file://{tmp_path}/store"
    first = ChangeStore(spark, path, compact_after=1, buckets=3)
    for i in range(3):
        first.append(spark.createDataFrame(rows[i::4], SCHEMA))
    again = ChangeStore(spark, path, compact_after=1)
    assert again.runs() == first.runs()
    again.append(spark.createDataFrame(rows[3::4], SCHEMA))
    assert state(again.state(NOW)) == replay(rows)
    # The first object did not see that append: its next one must not undo it.
    with pytest.raises(FileExistsError):
        first.append(spark.createDataFrame(rows[:1], SCHEMA))
    again.compact()
    again.compact()
    left = [n for n in files.names(spark, path) if n.startswith("run-")]
    assert {r.rsplit("/", 1)[1] for r in again.runs()} < set(left) and len(left) <= 3
    assert state(ChangeStore(spark, path).state(NOW)) == replay(rows)


def test_a_run_that_was_cut_off_is_not_read(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    store = ChangeStore(spark, path)
    store.append(spark.createDataFrame([("a", 1, 0, 1, 1, "k", None, None, "v", None, None, None, "")], SCHEMA))
    store._write(store.changes().withColumn("key", F.lit("lost")))
    assert state(ChangeStore(spark, path).state(NOW)) == {("a", "k", "", "", 1)}
