"""Cases of the vector commands, sources and streams."""

import pytest
from pyspark.sql import functions as F

from memquarry.engine import Memory
from memquarry.operators import text, vectors
from memquarry.operators.change_store import ChangeStore
from memquarry.sources import binary, snapshots
from memquarry.streaming import feeds


def hits(df):
    return [(r["id"], r["score"]) for r in df.collect()]


@pytest.fixture
def memory(spark):
    return Memory(ChangeStore(spark), "t1", now_ns=100)


def test_exact_order_and_cosine_bounds(memory):
    memory.remember_all("mem", [("a", [1, 0, 0, 0]), ("b", [0, 1, 0, 0]), ("c", [0.99, 0.01, 0, 0]), ("d", [-1, 0, 0, 0])])
    assert [i for i, _ in hits(memory.run("VSEARCH mem 1 0 0 0 3"))] == ["a", "c", "b"]
    scores = dict(hits(memory.run("VSEARCH mem 1 0 0 0 10 EF 40")))
    assert scores["a"] == 1.0 and scores["b"] == 0.0 and scores["d"] == -1.0
    assert hits(memory.run("VSEARCH mem 1 0 0 0 0")) == []
    assert hits(memory.run("VSEARCH none 1 0 0 0 3")) == []


def test_min_score_and_similar(memory):
    memory.remember_all("m", [("a", [1, 0]), ("b", [0.9, 0.1]), ("c", [0, 1])])
    assert [i for i, _ in hits(memory.run("VSEARCH m 1 0 5 MIN_SCORE 0.95"))] == ["a", "b"]
    assert [i for i, _ in hits(memory.run("VSIM m a 5"))] == ["b", "c"]
    with pytest.raises(KeyError):
        memory.run("VSIM m zz 5")


def test_spaces_and_fusion(memory):
    for space, rows in {"text": [("agree", [1, 0]), ("split", [1, 0]), ("other", [0, 1])], "image": [("agree", [1, 0]), ("split", [0, 1]), ("other", [0, 1])]}.items():
        memory.remember_all("m", rows, space)
    memory.remember("m", "plain", vector=[1, 0])
    assert hits(memory.run("VFUSE m SPACE text 1 0 SPACE image 1 0 3 WEIGHTS 1,1")) == [("agree", 1.0), ("split", 0.5), ("other", 0.0)]
    assert [i for i, _ in hits(memory.run("VSEARCH m 1 0 5"))] == ["plain"]
    assert hits(memory.run("VFUSE m SPACE text 1 0 SPACE image 1 0 3 WEIGHTS 1,0 MIN_SCORE 0.9")) == [("agree", 1.0), ("split", 1.0)]
    for bad in ("VFUSE m SPACE text 1 0 3", "VFUSE m SPACE text 1 0 SPACE text 1 0 3", "VFUSE m SPACE text 1 0 SPACE image 1 0 3 WEIGHTS 0,0", "VSEARCH m 1 0 3 WEIGHTS 1", "NOPE", ""):
        with pytest.raises(ValueError):
            memory.run(bad)


def test_documents_and_isolation(memory):
    memory.remember("m", "a", "enterprise memory")
    memory.remember("m", "b", "other words")
    got = memory.run(["VSEARCH", "m", *map(str, text.embed_text("enterprise")), "5", "FILTER_CONTAINS", "enterprise", "WITHDOCS", "doc:m"]).collect()
    assert [(r["id"], r["doc"]) for r in got] == [("a", "enterprise memory")]
    other = Memory(memory.store, "t2", now_ns=100)
    assert hits(other.recall("m", "enterprise")) == []
    memory.forget("m", "a")
    assert [i for i, _ in hits(memory.recall("m", "enterprise"))] == ["b"]


def test_time_travel_asserts_the_score(memory):
    for now, v in ((10, [1, 0]), (20, [0, 1])):
        memory.now_ns = now
        memory.remember("m", "doc", vector=v)
    memory.now_ns = 30
    memory.forget("m", "doc")
    assert hits(memory.run("VSEARCH m 1 0 1 AS_OF 15")) == [("doc", 1.0)]
    assert hits(memory.run("VSEARCH m 1 0 1 AS_OF 25")) == [("doc", 0.0)]
    assert hits(memory.run("VSEARCH m 0 1 1 AS_OF 25")) == [("doc", 1.0)]
    assert hits(memory.run("VSEARCH m 1 0 1")) == []


def test_limits(memory):
    for bad in (lambda: memory.remember("m", "", vector=[1.0]), lambda: memory.remember("m", "a", vector=[float("nan")]), lambda: memory.remember("m", "a", vector=[]), lambda: memory.remember_all("m", [("a", [1.0]), ("b", [1.0, 2.0])]), lambda: memory.remember_all("m", [("a", [1.0])] * 1001)):
        with pytest.raises(ValueError):
            bad()


def test_keys_and_deadlines(memory):
    memory.set("user:1", "x")
    memory.set("user:22", "y", ttl_ns=50)
    memory.set("gone", "z")
    memory.delete("gone")
    assert sorted(r["key"] for r in memory.keys("user:*").collect()) == ["user:1", "user:22"]
    assert [(r["pos"], r["value"]) for r in sorted(memory.get("user:22", "gone", "user:22").collect())] == [(0, "y"), (1, None), (2, "y")]
    memory.now_ns = 150
    assert sorted(r["key"] for r in memory.keys().collect()) == ["user:1"]


def test_search_leaves_out_bad_rows(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [float("nan"), 1.0]), (5, [0.0, 0.0]), (6, [1.0, 0.0])], "id long, embedding array<double>")
    assert [(r.id, r.score) for r in vectors.search(rows, [(0, [2.0, 0.0])], 10).orderBy("id").collect()] == [(1, 1.0), (5, 0.0), (6, 1.0)]
    assert vectors.search(rows.limit(0), [(0, [1.0, 0.0])], 3).count() == 0


def test_binary_vectors(spark):
    rows = [("a", [1.0, 2.0]), ("é", [0.5, -1.0])]
    blob = binary.encode_vectors(rows)
    got = binary.vectors_of(spark.createDataFrame([(blob,), (None,), (b"",)], "b binary"), "b", 2)
    assert [(r.id, r.embedding) for r in got.collect()] == rows
    for bad in (blob[:-1], b"\x00" + blob, binary.encode_vectors([("a", [float("inf"), 0.0])])):
        with pytest.raises(ValueError):
            binary.decode_vectors(bad, 2)


def test_log_files(spark, tmp_path):
    frames = [{"tenant_id": "t", "seq": i, "ts_ns": i * 10, "effects": [{"type": 1, "key": f"k{i % 3}", "value": str(i)}, {"type": 4, "key": "m", "id": "a", "vector": [1.0, float(i)]}]} for i in range(1, 8)]
    (tmp_path / "log.00001").write_bytes(b"".join(map(binary.encode_frame, frames[:4])))
    (tmp_path / "log.current").write_bytes(b"".join(map(binary.encode_frame, frames[4:])) + binary.encode_frame(frames[0])[:-3])
    store = ChangeStore(spark)
    store.append(binary.read_log(spark, f"file://{tmp_path}"))
    assert {(r["key"], r["value"]) for r in store.state(0, payload=True).where("vector IS NULL").collect()} == {("k0", "6"), ("k1", "7"), ("k2", "5")}
    data = bytearray(binary.encode_frame(frames[0]))
    data[-2] ^= 1
    with pytest.raises(ValueError):
        list(binary.decode_frames(bytes(data), True))
    with pytest.raises(ValueError):
        list(binary.decode_frames(binary.encode_frame(frames[0])[:-3], False))


def test_snapshots_and_backups(spark, tmp_path):
    path, target = f"file://{tmp_path}/snap", f"file://{tmp_path}/backup"
    state = spark.createDataFrame([("t", "k", "1"), ("u", "k", "2")], "tenant_id string, key string, value string")
    snapshots.write_snapshot(state, path, 5)
    snapshots.write_snapshot(state.where("tenant_id = 't'"), path, 9)
    got, seq = snapshots.read_snapshot(spark, path)
    assert seq == 9 and [r["key"] for r in got.collect()] == ["k"]
    snapshots.backup(spark, f"{path}/seq=5", target)
    assert snapshots.restore(spark, target).count() == 2
    victim = next((tmp_path / "backup" / "data").rglob("*.parquet"))
    victim.write_bytes(victim.read_bytes() + b"x")
    crc = victim.with_name(f".{victim.name}.crc")
    crc.unlink(missing_ok=True)
    with pytest.raises(ValueError):
        snapshots.restore(spark, target)


def test_html_and_diff(spark):
    assert text.html_text("<nav>x</nav><p>A  <b>b</b>&amp;</p><script>1</script><div>c\n d</div>") == "A\nb\n&\nc d"
    assert text.html_text(None) is None and text.html_text("") == ""
    t, digest = text.html_columns("h")
    got = spark.createDataFrame([("<p>a</p>",), (None,)], "h string").select(t.alias("t"), digest.alias("d")).collect()
    assert got[0].t == "a" and len(got[0].d) == 64 and got[1].t is None
    assert text.line_diff("a\nb\nc", "a\nx\nc\nd") == [("replace", 1, 2, 1, 2), ("insert", 3, 3, 3, 4)]


def test_fixed_windows(spark):
    got = spark.createDataFrame([("a" * 1200,), ("  ",), ("short ",), (None,)], "t string").select(text.windows(F.col("t"), 500, 80).alias("w")).collect()
    assert [len(c) for c in got[0].w] == [500, 500, 360] and got[1].w == [] and got[2].w == ["short"]


def test_windows_of_a_stream_equal_those_of_the_table(spark):
    base = "/root/testdata/sf0.001"
    batch = feeds.tumbling(spark.read.parquet(f"{base}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day", "event_type")
    stream = feeds.tumbling(feeds.table_stream(spark, base, "events").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour"), "ts", "1 day", "event_type")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("tumbled").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("tumbled").collect())) == sorted(map(tuple, batch.collect()))


def test_nothing_outside_imports_the_llm_part():
    from pathlib import Path

    root = Path(__file__).parent.parent / "memquarry"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "memquarry.llm" not in p.read_text(), p
