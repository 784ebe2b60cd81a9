import math
import random

import pytest
from pyspark.sql import functions as F

from memquarry.llm import mixing, packing, tokens


@pytest.fixture(scope="module")
def sizes():
    rng = random.Random(2)
    return [int(rng.lognormvariate(5.5, 0.9)) + 1 for _ in range(4000)] + [2048, 2049, 4096, 10_000, 1]


def test_packing_places_everything_within_capacity(spark, sizes):
    rows = [(i, s) for i, s in enumerate(sizes)] + [(-1, 0), (-2, None), (7, sizes[7])]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, size long, item string, bin int").repartition(5)
    packed = packing.pack(df, "doc_id", "size", 2048).collect()
    per_item, used = {}, {}
    for r in packed:
        per_item.setdefault(r.item, []).append(r.size)
        used[r.container] = used.get(r.container, 0) + r.size
    assert max(used.values()) <= 2048 and min(r.size for r in packed) > 0
    assert sum(used.values()) == sum(sizes) + sizes[7]
    assert set(per_item) == set(range(len(sizes)))
    for i, parts in per_item.items():
        if i != 7:
            assert len(parts) == -(-sizes[i] // 2048)  # cut only beyond the capacity
    waste = 1 - sum(used.values()) / (len(used) * 2048)
    assert waste < 0.03


def test_merging_in_several_tasks(spark, sizes):
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, size long").repartition(8)
    packed = packing.pack(df, "doc_id", "size", 2048, open_bins=16, merge_items=20)
    assert packed.agg(F.sum("size")).first()[0] == sum(sizes)
    assert packing.containers(packed, 2048).agg(F.min("unused")).first()[0] >= 0


def test_packing_nothing(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, size long"), "doc_id", "size", 10).count() == 0


def test_rates():
    for mean, cap in [(0.3, 1), (0.99, 1), (1.7, 2), (2.2, 5), (0.01, 3), (4.9, 5)]:
        t = mixing.thresholds(mean, cap)
        assert len(t) == cap and abs(sum(1 - x for x in t) - mean) < 1e-6
    assert mixing.thresholds(5, 5) == [0.0] * 5 and math.isinf(mixing.rate_for(3, 2))


def test_mixture(spark):
    docs = spark.range(30_000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 7, "big").when(F.col("id") % 10 < 9, "mid").when(F.col("id") % 10 == 9, "small").alias("source"), (F.col("id") % 50 + 1).alias("size"), F.lit(1).alias("thresholds"), F.lit("t").alias("available")
    )
    docs = docs.unionAll(spark.createDataFrame([(-1, None, 10, 1, "t"), (-2, "big", None, 1, "t"), (-3, "unlisted", 10, 1, "t"), (-4, "big", 0, 1, "t")], docs.schema))
    targets = spark.createDataFrame([("big", 0.4, 1), ("mid", 0.3, 3), ("small", 0.3, 2), ("none", 0.0, 1), ("empty", 0.1, 2), (None, 0.2, 1), ("big", 0.2, 9)], "source string, target_share double, max_repeats int")
    planned = mixing.plan(docs, targets).cache()
    mixed = mixing.mix(docs, planned)
    report = {r.source: r for r in mixing.report(mixed, planned).collect()}
    total = 764_490  # sizes of the three sources with text
    assert report["empty"].used == 0 and set(report) == {"big", "mid", "small", "none", "empty"}
    assert abs(report["big"].used / (0.4 * total) - 1) < 0.03 and abs(report["mid"].used / (0.3 * total) - 1) < 0.05
    assert report["small"].short and report["small"].most_uses == 2 and report["small"].used == 2 * report["small"].available
    assert report["mid"].most_uses <= 3 and report["big"].most_uses == 1
    assert abs(sum(r.actual_share for r in report.values()) - 1) < 1e-9
    again = mixing.mix(docs.repartition(7), planned)
    assert sorted(map(tuple, mixed.select("doc_id", "copy_no", "place").collect())) == sorted(map(tuple, again.select("doc_id", "copy_no", "place").collect()))
    places = [r.place for r in mixed.select("place").collect()]
    assert places == sorted(places)


def test_empty_mixture(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, size long")
    planned = mixing.plan(docs, spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int"))
    assert mixing.mix(docs, planned).count() == 0
    assert [r.used for r in mixing.report(mixing.mix(docs, planned), planned).collect()] == [0]


def test_token_counts():
    enc = tokens.encoding()
    long = "word and another, 12345\n" * 8000
    for t in ["", "a", "Hello world", "  spaces  ", "é🔒 ünï\n\n", "<|endoftext|>", long]:
        assert tokens.count(t) == len(enc.encode_ordinary(t))
    assert tokens.count(None) == 0
    assert 0 < tokens.count("x" * 300_000) < 300_000
