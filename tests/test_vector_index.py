"""The cell index and the block search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from memquarry.operators import blocks, ivf

DIM = 8


def table(spark, n, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, DIM))
    x = centres[rng.integers(0, 6, n)] + 0.3 * rng.standard_normal((n, DIM))
    rows = [(i, [float(v) for v in x[i]]) for i in range(n)]
    rows += [(n, None), (n + 1, [1.0]), (n + 2, [float("nan")] * DIM), (n + 3, [0.0] * DIM), (n + 4, rows[0][1]), (n + 5, rows[0][1])]
    return spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3), rows


def brute(rows, k, asks):
    ok = [(i, np.array(v)) for i, v in rows if v is not None and len(v) == DIM and np.isfinite(v).all()]
    unit = {i: v / (np.linalg.norm(v) or 1) for i, v in ok}
    out = {}
    for q in unit:
        if asks(q):
            s = sorted(((-(round(float(unit[q] @ unit[i]), 6) + 0.0), i) for i in unit if i != q))[:k]
            out[q] = [(i, -s) for s, i in s]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query"], -r["score"], r["id"])):
        out.setdefault(r["query"], []).append((r["id"], r["score"]))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_blocks_equal_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(blocks, "UNIT_QUERIES", 7)
        monkeypatch.setattr(blocks, "UNIT_ROWS", 50)
    df, rows = table(spark, 300)
    got = found(blocks.nearest(df, F.col("id") % 5 == 0, 4, DIM))
    want = brute(rows, 4, lambda q: q % 5 == 0)
    assert got.keys() == want.keys()
    for q in got:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]] and np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-6)
    assert blocks.nearest(df.limit(0), F.lit(True), 4, DIM).count() == 0


def test_every_cell_probed_is_exact(spark):
    df, rows = table(spark, 400, 2)
    index = ivf.CellIndex.build(df, DIM, 9)
    queries = [(i, v) for i, v in rows[:20]]
    want = brute(rows, 5, lambda q: q < 20)
    ids = lambda hits: {q: [i for i, _ in h] for q, h in hits.items()}
    assert ids(found(index.search(queries, 5, 9, exclude_self=True))) == ids(want)
    some = found(index.search(queries, 5, 3, exclude_self=True))
    many = found(index.search_many(df.where("id < 20"), 5, 3))
    assert some == many
    hit = sum(len({i for i, _ in some[q]} & {i for i, _ in want[q]}) for q in want) / 100
    assert hit > 0.9
    assert index.search(queries, 0, 3).count() == 0 and index.search([], 5, 3).count() == 0


def test_an_index_is_opened_and_checked(spark, tmp_path):
    df, _ = table(spark, 200, 3)
    index = ivf.CellIndex.build(df, DIM, 5, f"file://{tmp_path}/cells")
    again = ivf.CellIndex.open(spark, index.path)
    assert np.array_equal(again.centroids, index.centroids) and again.rows.count() == index.rows.count()
    assert again.faults(df).count() == 0
    changed = df.where("id <> 3").withColumn("embedding", F.when(F.col("id") == 4, F.transform("embedding", lambda v: -v)).otherwise(F.col("embedding"))).unionAll(spark.createDataFrame([(900, [1.0] * DIM)], "id long, embedding array<double>"))
    assert {(r["id"], r["fault"]) for r in again.faults(changed).collect()} == {(3, "extra"), (4, "changed"), (900, "missing")}
    moved = ivf.CellIndex(again.rows.withColumn("cell", F.when(F.col("id") == 7, (F.col("cell") + 1) % 5).otherwise(F.col("cell"))), again.centroids, "")
    assert {(r["id"], r["fault"]) for r in moved.faults(df).collect()} == {(7, "cell")}
    empty = ivf.CellIndex.build(df.limit(0), DIM)
    assert empty.search([(1, [1.0] * DIM)], 3, 1).count() == 0 and empty.faults(df.limit(0)).count() == 0
