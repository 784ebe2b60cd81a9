"""Neighbours against brute force."""

from math import comb

import numpy as np
import pytest

from memquarry.llm.similar_vectors import SimilarVectors

SCHEMA = "tenant_id string, index_name string, space string, id long, embedding array<float>, generation long, tombstone boolean, coll string, words int"


def clustered(rng, n, dim=64):
    base = rng.standard_normal((n, dim))
    out = [base]
    for scale in (0.02, 0.05, 0.08, 0.1):
        pick = base[rng.integers(0, n, n // 4)]
        out.append(pick + scale * np.linalg.norm(pick, axis=1, keepdims=True) / np.sqrt(dim) * rng.standard_normal(pick.shape) * 4)
    return np.vstack(out) * rng.uniform(0.01, 50, (n + 4 * (n // 4), 1))


def truth(rows, k, least):
    best = {}
    for r in rows:
        if r[3] is not None and (r[3] not in best or (r[5] or -1) > (best[r[3]][5] or -1)):
            best[r[3]] = r
    groups = {}
    for r in best.values():
        if r[6] or r[4] is None or len(r[4]) != 64 or any(x is None for x in r[4]):
            continue
        v = np.array(r[4], np.float32).astype(float)
        if np.isfinite(v).all() and v.any():
            groups.setdefault((r[0], r[1], r[2] or ""), []).append((r[3], v / np.linalg.norm(v)))
    out = set()
    for g in groups.values():
        ids = np.array([i for i, _ in g])
        x = np.array([v for _, v in g])
        s = np.round(x @ x.T, 9)
        for i in range(len(ids)):
            order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[i, j], ids[j]))[:k]
            out |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in order if s[i, j] >= least}
    return out


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA).repartition(3)
    n = SimilarVectors(df, **options).neighbours().collect()
    return {(min(r.id, r.other), max(r.id, r.other)) for r in n}, n


def test_recall_and_exactness(spark):
    rng = np.random.default_rng(3)
    x = clustered(rng, 900)
    rows = [("t", ("a", "b")[i % 2], None, i, [float(v) for v in x[i]], 1, False) for i in range(len(x))]
    want = truth(rows, 10, 0.9)
    got, _ = found(spark, rows)
    assert len(want) > 200 and len(got & want) >= 0.97 * len(want) and got <= want


@pytest.mark.parametrize("reach", [1, 2, 3])
def test_cells_and_blocks_find_the_same(spark, monkeypatch, reach):
    from memquarry.llm import similar_vectors as m

    rng = np.random.default_rng(5)
    x = clustered(rng, 600)
    rows = [("t", "a", None, i, [float(v) for v in x[i]], 1, False) for i in range(len(x))]
    want = truth(rows, 10, 0.9)
    whole, _ = found(spark, rows, reach=reach)
    monkeypatch.setattr(m, "CELL", 64)
    monkeypatch.setattr(m, "UNIT", 16)
    parted, _ = found(spark, rows, reach=reach)
    assert len(whole ^ parted) <= 0.03 * len(whole)
    assert whole <= want and parted <= want and min(len(whole), len(parted)) >= 0.97 * len(want)


@pytest.mark.parametrize("reach", [1, 2, 3])
def test_a_cell_gives_all_pairs_within_reach_of_a_substring(reach):
    """Cells by each byte together find exactly the pairs of the pigeonhole principle."""
    from memquarry.llm import similar_vectors as m

    rng = np.random.default_rng(reach)
    tables, wide, n = 3, reach + 1, 3000
    own = np.zeros((n, 16), np.uint8)
    own[:, : tables * wide] = rng.integers(0, 256, (n, tables * wide))
    for i in range(0, n, 2):  # close partners
        own[i + 1] = own[i]
        for _ in range(rng.integers(1, 9)):
            own[i + 1, rng.integers(0, tables * wide)] ^= np.uint8(1 << rng.integers(0, 8))
    codes = own.view(np.uint64)
    got = set()
    for part in range(tables * wide):
        cell = own[:, part] >> 5
        for v in np.unique(cell):
            at = np.flatnonzero(cell == v)
            for x, y in m._pairs_of_cell(codes[at], part, tables, reach, 1000):
                new = {(min(a, b), max(a, b)) for a, b in zip(at[x].tolist(), at[y].tolist())}
                got |= new
    x, y = np.triu_indices(n, 1)
    least = np.min([np.bitwise_count(own[x, t * wide : (t + 1) * wide] ^ own[y, t * wide : (t + 1) * wide]).sum(1) for t in range(tables)], 0)
    want = set(zip(x[least <= reach].tolist(), y[least <= reach].tolist()))
    assert want <= got and len(want) > n // 4
    whole = {(min(a, b), max(a, b)) for p, q in m._pairs_of_cell(codes, -1, tables, reach, 1000) for a, b in zip(p.tolist(), q.tolist())}
    assert want <= whole


def test_reach_grows_with_the_collection():
    from memquarry.llm import similar_vectors as m

    assert [m.reach_for(n) for n in (0, 10**6, 10**8, 10**11)] == [1, 1, 2, 3]
    p = np.arccos(0.9) / np.pi  # a table finds a pair at the cosine with about the same chance
    for reach in (1, 2, 3):
        w = 8 * (reach + 1)
        chance = sum(comb(w, k) * p**k * (1 - p) ** (w - k) for k in range(reach + 1))
        assert 1 - (1 - chance) ** 12 > 0.985 and len(m.masks(reach + 1, reach)) == sum(comb(w, k) for k in range(1, reach + 1))
        assert len(m.masks(reach + 1, reach, 0)) == sum(comb(w - 8, k) for k in range(1, reach + 1)) and not (m.masks(reach + 1, reach, 0) & 255).any()


def test_generations_and_bad_rows(spark):
    e = [1.0] + [0.0] * 63
    f = [1.0, 0.1] + [0.0] * 62
    rows = [
        ("t", "a", None, 1, e, 2, False), ("t", "a", "", 1, [0.0] + e[1:-1] + [1.0], 1, False), ("t", "a", "", 2, f, 1, None), ("t", "a", "", 2, f, 1, None),
        ("t", "a", None, 3, e, 1, False), ("t", "a", None, 3, e, 2, True), ("t", "a", "s", 4, e, 1, False), ("u", "a", None, 5, e, 1, False), (None, None, None, 6, e, None, False), (None, None, None, 7, f, None, False),
        ("t", "a", None, 8, None, 1, False), ("t", "a", None, 9, [0.0] * 64, 1, False), ("t", "a", None, 10, [float("nan")] * 64, 1, False), ("t", "a", None, 11, [1.0] * 63, 1, False), ("t", "a", None, 12, [None] + e[1:], 1, False),
        ("t", "a", None, 13, [float("inf")] + e[1:], 1, False), ("t", "a", None, None, e, 1, False),
    ]
    got, _ = found(spark, rows)
    assert got == truth(rows, 10, 0.9) == {(1, 2), (6, 7)}


def test_many_copies_have_k_neighbours_each(spark):
    e, f = [1.0, 0.0] + [0.0] * 62, [1.0, 0.05] + [0.0] * 62
    rows = [("t", "a", None, i, e if i < 400 else f, 1, False) for i in range(410)]
    got, n = found(spark, rows, k=3)
    assert got == truth(rows, 3, 0.9)
    assert len(n) == 410 * 3


def test_empty_table(spark):
    assert found(spark, [])[0] == set()


@pytest.mark.parametrize("cosine", [0.9, 0.95])
def test_pairs_below_the_cosine_stay_out(spark, cosine):
    rng = np.random.default_rng(8)
    x = clustered(rng, 200)
    rows = [("t", "a", None, i, [float(v) for v in x[i]], 1, False) for i in range(len(x))]
    got, n = found(spark, rows, min_cosine=cosine)
    assert all(r.cosine >= cosine for r in n) and got <= truth(rows, 10, cosine)


def ranks(rows, k):
    x = np.array([np.array(r[4], np.float32).astype(float) for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 12)
    return {
        r[3]: [rows[j][3] for j in sorted((j for j in range(len(rows)) if j != i and rows[j][:2] == r[:2]), key=lambda j: (-s[i, j], rows[j][3]))[:k]]
        for i, r in enumerate(rows)
    }


@pytest.mark.parametrize("block", [1 << 17, 60])
def test_every_vector_gets_its_k(spark, monkeypatch, block):
    from memquarry.llm import similar_vectors as m

    monkeypatch.setattr(m.blocks, "UNIT_ROWS", block)
    monkeypatch.setattr(m.blocks, "UNIT_QUERIES", block)
    rng = np.random.default_rng(13)
    x = clustered(rng, 200)
    x[7] = x[3] = x[1]
    rows = [("t", "small" if i < 5 else "large", None, i, [float(v) for v in x[i]], 1, False) for i in range(len(x))]
    want = ranks(rows, 10)
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA).repartition(3)
    found = SimilarVectors(df)
    got = {}
    for r in sorted(found.complete().collect(), key=lambda r: (r.id, r.place)):
        got.setdefault(r.id, []).append(r.other)
    assert got.keys() == want.keys() and all(len(got[i]) == len(want[i]) for i in want)
    assert sum(len(set(got[i]) & set(want[i])) for i in want) >= 0.99 * sum(map(len, want.values()))
    assert got[0] == want[0] and len(got[0]) == 4
    some = {(r.id, r.other) for r in found.complete(m.F.col("id") % 20 == 0).collect()}
    assert some == {(i, o) for i, others in got.items() if i % 20 == 0 for o in others}
