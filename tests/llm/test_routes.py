import numpy as np

from memquarry.llm.textops import Routes


def test_shared_keys_are_told_with_few_rows_in_their_place():
    rng = np.random.default_rng(1)
    total, counted = [], []
    for _task in range(4):
        routes = Routes()
        for _batch in range(30):
            keys = np.concatenate((np.full(50, 7), np.full(20, 8), rng.integers(100, 100_000, 200))).astype(np.uint64)
            owners = np.concatenate((rng.integers(0, 1 << 40, 50), np.full(20, 5), rng.integers(0, 1 << 40, 200)))
            r = routes.of(keys, owners)
            total += zip(keys.tolist(), owners.tolist(), r.tolist())
    place = {}
    for k, o, r in total:
        place.setdefault((k, r), set()).add(o)
    kept = {(k, o) for k, o, r in total if r > 0 or len(place[k, 0]) > 1}
    owners_of = {}
    for k, o, _ in total:
        owners_of.setdefault(k, set()).add(o)
    assert kept == {(k, o) for k, o, _ in total if len(owners_of[k]) > 1}
    assert sum(k == 7 and r == 0 for k, _, r in total) == 8 and not any(k == 8 and r for k, _, r in total)
    assert len(Routes().of(np.zeros(0, np.uint64), np.zeros(0, np.int64))) == 0
