import numpy as np

from sievelake.llm import curves


def test_hilbert_is_a_walk():
    """Each step of the curve goes to a neighbouring cell, and every cell is met once."""
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = curves.hilbert_keys(cells, bits)
        assert sorted(key) == list(range(side**dims))
        path = cells[np.argsort(key)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def frame(spark, ids, x):
    return spark.createDataFrame([(i, None if v is None else [float(y) for y in v], 7, 0, 1) for i, v in zip(ids, x)], "memory_id string, vector array<float>, dimension int, part int, key int")


def brute(ids, x, k, least):
    x = np.asarray(x, float)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    out = set()
    for i in range(len(ids)):
        for j in np.argsort(-s[i])[:k]:
            if s[i, j] >= least:
                out.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return out


def clusters(n, dim, seed=0):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((n // 6, dim))
    return centers[rng.integers(0, len(centers), n)] + 0.2 * rng.standard_normal((n, dim))


def test_recall_with_small_windows(spark, monkeypatch):
    monkeypatch.setattr(curves, "WINDOW", 64)
    monkeypatch.setattr(curves, "BLOCK", 128)
    monkeypatch.setattr(curves, "RANGE_ROWS", 700)
    x = clusters(3000, 64)
    ids = [f"m{i:04}" for i in range(len(x))]
    want = brute(ids, x, 10, 0.85)
    got = {(r["a"], r["b"]) for r in curves.similar_pairs(frame(spark, ids, x), "memory_id", "vector", 64, 10, 0.85).collect()}
    assert len(want) > 1000 and len(got & want) >= 0.9 * len(want)


def test_exact_when_windows_hold_all(spark):
    x = clusters(300, 16, 3)
    ids = [f"m{i:03}" for i in range(len(x))]
    got = curves.nearest(frame(spark, ids, x), "memory_id", "vector", 16, 5).collect()
    s = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = s @ s.T
    np.fill_diagonal(s, -2)
    by = {}
    for r in got:
        by.setdefault(r["id"], []).append(r["neighbour"])
    hit = sum(len(set(by[ids[i]]) & {ids[j] for j in np.argsort(-s[i])[:5]}) for i in range(len(ids)))
    assert all(len(v) == 5 for v in by.values()) and hit >= 0.99 * 5 * len(ids)


def test_unusable_repeated_and_few(spark):
    nan, inf = float("nan"), float("inf")
    x = [[1, 0, 0], [1, 0, 0], [2, 0.1, 0], [0, 0, 0], [nan, 1, 0], [inf, 0, 0], [1, 0], None, [1, 0, 0]]
    ids = ["a", "b", "c", "zero", "nan", "inf", "short", "null", "a"]
    df = frame(spark, ids, x).union(frame(spark, [None], [[1, 0, 0]]))
    got = {(r["a"], r["b"]) for r in curves.similar_pairs(df, "memory_id", "vector", 3, 10, 0.85).collect()}
    assert got == {("a", "b"), ("a", "c"), ("b", "c")}
    assert curves.similar_pairs(df.limit(0), "memory_id", "vector", 3, 10, 0.85).count() == 0


def test_hot_copies(spark):
    """Copies fill a vector's list with ten of them, never with all."""
    x = np.tile([1.0, 0, 0, 0], (1500, 1))
    ids = [f"m{i:04}" for i in range(len(x))]
    near = curves.nearest(frame(spark, ids, x), "memory_id", "vector", 4, 10, 0.85)
    assert near.count() == 15000 and near.filter("score < 0.999").count() == 0


def test_windows_cross_range_boundaries():
    """Every row has an own range; rows around a boundary are context in the range beyond it."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((6000, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    old = curves.RANGE_ROWS
    try:
        curves.RANGE_ROWS = 2000
        c = curves.Curves(x, 8, 3)
    finally:
        curves.RANGE_ROWS = old
    key = c.keys(x, 0)
    own, after, before = c.places(key, 0)
    assert sorted(own[0]) == list(range(6000)) and set(own[1]) == {0, 1, 2}
    order = np.argsort(key, kind="stable")
    rank = np.empty(6000, int)
    rank[order] = np.arange(6000)
    for bound, part in ((int((own[1] == 0).sum()), 0), (int((own[1] <= 1).sum()), 1)):
        near = set(order[bound - 400 : bound]) - set(np.nonzero(key == key[order[bound - 1]])[0])
        assert near <= set(after[0][after[1] == part + 1])
        assert len(set(order[bound : bound + 400]) - set(before[0][before[1] == part])) < 40


def test_exact_finds_far_neighbours(spark, monkeypatch):
    """Lists of ten are the true ones, with hardly similar vectors, more rows than any window and copies among them."""
    for name, v in (("EXACT_FILE", 500), ("EXACT_FILES", 3), ("EXACT_ROWS", 100), ("EXACT_BASE", 300)):
        monkeypatch.setattr(curves, name, v)
    x = np.random.default_rng(4).standard_normal((3000, 32)).astype(np.float32)
    x[1000:1040] = x[7]
    x[50] = x[60]
    ids = [f"m{i:04}" for i in range(len(x))]
    by = {}
    for r in curves.exact_nearest(frame(spark, ids, x), "memory_id", "vector", 32, 10).collect():
        by.setdefault(r["id"], {})[r["rank"]] = r["neighbour"]
    s = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = np.round(s @ s.T, 6)
    np.fill_diagonal(s, -2)
    want = {ids[i]: [ids[j] for j in np.argsort(-s[i], kind="stable")[:10]] for i in range(len(ids))}
    assert {i: [v[r] for r in range(1, 11)] for i, v in by.items()} == want


def test_neighbours_around_hot_copies(spark, monkeypatch):
    """Copies on one place of the curves don't keep the distinct vectors before and after them apart."""
    for name, v in (("WINDOW", 64), ("BLOCK", 128)):
        monkeypatch.setattr(curves, name, v)
    rng = np.random.default_rng(5)
    hot = rng.standard_normal(16)
    around = hot + 0.25 * rng.standard_normal((60, 16))
    x = np.concatenate([np.tile(hot, (1000, 1)), around, rng.standard_normal((600, 16))])
    ids = [f"z{i:04}" for i in range(1000)] + [f"a{i:03}" for i in range(660)]
    by = {}
    for r in curves.nearest(frame(spark, ids, x), "memory_id", "vector", 16, 10, 0.85).collect():
        by.setdefault(r["id"], set()).add(r["neighbour"])
    s = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = s @ s.T
    np.fill_diagonal(s, -2)
    assert all(by[i] <= set(ids[:11]) and len(by[i]) == 10 for i in ids[:1000])
    assert by["z0999"] == set(ids[:10]) and by["z0003"] == set(ids[:11]) - {"z0003"}
    want = {(ids[i], ids[j]) for i in range(1000, 1660) for j in np.lexsort((np.array(ids), -np.round(s[i], 4)))[:10] if s[i, j] >= 0.85}
    distinct = {(i, j) for i, j in want if j[0] == "a"}
    assert len(distinct) > 50 and len({(i, j) for i, j in distinct if j in by.get(i, ())}) >= 0.95 * len(distinct)
