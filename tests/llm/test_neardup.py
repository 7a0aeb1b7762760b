import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np

from sievelake.functions.words import py_words
from sievelake.llm import neardup as nd

SCHEMA = "id string, text string, toks int, rep int, sig int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, 0, 0) for r in rows], SCHEMA)


def brute(rows, t):
    sets = {i: set(py_words(x)) for i, x in rows if i is not None and py_words(x)}
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9}


def corpus(seed, n, vocabulary, sizes):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(0, 1 + len(words) // 4)):
                k = rng.random()
                at = rng.randrange(len(words) or 1)
                if k < 0.4 and len(words) > 1:
                    words.pop(at)
                elif k < 0.8:
                    words.insert(at, f"w{int(rng.paretovariate(0.6)) % vocabulary}")
                else:
                    rng.shuffle(words)
        else:
            words = [f"w{int(rng.paretovariate(0.6)) % vocabulary}" for _ in range(rng.choice(sizes))]
        rows.append((f"d{i:04}", " ".join(words)))
    return rows


@pytest.mark.parametrize("t", [0.7, 0.8])
def test_against_brute_force(spark, monkeypatch, t):
    monkeypatch.setattr(nd, "LIST_GOAL", 4)
    rows = corpus(1, 250, 3000, (1, 3, 8, 19, 20, 25, 40, 90, 170))
    got = {tuple(r) for r in nd.near_duplicate_pairs(frame(spark, rows), "id", "text", t).collect()}
    assert got == brute(rows, t)


def test_edges(spark):
    rows = [("a", "x y"), ("b", "X, y!"), ("c", None), ("d", ""), ("e", "???"), ("a", "x y"), (None, "x y"), ("f", "你好"), ("g", "好你"), ("h", "w " * 30000 + "z"), ("i", "w z")]
    got = [tuple(r) for r in nd.near_duplicate_pairs(frame(spark, rows), "id", "text", 0.7).collect()]
    assert sorted(got) == [("a", "b"), ("f", "g"), ("h", "i")]
    assert nd.near_duplicate_pairs(frame(spark, []), "id", "text", 0.7).count() == 0
    assert nd.near_duplicate_groups(frame(spark, []), "id", "text").count() == 0


def test_groups(spark):
    base = [f"w{i}" for i in range(40)]
    rows = [("a", " ".join(base)), ("b", " ".join(base[2:])), ("c", " ".join(base[4:])), ("z", "other words entirely"), ("a2", " ".join(base)), ("y", "")]
    got = {r["id"]: (r["group_id"], r["links"]) for r in nd.near_duplicate_groups(frame(spark, rows), "id", "text", 0.8).collect()}
    assert {i: g for i, (g, _) in got.items()} == {"a": "a", "a2": "a", "b": "a", "c": "a", "z": "z"}
    assert got["z"][1] == 0 and got["b"][1] == 2


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from([0.7, 0.8, 0.9]))
def test_a_true_pair_shares_a_signature(seed, t):
    """The guarantee itself, on random sets, classes and sizes."""
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 200))
    a = rng.choice(5000, n, replace=False)
    keep = int(rng.integers(int(np.ceil(t * n)), n + 1))
    b = np.concatenate([rng.choice(a, keep, replace=False), 5000 + rng.choice(500, int(rng.integers(0, max(1, int(n / t) - n + 1))), replace=False)])
    inter = len(np.intersect1d(a, b))
    if inter < t * (len(a) + len(b) - inter):
        return
    counts = np.random.default_rng(5).integers(1, 2000, nd.SKETCH)
    classes = np.random.default_rng(6).integers(1, nd.MAX_CLASS + 1, nd.SKETCH).astype(np.int8)
    small, large = sorted((a.astype(np.int32), b.astype(np.int32)), key=len)
    with np.errstate(over="ignore"):
        x = nd.signatures([np.sort(small)], counts, classes, t, False)[1]
        y = nd.signatures([np.sort(large)], counts, classes, t, True)[1]
        px, py = nd.parities([small])[0], nd.parities([large])[0]
    assert np.intersect1d(x, y).size
    assert sum(int(v).bit_count() for v in (px ^ py).view(np.uint64)) <= (1 - t) / (1 + t) * (len(a) + len(b)) + 1e-9


@pytest.mark.parametrize("t", [0.4, 0.5])
def test_low_thresholds(spark, monkeypatch, t):
    """Partners whose sizes lie several ranges apart are found, too."""
    monkeypatch.setattr(nd, "LIST_GOAL", 4)
    rng = random.Random(3)
    rows = corpus(2, 120, 3000, (22, 25, 40, 90, 170))
    for k, (small, large) in enumerate(((40, 95), (45, 100), (100, 160), (80, 199))):
        words = [f"x{k}_{i}" for i in range(large)]
        rows += [(f"p{k}", " ".join(words)), (f"q{k}", " ".join(rng.sample(words, small)))]
    got = {tuple(r) for r in nd.near_duplicate_pairs(frame(spark, rows), "id", "text", t).collect()}
    assert got == brute(rows, t) and ("p2", "q2") in got


def test_boilerplate_keeps_candidates_few(spark):
    """Texts that share most of their words, but not enough, hardly become candidates; a third of the rows is one text."""
    rng = random.Random(4)
    common = [f"c{i}" for i in range(60)]
    rows = [(f"b{i:03}", " ".join(common + [f"u{rng.randrange(10**9)}" for _ in range(30)])) for i in range(300)] + [(f"s{i:03}", " ".join(common)) for i in range(150)]
    sets = nd.token_sets(frame(spark, rows), "id", "text")
    reps = sets.groupBy("toks").agg({"id": "min"}).selectExpr("monotonically_increasing_id() AS rid", "`min(id)` AS rep", "toks")
    assert nd.candidate_pairs(reps.cache(), nd.sketch_counts(reps), reps.count(), 0.8).count() < 300
    assert {tuple(r) for r in nd.near_duplicate_groups(frame(spark, rows), "id", "text", 0.8).filter("group_id <> id").select("group_id").distinct().collect()} == {("s000",)}


def typical(seed, n):
    """Sets of about 30 to 60 words: five names, then common words, as in texts made of few phrases."""
    rng = np.random.default_rng(seed)
    return [np.unique(np.r_[rng.integers(10_000, 16_000, 5), rng.integers(0, 300, rng.integers(8, 14)), 1000 + rng.integers(0, 90, rng.integers(20, 70))]).astype(np.int32) for _ in range(n)]


def test_rows_and_comparisons_stay_few_in_large_tables():
    """at the size of 6 GB a set had hundreds of signatures."""
    sets, n = typical(1, 3000), 12_000_000
    counts = np.bincount(np.concatenate(sets), minlength=nd.SKETCH) * (n // 3000)
    classes, shares, dealt = nd.plan_for(sets, counts, n, 0.7)
    with np.errstate(over="ignore"):
        rows = len(nd.prefixes(sets[:500], counts, classes, 0.7, shares, dealt)[0]) / 500
        before = len(nd.prefixes(sets[:500], counts, nd.word_classes(counts, n, 2000), 0.7, (5 / 7, 0.5 / 7))[0]) / 500
    assert rows < 200 < before


@pytest.mark.parametrize("shares", sorted({s for _, s in nd.PLANS}))
def test_lists_in_parts(monkeypatch, shares):
    """Lists that lie in several batches and tiles have the pairs of whole lists, and every true pair."""
    import pyarrow as pa

    rng, sets = np.random.default_rng(2), typical(2, 150)
    sets += [np.unique(np.r_[rng.choice(s, int(len(s) * 0.9), replace=False), 20_000 + rng.integers(0, 99, rng.integers(0, 8))]).astype(np.int32) for s in sets]
    counts = np.bincount(np.concatenate(sets), minlength=nd.SKETCH)
    classes, dealt = nd.word_classes(counts, 300, 3), nd.dealt_groups(sets, counts, 0.7, shares)
    with np.errstate(over="ignore"):
        owner, sig, short = nd.prefixes(sets, counts, classes, 0.7, shares, dealt)
        par = nd.parities(sets)
    size = (2 * np.array([len(s) for s in sets])[owner] + ~short).astype(np.int32)
    by = np.lexsort((size, sig))
    table = pa.table({"sig": sig[by], "size": size[by], "rid": owner[by].astype(np.int64)} | {f"p{j}": par[owner[by], j] for j in range(3)})

    def found(step):
        return {p for b in nd.in_lists(table.to_batches(max_chunksize=step), 0.7) for p in zip(b["a"].to_pylist(), b["b"].to_pylist())}

    whole = found(10**6)
    monkeypatch.setattr(nd, "ROWS_AT_ONCE", 50)
    monkeypatch.setattr(nd, "PAIRS_AT_ONCE", 10)
    monkeypatch.setattr(nd, "TILE", 4)
    assert found(37) == whole
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), i))
    inter = lambda i, j: len(np.intersect1d(sets[i], sets[j]))
    true = {(i, j) for k, i in enumerate(order) for j in order[k + 1 :] if (c := inter(i, j)) >= 0.7 * (len(sets[i]) + len(sets[j]) - c)}
    assert len(true) >= 150 and true <= whole


def test_planned_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nd, "PLAN_FROM", 1)
    monkeypatch.setattr(nd, "PLANS", ((4, nd.PLANS[0][1]), (4, nd.PLANS[2][1]), (4, nd.GROUP_SHARES)))
    rows = corpus(7, 250, 3000, (1, 8, 19, 20, 25, 40, 90, 170))
    assert {tuple(r) for r in nd.near_duplicate_pairs(frame(spark, rows), "id", "text", 0.7).collect()} == brute(rows, 0.7)
