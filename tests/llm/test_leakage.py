import random

import numpy as np
import pytest

from sievelake.functions.words import py_words
from sievelake.llm import leakage as lk

DOC, ITEM = "doc_id long, text string, similarity int, item_id int", "item_id string, passage string, windows int"


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, 0, 0) for d in docs], DOC), spark.createDataFrame([(*i, 0) for i in items], ITEM)


def text(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def found(spark, docs, items):
    return {(r["doc_id"], r["item_id"]) for r in lk.leaks(*frames(spark, docs, items)).collect() if r["same_words"] >= lk.WINDOW}


def brute(docs, items):
    out = set()
    for i, p in items:
        w = py_words(p)
        wins = {tuple(w[k : k + 16]) for k in range(len(w) - 15)}
        for d, t in docs:
            v = py_words(t)
            if any(tuple(v[k : k + 16]) in wins for k in range(len(v) - 15)):
                out.add((d, i))
    return out


@pytest.mark.parametrize("index", [400_000, 300])
def test_against_brute_force(spark, monkeypatch, index):
    monkeypatch.setattr(lk, "INDEX_WINDOWS", index)
    monkeypatch.setattr(lk, "PIECE", 100)
    rng = random.Random(4)
    items = [(f"i{k}", " ".join(text(rng, rng.choice((10, 16, 17, 60))))) for k in range(20)]
    docs = []
    for d in range(60):
        words = text(rng, rng.choice((0, 5, 40, 300)))
        if d % 2:
            p = items[rng.randrange(20)][1].split()
            n = rng.choice((15, 16, 30))
            at = rng.randrange(max(1, len(p) - n + 1))
            words[len(words) // 2 : len(words) // 2] = p[at : at + n]
        docs.append((d, " ".join(words).upper() if d % 3 else ", ".join(words)))
    docs += [(100, None), (101, ""), (102, docs[1][1])]
    want = brute(docs, items)
    assert len(want) > 5 and found(spark, docs, items) == want


def test_small_edits_and_short_items(spark):
    rng = random.Random(5)
    p = text(rng, 40)
    near = p[:3] + ["changed"] + p[4:]
    docs = [(1, " ".join(near)), (2, "before eins zwei drei vier fünf sechs after"), (3, " ".join(text(rng, 200)))]
    items = [("long", " ".join(p)), ("short", "eins zwei drei vier fünf sechs"), ("null", None), ("empty", "")]
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in lk.leaks(*frames(spark, docs, items)).collect()}
    assert set(got) == {(1, "long"), (2, "short")} and got[(2, "short")] == 1.0


def test_empty_tables(spark):
    docs, items = frames(spark, [(1, "a b c")], [("i", "a b c")])
    assert lk.leaks(docs.limit(0), items).count() == 0
    assert lk.leaks(docs, items.limit(0)).count() == 0


def test_all_fingerprints_within_the_radius():
    rng = np.random.default_rng(6)
    idf = np.ones(lk.SKETCH)
    rows = [(f"i{k}", " ".join(f"x{rng.integers(900)}" for _ in range(40))) for k in range(30)]
    index = lk.ItemIndex(rows, idf)
    marks = index.sizes[lk.WINDOW][0]
    h = np.concatenate([lk.word_hashes(rows[3][1]), lk.word_hashes(rows[7][1])])
    own = lk.fingerprints(h, lk.WINDOW)
    want = {(a, b) for a, b in zip(*np.nonzero(np.bitwise_count(own[:, None] ^ marks[None, :]) <= lk.RADIUS))}
    assert set(zip(*index.matches(h, lk.WINDOW))) == want
    slow = []
    for k in range(len(h) - lk.WINDOW + 1):
        w = h[k : k + lk.WINDOW]
        with np.errstate(over="ignore"):
            feats = np.concatenate([w, (w[:-1] * lk._MIX[0]) ^ (w[1:] * lk._MIX[1])])
        slow.append(np.packbits(np.unpackbits(feats.view(np.uint8)).reshape(-1, 64).sum(0) * 2 > 2 * lk.WINDOW - 1).view(np.uint64)[0])
    assert (own == np.array(slow)).all()


def shingle_sets(w, size):
    return [frozenset(tuple(w[a + j : a + j + 5]) for j in range(size - 4)) for a in range(len(w) - size + 1)]


def test_whole_items_with_small_edits(spark):
    """Passages with a word changed, put in, left out or two swapped, of which some window of the item's size is at 0.8 or more: nine in ten are found."""
    rng = random.Random(8)
    items = [(f"i{k}", " ".join(text(rng, rng.randrange(60, 140)))) for k in range(60)]
    docs, want = [], set()
    for d in range(400):
        item, passage = items[d % 60]
        w = passage.split()
        at = rng.randrange(8, len(w) - 8)
        w = {0: w[:at] + ["new"] + w[at + 1 :], 1: w[:at] + ["new"] + w[at:], 2: w[:at] + w[at + 1 :], 3: w[:at] + [w[at + 1], w[at]] + w[at + 2 :]}[d % 4]
        size = lk.item_size(len(passage.split()))
        if max(len(a & b) / len(a | b) for a in shingle_sets(w, size) for b in shingle_sets(passage.split(), size)) >= 0.8:
            want.add((d, item))
        docs.append((d, " ".join(text(rng, rng.randrange(0, 90)) + w + text(rng, rng.randrange(0, 90)))))
    got = {(r["doc_id"], r["item_id"]): r for r in lk.leaks(*frames(spark, docs, items), whole=True).collect()}
    assert len(want) > 300 and set(got) <= {(d, items[d % 60][0]) for d in range(400)}
    # runs of sixteen equal words find all of them; the windows of whole items alone, nine in ten
    assert set(got) >= want
    only = {(r["doc_id"], r["item_id"]) for r in whole_only(spark, docs, items)}
    assert len(only & want) >= 0.9 * len(want)


def whole_only(spark, docs, items):
    old = lk.ItemIndex.__init__

    def init(self, *a):
        old(self, *a)
        self.sizes = {}

    lk.ItemIndex.__init__ = init
    try:
        return lk.leaks(*frames(spark, docs, items), whole=True).collect()
    finally:
        lk.ItemIndex.__init__ = old


def test_windows_count_once(spark, monkeypatch):
    """A short item at the seam of two pieces is one window."""
    monkeypatch.setattr(lk, "PIECE", 20)
    rng = random.Random(9)
    for at in (14, 18, 19, 20, 21):
        w = text(rng, 60)
        docs = [(1, " ".join(w[:at] + "eins zwei drei vier fünf sechs".split() + w[at:]))]
        assert [r["windows"] for r in lk.leaks(*frames(spark, docs, [("short", "eins zwei drei vier fünf sechs")])).collect()] == [1]
