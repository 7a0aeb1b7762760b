import random

from pyspark.sql import functions as F

from sievelake.operators import hierarchy
from sievelake.operators.components import connected_components

LINKS = "id string, parent_id string, root_id string, depth int, part int"


def frame(spark, pairs):
    return spark.createDataFrame([(i, p, "x", 7, 9) for i, p in pairs], LINKS)


def brute(pairs):
    par = {}
    for i, p in pairs:
        if i is not None:
            par[i] = min(filter(None, (par.get(i), p or None)), default=None)
    out = {}
    for i in par:
        way, seen = [i], {i: 0}
        while True:
            p = par[way[-1]]
            if p is None or p not in par:
                out[i] = (way[-1], len(way) - 1)
                break
            if p in seen:
                out[i] = (min(way[seen[p] :]), -1)
                break
            seen[p] = len(way)
            way.append(p)
    return out


def found(df):
    return {r["id"]: (r["root_id"], r["depth"]) for r in hierarchy.hierarchy(df).collect()}


def test_cases(spark):
    pairs = [("a", None), ("b", "a"), ("c", "b"), ("b", "a"), ("d", ""), ("e", "gone"), ("s", "s"), ("t", "s"), ("x", "y"), ("y", "z"), ("z", "x"), ("w", "y"), (None, "a")]
    assert found(frame(spark, pairs)) == brute(pairs)


def test_empty(spark):
    df = frame(spark, [])
    assert hierarchy.hierarchy(df).count() == 0
    assert hierarchy.descendants(df).count() == 0
    assert hierarchy.descendant_counts(df).count() == 0


def test_only_loops(spark):
    pairs = [("b", "a"), ("a", "b")]
    assert found(frame(spark, pairs)) == {"a": ("a", -1), "b": ("a", -1)}


def test_hot_parent_and_random(spark):
    rng = random.Random(1)
    pairs = [("hub", None)] + [(f"h{i:05}", "hub") for i in range(1500)]
    pairs += [(f"n{i}", rng.choice([None, f"n{rng.randrange(120)}", f"h{rng.randrange(1500):05}"])) for i in range(120)]
    assert found(frame(spark, pairs)) == brute(pairs)


def test_paths_and_descendants(spark):
    df = frame(spark, [("a", None), ("b", "a"), ("c", "b"), ("l", "l")])
    paths = {r["id"]: r["path"] for r in hierarchy.hierarchy(df, with_path=True).collect()}
    assert paths == {"a": "a", "b": "a/b", "c": "a/b/c", "l": None}
    assert {tuple(r) for r in hierarchy.descendants(df).collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}
    assert {r["id"]: r["descendants"] for r in hierarchy.descendant_counts(df).collect()} == {"a": 2, "b": 1, "c": 0}


def test_path_check(spark):
    rows = [("a", None, "/p", 1), ("b", "a", "/p/q", 2), ("c", "a", "/z/q", 5), ("d", "a", None, None), ("e", "none", "/k", 1)]
    df = spark.createDataFrame(rows, "id string, parent_id string, hierarchy_path string, hierarchy_level int")
    got = {r["id"]: (r["path_state"], r["level_state"]) for r in hierarchy.check_paths(df).collect()}
    assert got == {"a": ("unchecked", "ok"), "b": ("ok", "ok"), "c": ("stale", "wrong"), "d": ("missing", "missing"), "e": ("unchecked", "ok")}


def test_components(spark):
    rng = random.Random(2)
    edges = [(f"v{rng.randrange(150)}", f"v{rng.randrange(150)}") for _ in range(110)] + [("a", "a"), (None, "a"), ("p1", "p2")] + [(f"c{i}", f"c{i + 1}") for i in range(30)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for s, d in edges:
        if s and d and s != d:
            a, b = sorted((root(s), root(d)))
            up[b] = a
    nodes = {x for e in edges for x in e if e[0] and e[1] and e[0] != e[1]}
    low = {}
    for x in nodes:
        low[root(x)] = min(low.get(root(x), x), x)
    assert got == {x: low[root(x)] for x in nodes}
    assert connected_components(spark.createDataFrame([], "src string, dst string")).select(F.count("*")).first()[0] == 0


def test_check_against_the_way_up(spark):
    rows = [
        ("a", None, "/p", 1), ("b", "a", "/z/q", 2), ("c", "b", "/z/q/r", 3), ("d", "b", "/p/q/r", 3),  # b stale; c goes on from it, d is sound
        ("e", "a", "/p/q/r", 3), ("f", "a", "/p", 1), ("g", "a", None, 2), ("h", "g", "/p/q/s", 3), ("i", "g", "/p/s", 2),  # a segment too many, none, and below a missing path
        ("m", "gone", None, 0), ("n", "m", "/k/l", 2), ("o", "n", "/k/l/m", None), ("s", "s", "/s", 1), ("t", "s", None, 1),
    ]
    df = spark.createDataFrame(rows, "id string, parent_id string, hierarchy_path string, hierarchy_level int")
    got = {r["id"]: (r["depth"], r["path_state"], r["level_state"]) for r in hierarchy.check_hierarchy(df).collect()}
    assert got == {
        "a": (0, "unchecked", "ok"), "b": (1, "stale", "ok"), "c": (2, "stale", "ok"), "d": (2, "ok", "ok"), "e": (1, "stale", "wrong"), "f": (1, "stale", "wrong"), "g": (1, "missing", "ok"),
        "h": (2, "ok", "ok"), "i": (2, "stale", "wrong"), "m": (0, "missing", "unchecked"), "n": (1, "unchecked", "ok"), "o": (2, "ok", "missing"), "s": (-1, "loop", "loop"), "t": (-1, "loop", "loop"),
    }
    old = {r["id"]: r["path_state"] for r in hierarchy.check_paths(df).collect()}
    assert [old[i] for i in "cefh"] == ["ok", "ok", "ok", "unchecked"]  # what looking at the parent's stored path alone says


def test_deep_chains(spark):
    """A chain of 2,000 levels beside a loop with a tail: all depths, by a plan that does not grow with them."""
    pairs = [(f"n{i:04}", f"n{i - 1:04}" if i else None) for i in range(2000)] + [(f"s{i}", f"n{i * 17:04}") for i in range(100)]
    pairs += [("l0", "l2"), ("l1", "l0"), ("l2", "l1"), *((f"t{i}", f"t{i - 1}" if i else "l1") for i in range(40))]
    df = hierarchy.hierarchy(frame(spark, pairs), with_path=True)
    got = {r["id"]: (r["root_id"], r["depth"]) for r in df.collect()}
    assert got == brute(pairs)
    path = df.filter("id = 'n1999'").first()["path"].split("/")
    assert path == [f"n{i:04}" for i in range(2000)]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") <= 6


def test_ancestors_within(spark):
    df = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("e", "d"), ("x", "y"), ("y", "x")], "id string, parent string")
    got = {tuple(r) for r in hierarchy.ancestors_within(df, 4, "/").select("id", "parent", "dist", "seg").collect()}
    assert {("e", "d", 1, "e"), ("e", "c", 2, "d/e"), ("e", "b", 3, "c/d/e"), ("e", "a", 4, "b/c/d/e"), ("d", "a", 3, "b/c/d"), ("x", "x", 2, "y/x")} <= got
    assert len(got) == 1 + 2 + 3 + 4 + 8
