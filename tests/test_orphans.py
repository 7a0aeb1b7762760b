import random

import pytest

from sievelake.operators import orphans

REFS, KEYS, GONE = "ref_table string, ref_id string, target_id string, ref_ts long, range int, part int", "id string, ts long, live string", "id string, ts int"


def run(spark, refs, keys, gone):
    out = orphans.failing_references(
        spark.createDataFrame([(*r, 1, 2) for r in refs], REFS), spark.createDataFrame([(*k, "x") for k in keys], KEYS), spark.createDataFrame([(g, 0) for g in gone], GONE)
    )
    return out


def brute(refs, keys, gone):
    known = {}
    for i, ts in keys:
        if i is not None:
            known[i] = min((t for t in (known.get(i), ts) if t is not None), default=None)
    out = set()
    for tab, rid, target, ts in refs:
        if not target:
            continue
        if target in known:
            if known[target] is not None and ts is not None and known[target] > ts:
                out.add((tab, rid, target, "late"))
        else:
            out.add((tab, rid, target, "deleted" if target in gone else "missing"))
    return out


def states(df):
    rows = [tuple(r)[:4] for r in df.collect()]
    return set(rows)


def test_cases(spark):
    refs = [("m", "1", "a", 10), ("m", "2", "b", 1), ("m", "3", "gone", 5), ("m", "4", "never", 5), ("m", "5", None, 5), ("m", "6", "", 5), ("v", "7", "c", 5), ("v", "8", "a", None), ("m", "4", "never", 5), ("m", None, "never", None)]
    keys = [("a", 5), ("a", None), ("b", 9), ("c", None), (None, 3)]
    gone = ["gone", "a", "gone", None]
    assert states(run(spark, refs, keys, gone)) == brute(refs, keys, gone)


@pytest.mark.parametrize("refs,keys", [([], [("a", 1)]), ([("m", "1", "a", 1)], []), ([], [])])
def test_empty_tables(spark, refs, keys):
    assert states(run(spark, refs, keys, [])) == brute(refs, keys, [])


def test_ranges_and_hot_target(spark, monkeypatch):
    monkeypatch.setattr(orphans, "KEYS_EACH", 50)
    monkeypatch.setattr(orphans, "REFS_EACH", 40)
    rng = random.Random(3)
    keys = [(f"k{rng.randrange(900):04}", rng.randrange(100)) for _ in range(600)]
    refs = [("m", str(i), "hot" if i % 3 == 0 else f"k{rng.randrange(1000):04}", rng.randrange(100)) for i in range(900)] + [("v", str(i), keys[0][0], 0) for i in range(400)]
    gone = [f"k{i:04}" for i in range(0, 1000, 7)]
    assert states(run(spark, refs, keys, gone)) == brute(refs, keys, gone)


def test_months(spark):
    df = spark.createDataFrame([("m", "1", "a", "missing", 1675209600), ("m", "2", "a", "missing", 1675300000), ("m", "3", "a", "late", None)], "ref_table string, ref_id string, target_id string, state string, ref_ts long")
    assert {tuple(r) for r in orphans.monthly_misses(df).collect()} == {("m", "2023-02", "missing", 2), ("m", "unknown", "late", 1)}
