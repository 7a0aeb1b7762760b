"""References to records that do not exist.

Keys are range-partitioned by boundaries from their quantiles (at most MAX_RANGES strings
on the driver, from a sample of about 40 keys for each). Each range's keys are one sorted array with their times; batches of
references are probed by binary search. Ranges that many references hit are split: their
references are dealt to parts of about REFS_EACH and the range's array is repeated for
each part, so no task holds more than one range and one part of its references.

A reference is 'missing' if its target is in no table, 'deleted' if it is only in the
log of deletions, 'late' if the target was written after the referring row; times count in
whole seconds and an unknown time is never late. Null or empty targets are no references;
repeated references count once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS_EACH, REFS_EACH, MAX_RANGES = 40_000, 40_000, 20_000
UNKNOWN = -(2**62)


def _range_of(bounds: list[str]):
    """Column expression of a key's range: a search in the sorted boundaries, JVM-side for few, vectorised for many."""
    cuts = np.array(bounds, dtype=object)

    @F.pandas_udf("int")
    def find(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, keys.to_numpy(object), "right").astype(np.int32))

    return find


def failing_references(refs: DataFrame, keys: DataFrame, gone: DataFrame) -> DataFrame:
    """(ref_table, ref_id, target_id, state, ref_ts) of the references that fail.

    refs: ref_table, ref_id, target_id, ref_ts (whole seconds or null); keys: id, ts; gone: id.
    """
    refs = refs.select("ref_table", "ref_id", "target_id", "ref_ts").filter((F.col("target_id") != "") & F.col("target_id").isNotNull())
    have = keys.select("id", "ts").filter("id IS NOT NULL").groupBy("id").agg(F.min("ts").alias("ts")).withColumn("live", F.lit(True))
    dead = gone.filter("id IS NOT NULL").select("id").distinct().select("id", F.lit(None).cast("bigint").alias("ts"), F.lit(False).alias("live"))
    both = have.unionByName(dead).groupBy("id").agg(F.max("ts").alias("ts"), F.max("live").alias("live"))
    n = keys.count()
    ranges = min(MAX_RANGES, max(1, math.ceil(n / KEYS_EACH)))
    # boundaries are quantiles of a Bernoulli sample of about 40 keys a range: they only balance the ranges
    drawn = keys.select("id").filter("id IS NOT NULL").sample(min(1.0, 40.0 * ranges / max(1, n) + 1e-9), seed=3) if ranges > 1 else None
    some = sorted({r["id"] for r in drawn.collect()}) if drawn is not None else []
    bounds = sorted({some[i * len(some) // ranges] for i in range(1, ranges)}) if some else []  # from what was drawn, even if it is less than the ranges
    find = _range_of(bounds)

    refs = refs.withColumn("range", find("target_id"))
    load = {r["range"]: r["count"] for r in refs.groupBy("range").count().collect()}  # one row for each range
    parts = [max(1, math.ceil(load.get(r, 0) / REFS_EACH)) for r in range(len(bounds) + 1)]
    table = np.array(parts)

    @F.pandas_udf("int")
    def count_parts(r: pd.Series) -> pd.Series:
        return pd.Series(table[r.to_numpy()].astype(np.int32))

    n_parts = count_parts("range") if max(parts) > 1 else F.lit(1)
    dealt = refs.withColumn("part", F.pmod(F.xxhash64("ref_table", "ref_id", "target_id"), n_parts).cast("int"))
    held = both.withColumn("range", find("id")).withColumn("part", F.explode(F.sequence(F.lit(0), n_parts - 1)))

    def probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("id", kind="stable")
        ids = left["id"].to_numpy(object)
        ts, live = left["ts"].fillna(UNKNOWN).to_numpy(np.int64), left["live"].to_numpy(bool)
        want = right["target_id"].to_numpy(object)
        at = np.searchsorted(ids, want) if len(ids) else np.zeros(len(want), int)
        at_ok = np.minimum(at, max(0, len(ids) - 1))
        hit = (ids[at_ok] == want) if len(ids) else np.zeros(len(want), bool)
        alive = hit & (live[at_ok] if len(ids) else False)
        ref_ts = right["ref_ts"].fillna(UNKNOWN).to_numpy(np.int64)
        late = alive & (ts[at_ok] > ref_ts) & (ref_ts != UNKNOWN) if len(ids) else alive
        state = np.where(late, "late", np.where(alive, "", np.where(hit, "deleted", "missing")))
        out = right[["ref_table", "ref_id", "target_id", "ref_ts"]].assign(state=state)
        return out[state != ""].drop_duplicates()

    out = held.groupBy("range", "part").cogroup(dealt.groupBy("range", "part")).applyInPandas(probe, "ref_table string, ref_id string, target_id string, ref_ts long, state string")
    return out.select("ref_table", "ref_id", "target_id", "state", "ref_ts")


def monthly_misses(failing: DataFrame) -> DataFrame:
    """(ref_table, month, state, misses): failing references counted by table and month of the referring row; unknown times under 'unknown'."""
    month = F.coalesce(F.date_format(F.timestamp_seconds("ref_ts"), "yyyy-MM"), F.lit("unknown"))
    return failing.groupBy("ref_table", month.alias("month"), "state").agg(F.count("*").alias("misses"))
