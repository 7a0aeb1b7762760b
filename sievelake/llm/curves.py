"""Most similar vectors for every vector, through shifted space-filling curves.

Vectors are scaled to unit length and projected to DIMS dimensions by a different rotation of
their AXES principal axes for each curve. Grid cells of the shifted projections are numbered
along a Hilbert curve; Spark range-partitions the keys of each curve, sorts them, and a
window over neighbouring keys compares every vector with those before and after it. The
curves' windows are merged by vector and reranked by cosine. Equal vectors are one on the
curves, so that copies neither fill windows nor gather at a key; ids come back after the merge.

Axes and scales come from a bounded sample of SAMPLE vectors; every vector is indexed. Range
boundaries are read off all sorted keys (ties split by row), as are the places where the
windows around a boundary begin and end: rows there are given to the neighbouring range, too,
where they are candidates only, so windows go on across boundaries.

``similar_pairs`` looks for close vectors: few curves and narrow windows over half-precision
unit vectors (error about 5e-5). ``nearest`` for the whole lists of ten, whose far places are
hardly more similar than random vectors, takes more curves and windows that widen with the
collection (``wide``), over single precision and reranked in double precision.

Null, short, non-finite and all-zero vectors take no part, whatever the column ``dimension``
says; repeated rows of an id count once (the smallest digest wins). Equal similarities are
ordered by id.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievelake.session import materialize, shared_dir

CURVES, DIMS, BITS, AXES = 5, 12, 5, 16
WINDOW, BLOCK = 512, 1024
SAMPLE = 20_000
#: Whole lists: number of curves, least window, and the rows up to which it is enough; beyond, windows grow with rows ** GROWTH.
WIDE_CURVES, WIDE_WINDOW, WIDE_ROWS, GROWTH = 12, 2048, 175_000, 0.75
#: Vectors of one curve that a range holds, about; a range never holds less than its windows need.
RANGE_ROWS = 15_000
#: Parts that the copies of a vector are dealt to when there are more than k.
COPY_PARTS = 32
#: Exact search: rows of a file, least number of files, rows of a block of queries and of a block they are compared with, candidates kept beyond k so that ties are settled by id.
EXACT_FILE, EXACT_FILES, EXACT_ROWS, EXACT_BASE, TIES = 8192, 24, 1024, 4096, 6


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of integer cells (n, d); Skilling's transform, d*bits <= 62."""
    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(len(x)):
            low = np.where(x[i] & q, q - 1, 0)
            swap = (x[0] ^ x[i]) & (q - 1) & ~low
            x[0] = x[0] ^ low ^ swap
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    key = np.zeros(len(cells), np.int64)
    for b in range(bits - 1, -1, -1):
        for v in x:
            key = (key << 1) | (((v ^ t) >> b) & 1)
    return key


class Curves:
    """Projections, scales, shifts and range boundaries of all curves; small, so it travels with the tasks."""

    def __init__(self, sample: np.ndarray, dim: int, ranges: int, curves: int | None = None, window: int | None = None):
        self.count, self.maps = curves or CURVES, []
        center = sample.mean(0) if len(sample) else np.zeros(dim)
        main = np.linalg.eigh(np.atleast_2d(np.cov((sample - center).T)))[1][:, ::-1] if len(sample) > 1 else np.eye(dim)
        main = main[:, : min(AXES, dim)].astype(np.float32)
        for c in range(self.count):
            rng = np.random.default_rng(1000 + c)
            dims = min(DIMS, dim)
            axes = main @ np.linalg.qr(rng.standard_normal((main.shape[1], dims)))[0].astype(np.float32)
            at = sample @ axes if len(sample) else np.zeros((1, dims), np.float32)
            self.maps.append((axes, at.mean(0), np.maximum(at.std(0), 1e-9) * 6.4, rng.random(dims).astype(np.float32) * 0.1 - 0.05))
        self.ranges = ranges
        self.bounds = []  # by curve: (keys, rows) where the window before a boundary begins, of the boundary, and where the window after it ends
        margin = int(1.5 * (window or WINDOW) * max(1, len(sample)) / max(1, RANGE_ROWS * ranges))
        for c in range(self.count):
            key = np.sort(self.keys(sample, c)) if len(sample) else np.zeros(1, np.int64)
            at = np.arange(1, ranges) * len(key) // ranges
            self.bounds.append([(key[np.clip(at + d, 0, len(key) - 1)], np.full(len(at), -1)) for d in (-margin, 0, margin)])

    def set_bounds(self, found: dict[tuple[int, int, int], tuple[int, int]]) -> None:
        """Boundaries as (key, row) by (curve, which of the three, number of the boundary)."""
        for c in range(self.count):
            self.bounds[c] = [tuple(np.array([found[c, w, i][j] for i in range(self.ranges - 1)], np.int64) for j in (0, 1)) for w in range(3)]

    @staticmethod
    def passed(bound: tuple[np.ndarray, np.ndarray], key: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How many boundaries lie at or before each (key, row)."""
        lo, hi = np.searchsorted(bound[0], key, "left"), np.searchsorted(bound[0], key, "right")
        tied = np.nonzero(lo < hi)[0]
        for a in np.unique(lo[tied]):  # keys on a boundary: the row decides
            at = tied[lo[tied] == a]
            hi[at] = a + np.searchsorted(bound[1][a : hi[at[0]]], row[at], "right")
        return hi

    def places(self, key: np.ndarray, c: int, row: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray, bool]]:
        """(rows, range, own): each row's own range, and the ranges before and after it that it is context for."""
        row = np.zeros(len(key), np.int64) if row is None else row
        before, own, after = (self.passed(b, key, row) for b in self.bounds[c])
        nxt, prev, rows = before > own, after < own, np.arange(len(key))
        return [(rows, own, True), (rows[nxt], own[nxt] + 1, False), (rows[prev], own[prev] - 1, False)]

    def keys(self, unit: np.ndarray, c: int) -> np.ndarray:
        axes, mean, width, shift = self.maps[c]
        at = np.clip((unit @ axes - mean) / width + 0.5 + shift, 0, 1 - 1e-6)
        return hilbert_keys((at * (1 << BITS)).astype(np.int64), BITS)


def usable_vectors(df: DataFrame, id_col: str, vec_col: str, dim: int, kind: str) -> DataFrame:
    """(id, digest, vec): usable vectors as bytes, at unit length in half precision ("f2") or as they are in single precision ("f4")."""

    def run(batches):
        for b in batches:
            ids, vecs = b.column(0), b.column(1)
            ok = np.array([n == dim for n in vecs.value_lengths().to_pylist()]) & ids.is_valid().to_numpy(zero_copy_only=False)
            vecs, ids = vecs.filter(pa.array(ok)), ids.filter(pa.array(ok))
            raw = vecs.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
            x = raw.astype(np.float64)
            norm = np.linalg.norm(np.where(np.isfinite(x), x, 0), axis=1)
            ok = np.isfinite(x).all(1) & (norm > 0) & np.isfinite(norm)
            out = ((x[ok] / norm[ok][:, None]).astype(np.float16) if kind == "f2" else raw[ok]).reshape(-1, dim)
            yield pa.record_batch([ids.filter(pa.array(ok)), pa.array([r.tobytes() for r in out], pa.binary())], names=["id", "vec"])

    raw = df.select(F.col(id_col).cast("string").alias("id"), F.col(vec_col).cast("array<float>").alias("v"))
    return raw.mapInArrow(run, "id string, vec binary").select("id", F.unhex(F.md5("vec")).alias("digest"), "vec")


def _raw(vecs, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(vecs), np.float16 if kind == "f2" else np.float32).reshape(len(vecs), -1)


def _unit(raw: np.ndarray) -> np.ndarray:
    """Single-precision vectors of unit length."""
    x = raw.astype(np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of paired rows in double precision."""
    out = np.empty(len(a))
    for at in range(0, len(a), 8192):
        x, y = a[at : at + 8192].astype(np.float64), b[at : at + 8192].astype(np.float64)
        out[at : at + 8192] = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
    return out


def _window_neighbours(x: np.ndarray, owned: np.ndarray, lo: int, hi: int, k: int, least: float):
    """For the owned rows among lo..hi of a sorted run: places and neighbours of the k best in the run around them."""
    mine = lo + np.nonzero(owned[lo:hi])[0]
    s = x[mine] @ x.T
    s[np.arange(len(mine)), mine] = -2
    if s.shape[1] > k:
        # the k-th best value of a row, only where more than k reach the least similarity
        full = np.nonzero((s >= least).sum(1) > k)[0] if least > -1 else np.arange(len(s))
        if len(full):
            part = s[full]
            cut = np.partition(part, -k, axis=1)[:, -k][:, None]
            s[full] = np.where(part >= cut, part, -2)
    r, c = np.nonzero(s >= max(least - 1e-6, -1.5))
    return mine[r], c


def _scan(batches, k: int, least: float, kind: str, window: int, block: int):
    """Sliding windows over rows sorted by (range, key, row); keeps ``window`` rows of context on both sides."""
    ids, parts, owned, raws, units = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), None, None
    start = 0

    def emit(lo, hi):
        for p in np.unique(parts[lo:hi]):
            a, b = lo + np.searchsorted(parts[lo:hi], p), lo + np.searchsorted(parts[lo:hi], p, "right")
            w0, w1 = max(np.searchsorted(parts, p), a - window), min(np.searchsorted(parts, p, "right"), b + window)
            i, j = _window_neighbours(units[w0:w1], owned[w0:w1], a - w0, b - w0, k, least)
            s = _cosines(raws[w0 + i], raws[w0 + j])
            o = np.lexsort((j, -s, i))
            i, j, s = i[o], j[o], s[o]
            first = np.r_[0, np.nonzero(np.diff(i))[0] + 1] if len(i) else np.zeros(0, int)
            rank = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)]))
            keep = (rank < k) & (s >= least)
            yield pd.DataFrame({"a": ids[w0 + i[keep]], "b": ids[w0 + j[keep]], "score": s[keep]})

    for pdf in batches:
        if not len(pdf):
            continue
        raw = _raw(pdf["vec"].tolist(), kind)
        ids, parts, owned = np.r_[ids, pdf["id"].to_numpy()], np.r_[parts, pdf["part"].to_numpy()], np.r_[owned, pdf["own"].to_numpy(bool)]
        raws, units = (raw, _unit(raw)) if raws is None else (np.concatenate([raws, raw]), np.concatenate([units, _unit(raw)]))
        while len(ids) - start >= block + window:
            yield from emit(start, start + block)
            start += block
            drop = max(0, start - window)
            ids, parts, owned, raws, units, start = ids[drop:], parts[drop:], owned[drop:], raws[drop:], units[drop:], start - drop
    while start < len(ids):
        yield from emit(start, min(start + block, len(ids)))
        start += block


def _groups(df: DataFrame, id_col: str, vec_col: str, dim: int, kind: str, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members (gid, id), firsts (gid, id, place): the k + 1 smallest ids of equal vectors, reps (gid, vec): each vector once).

    Copies are combined before the shuffle by digest; nothing longer than a digest is shuffled for the ids.
    """
    units = usable_vectors(df, id_col, vec_col, dim, kind)
    ids = materialize(units.groupBy("id").agg(F.min("digest").alias("digest")), "members")
    each = units.groupBy("digest").agg(F.min("vec").alias("vec")).join(ids.select("digest").distinct(), "digest", "left_semi")
    reps = materialize(each.select(F.monotonically_increasing_id().alias("gid"), "digest", "vec"), "reps")
    members = materialize(ids.join(reps.select("digest", "gid"), "digest").select("gid", "id"), "members")
    firsts = members.withColumn("place", F.row_number().over(W.partitionBy("gid").orderBy("id"))).filter(F.col("place") <= k + 1)
    return members, firsts, reps.select("gid", "vec")


def _expanded(members: DataFrame, firsts: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(id, neighbour, score, rank) from pairs of distinct vectors (a, b, score): copies come first, ties are ordered by id.

    The list of k + 1 ids is made once for all copies of a vector; each copy leaves itself out. A list
    holds up to k copies itself; lists of vectors with more are repeated for COPY_PARTS parts of these copies.
    """
    other = found.join(firsts.filter(F.col("place") <= k).select(F.col("gid").alias("b"), "id"), "b").select(F.col("a").alias("gid"), "id", F.col("score").cast("double").alias("score"), F.lit(0).alias("place"))
    own = firsts.select("gid", "id", F.lit(1.0).alias("score"), "place")
    ranked = own.unionByName(other).withColumn("at", F.row_number().over(W.partitionBy("gid").orderBy((F.col("place") == 0), F.desc(F.round("score", 6)), "id"))).filter(F.col("at") <= k + 1)
    lists = ranked.groupBy("gid").agg(F.max("place").alias("copies"), F.array_sort(F.collect_list(F.struct("at", "id", "score", "place"))).alias("list"))
    lists = materialize(lists.filter(F.size("list") > 1), "lists")
    few = lists.filter(F.col("copies") <= k).select(F.explode(F.filter("list", lambda x: x["place"] > 0)).alias("me"), "list").select("me.id", "list")
    hot = lists.filter(F.col("copies") > k).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(COPY_PARTS - 1))))
    many = members.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(COPY_PARTS)).cast("int")).join(hot, ["gid", "part"]).select("id", "list")
    rest = few.unionByName(many).select("id", F.slice(F.filter("list", lambda x: x["id"] != F.col("id")), 1, k).alias("list"))
    return rest.select("id", F.posexplode("list").alias("rank", "x")).select("id", F.col("x.id").alias("neighbour"), F.col("x.score").alias("score"), (F.col("rank") + 1).alias("rank"))


def _open(path: str) -> str:
    return "/" + path[5:].lstrip("/") if path.startswith("file:") else path


def _best(q: np.ndarray, batches, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, gid, cosine) of the k best among the batches (gid, matrix, place of its first row in q or -1)."""
    rows, ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    parts = [[rows, ids, scores] for _ in range(0, len(q), EXACT_ROWS)]
    kth = np.full(len(q), -1.5, np.float32)
    for gid, x, at in batches:
        for n, lo in enumerate(range(0, len(q), EXACT_ROWS)):
            hi = min(lo + EXACT_ROWS, len(q))
            s = q[lo:hi] @ x.T
            if at >= 0:  # no vector is its own neighbour
                same = np.arange(max(lo, at), min(hi, at + len(x)))
                s[same - lo, same - at] = -2
            if s.shape[1] > k and (s >= kth[lo:hi, None]).sum() > 20 * k * len(s):
                kth[lo:hi] = np.maximum(kth[lo:hi], np.partition(s, -k, axis=1)[:, -k] - 1e-6)
            r, c = np.nonzero(s >= kth[lo:hi, None])
            if not len(r):
                continue
            i, g, v = np.r_[parts[n][0], r], np.r_[parts[n][1], gid[c]], np.r_[parts[n][2], s[r, c]]
            o = np.lexsort((g, -v, i))
            i, g, v = i[o], g[o], v[o]
            first = np.searchsorted(i, np.arange(hi - lo))
            rank = np.arange(len(i)) - first[i]
            last = rank == k - 1
            kth[lo + i[last]] = v[last]
            parts[n] = [i[rank < k], g[rank < k], v[rank < k]]
    return np.concatenate([np.zeros(0, np.int64), *[p[0] + n * EXACT_ROWS for n, p in enumerate(parts)]]), np.concatenate([ids, *[p[1] for p in parts]]), np.concatenate([scores, *[p[2] for p in parts]])


def exact_nearest(df: DataFrame, id_col: str, vec_col: str, dim: int, k: int = 10) -> DataFrame:
    """(id, neighbour, score, rank): the k most similar ids of every usable vector, however little similar; every pair of distinct vectors is compared.

    What ``nearest`` is measured against. The distinct vectors are written to the shared folder
    in files of at most about EXACT_FILE rows; the task of a file reads all files in turn and
    keeps its rows' best, so memory is bounded and nothing but the results is shuffled. Work
    grows with the square of the rows.
    """
    spark = df.sparkSession
    members, firsts, reps = _groups(df, id_col, vec_col, dim, "f4", k)
    path = f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}"
    files = max(EXACT_FILES, math.ceil(df.count() / EXACT_FILE))
    reps.repartition(files, "gid").write.parquet(path)

    def run(batches):
        import pyarrow.parquet as pq
        from pyarrow import fs

        if "://" in path:
            store, at = fs.FileSystem.from_uri(path if not path.startswith("file:") else "file://" + _open(path))
        else:
            store, at = fs.LocalFileSystem(), _open(path)
        names = sorted(f.path for f in store.get_file_info(fs.FileSelector(at)) if f.path.endswith(".parquet"))

        def read(name):
            t = pq.ParquetFile(store.open_input_file(name)).read()
            return t.column("gid").to_numpy(), _unit(_raw(t.column("vec").to_pylist(), "f4"))

        for b in batches:
            for f in b.column(0).to_pylist():
                if f >= len(names):
                    continue
                gids, q = read(names[f])

                def base():
                    for n in range(len(names)):
                        g, x = read(names[n])
                        for lo in range(0, len(x), EXACT_BASE):
                            yield g[lo : lo + EXACT_BASE], x[lo : lo + EXACT_BASE], lo if n == f else -1

                r, g, s = _best(q, base(), k + TIES)
                yield pa.record_batch([pa.array(gids[r]), pa.array(g), pa.array(s.astype(np.float64))], names=["a", "b", "score"])

    found = spark.range(0, files, 1, files).mapInArrow(run, "a long, b long, score double")
    return _expanded(members, firsts, materialize(found, "found"), k)


def _keyed(reps: DataFrame, curves: Curves, kind: str) -> DataFrame:
    """(curve, key, gid) of every vector on every curve."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = _unit(_raw(b.column(1).to_pylist(), kind))
                for c in range(curves.count):
                    yield pa.record_batch([pa.array(np.full(b.num_rows, c, np.int32)), pa.array(curves.keys(x, c)), b.column(0)], names=["curve", "key", "gid"])

    return reps.mapInArrow(run, "curve int, key long, gid long")


def _full_bounds(reps: DataFrame, curves: Curves, kind: str, n: int, window: int) -> dict[tuple[int, int, int], tuple[int, int]]:
    """The boundaries of Curves.set_bounds from all keys, sorted by Spark: three rows for each range reach the driver."""
    order = ["curve", "key", "gid"]
    keys = _keyed(reps, curves, kind).repartitionByRange(max(2, curves.count * curves.ranges), *order).sortWithinPartitions(*order)
    keys = materialize(keys.withColumn("at", F.monotonically_increasing_id()), "keys")
    part = F.shiftright("at", 33)
    pieces = sorted(keys.groupBy("curve", part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("first")).collect(), key=lambda r: (r["curve"], r["part"]))
    wanted = []
    for c in range(curves.count):
        own, before = [r for r in pieces if r["curve"] == c], 0
        ends = np.cumsum([r["n"] for r in own])
        for i in range(1, curves.ranges):
            for w, d in enumerate((-window, 0, window)):
                place = min(max(0, i * n // curves.ranges + d), n - 1)
                p = int(np.searchsorted(ends, place, "right"))
                before = int(ends[p - 1]) if p else 0
                wanted.append((int(own[p]["first"]) + place - before, c, w, i - 1))
    asked = reps.sparkSession.createDataFrame(wanted, "at long, curve int, which int, number int")
    rows = keys.select("at", "key", "gid").join(F.broadcast(asked), "at").collect()  # three rows for each range
    return {(r["curve"], r["which"], r["number"]): (r["key"], r["gid"]) for r in rows}


def wide(n: int) -> int:
    """Window for whole lists over n vectors."""
    return int(WIDE_WINDOW * max(1.0, n / WIDE_ROWS) ** GROWTH)


def nearest(df: DataFrame, id_col: str, vec_col: str, dim: int, k: int = 10, least: float = -1.0, whole: bool = False) -> DataFrame:
    """(id, neighbour, score, rank): the k most similar ids of every usable vector with a cosine of at least ``least``.

    ``whole`` looks for whole lists, far places included: more curves, wide windows, exact cosines.
    """
    kind = "f4" if whole else "f2"
    members, firsts, reps = _groups(df, id_col, vec_col, dim, kind, k)
    n = reps.count()
    window = wide(n) if whole else WINDOW
    ranges = max(1, math.ceil(n / max(RANGE_ROWS, 8 * window)))
    drawn = reps.sample(min(1.0, 1.1 * SAMPLE / n), seed=7).limit(SAMPLE) if n > SAMPLE else reps
    sample = drawn.select("vec").toPandas()["vec"].tolist()
    curves = Curves(_unit(_raw(sample, kind)) if sample else np.zeros((0, dim), np.float32), dim, ranges, WIDE_CURVES if whole else CURVES, window)
    if ranges > 1:
        curves.set_bounds(_full_bounds(reps, curves, kind, n, window))

    def keyed(batches):
        for b in batches:
            if b.num_rows:
                x, gid = _unit(_raw(b.column(1).to_pylist(), kind)), b.column(0).to_numpy()
                for c in range(curves.count):
                    key = curves.keys(x, c)
                    for rows, at, own in curves.places(key, c, gid):
                        if len(rows):
                            take = pa.array(rows)
                            yield pa.record_batch([pa.array((c * curves.ranges + at).astype(np.int32)), pa.array(key[rows]), b.column(0).take(take), b.column(1).take(take), pa.array(np.full(len(rows), own))], names=["part", "key", "id", "vec", "own"])

    placed = (
        reps.select(F.col("gid").alias("id"), "vec").mapInArrow(keyed, "part int, key long, id long, vec binary, own boolean")
        .repartitionById(curves.count * ranges, F.col("part")).sortWithinPartitions("part", "key", "id")
    )
    block = BLOCK
    found = placed.select("part", "id", "vec", "own").mapInPandas(lambda it: _scan(it, k + TIES, least, kind, window, block), "a long, b long, score double")
    # one shuffle by vector serves the merge of the curves and the ranking
    best = found.repartition("a").groupBy("a", "b").agg(F.max("score").alias("score"))
    ranked = best.withColumn("at", F.row_number().over(W.partitionBy("a").orderBy(F.desc("score"), "b"))).filter(F.col("at") <= k + TIES)
    return _expanded(members, firsts, ranked.select("a", "b", "score"), k)


def similar_pairs(df: DataFrame, id_col: str, vec_col: str, dim: int, k: int, least: float) -> DataFrame:
    """(a, b, score), a < b, where one is among the k most similar of the other and the cosine is at least ``least``."""
    near = nearest(df, id_col, vec_col, dim, k, least)
    return near.groupBy(F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b")).agg(F.max("score").alias("score"))
