"""Exact vector search for batches of queries, and an inverted-file index.

The queries are the stated set; they travel to the rows in blocks of at most QUERY_BLOCK
vectors. Each task multiplies its rows with the block, piece by piece, and carries its k best
for each query from piece to piece, so that k rows a query and task are shuffled.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.functions.vectors import usable
from sievelake.operators.fulltext import top_k

QUERY_BLOCK, ROWS, QUERIES = 4096, 4096, 512


def matrix(vectors) -> np.ndarray:
    x = np.array(list(vectors), np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Best:
    """The k best ids of each of n queries so far, by rounded score, then id; an id counts once for a query."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, -np.inf)
        self.rows, self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0)
        self.waiting: list[tuple] = []
        self.held = 0

    def add(self, queries: np.ndarray, ids: np.ndarray, s: np.ndarray) -> None:
        """Scores s of some queries (rows) with ids (columns)."""
        # a margin for rounding: what is too much goes when the lists are pruned
        near = s >= self.least[queries][:, None] - 1e-6
        if s.shape[1] > self.k and near.sum() > 4 * self.k * len(s) and len(set(ids)) == len(ids):
            self.least[queries] = np.maximum(self.least[queries], np.round(np.partition(s, -self.k, axis=1)[:, -self.k], 6))
            near = s >= self.least[queries][:, None] - 1e-6
        r, c = np.nonzero(near & np.isfinite(s))
        self.waiting.append((queries[r], ids[c], s[r, c]))
        self.held += len(r)
        if self.held > 4 * self.k * len(self.least) + 100_000:
            self.prune()

    def prune(self) -> None:
        rows, ids, scores = (np.concatenate([own, *(w[i] for w in self.waiting)]) for i, own in enumerate((self.rows, self.ids, self.scores)))
        f = pd.DataFrame({"r": rows, "id": ids, "s": scores, "s6": -np.round(scores, 6)}).sort_values(["r", "s6", "id"], kind="stable").drop_duplicates(["r", "id"])
        rank = f.groupby("r").cumcount().to_numpy()
        last = f[rank == self.k - 1]
        self.least[last["r"].to_numpy()] = -last["s6"].to_numpy()
        f = f[rank < self.k]
        self.rows, self.ids, self.scores, self.waiting, self.held = f["r"].to_numpy(), f["id"].to_numpy(object), f["s"].to_numpy(), [], 0


def query_blocks(queries: DataFrame):
    """The queries in blocks of about QUERY_BLOCK rows, as pandas frames."""
    n = queries.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    for b in range(blocks):
        yield (queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else queries).toPandas()


def vector_scores(queries: DataFrame, rows: DataFrame, dim: int, k: int, exclude_self: bool = False, keep: tuple[str, ...] = (), least: float | None = None) -> DataFrame:
    """(query_id, id, score): for each query (query_id, vector) candidates that contain its k best rows (id, vector).

    With ``keep``, the k best for each combination of those columns of rows. With ``least``,
    all rows of at least that score instead of the k best. Unusable vectors on either side take
    no part; repeated ids count once.
    """
    spark = rows.sparkSession
    queries = queries.filter(usable(F.col("vector"), dim)).select("query_id", "vector").dropDuplicates(["query_id"])
    rows = rows.filter(usable(F.col("vector"), dim)).select("id", "vector", *keep)
    out = None
    schema = ", ".join([f"query_id {queries.schema['query_id'].dataType.simpleString()}", f"id {rows.schema['id'].dataType.simpleString()}", "score double", *(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)])
    for block in query_blocks(queries):
        held = spark.sparkContext.broadcast((block["query_id"].to_numpy(object), matrix(block["vector"]) if len(block) else np.zeros((0, dim))))

        def run(batches, held=held):
            qid, q = held.value
            best = defaultdict(lambda: Best(len(qid), k))
            for pdf in batches:
                if not len(pdf) or not len(qid):
                    continue
                for name, grp in pdf.groupby(list(keep), dropna=False) if keep else [((), pdf)]:
                    for at in range(0, len(grp), ROWS):
                        part = grp.iloc[at : at + ROWS]
                        x, ids = matrix(part["vector"]).T, part["id"].to_numpy(object)
                        for lo in range(0, len(qid), QUERIES):
                            some = np.arange(lo, min(lo + QUERIES, len(qid)))
                            s = q[some] @ x
                            if exclude_self:
                                s[qid[some][:, None] == ids[None, :]] = -np.inf
                            if least is None:
                                best[name].add(some, ids, s)
                            else:
                                r, c = np.nonzero((s >= least) & np.isfinite(s))
                                yield pd.DataFrame({"query_id": qid[some[r]], "id": ids[c], "score": s[r, c]} | {n: part[n].to_numpy()[c] for n in keep})
            for name, b in best.items():
                b.prune()
                yield pd.DataFrame({"query_id": qid[b.rows], "id": b.ids, "score": b.scores} | dict(zip(keep, name)))

        found = rows.mapInPandas(run, schema)
        out = found if out is None else out.unionByName(found)
    # one shuffle by query serves this and the ranking that follows
    return out.repartition("query_id").dropDuplicates(["query_id", "id", *keep])


def vector_topk(queries: DataFrame, rows: DataFrame, dim: int, k: int, exclude_self: bool = False) -> DataFrame:
    """(query_id, id, score, rank), ties by id."""
    return top_k(vector_scores(queries, rows, dim, k, exclude_self), k)


def ivf_topk(queries: DataFrame, rows: DataFrame, dim: int, k: int, cells: int = 16, probes: int = 6, seed: int = 5) -> DataFrame:
    """(query_id, id, score, rank) from an inverted-file index: the rows of the ``probes`` nearest of ``cells`` k-means cells.

    The cells are fitted on at most 50,000 rows; every row is indexed.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = rows.filter(usable(F.col("vector"), dim))
    n = rows.count()
    sample = rows.sample(min(1.0, 50_000 / n), seed=seed) if n > 50_000 else rows
    model = KMeans(k=min(cells, max(2, n)), seed=seed, distanceMeasure="cosine", featuresCol="f").fit(sample.select(array_to_vector(F.col("vector").cast("array<double>")).alias("f")))
    centers = np.array(model.clusterCenters())
    centers /= np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)

    def cell_of(m: int):
        @F.pandas_udf("array<int>")
        def near(v: pd.Series) -> pd.Series:
            return pd.Series(list(np.argsort(-matrix(v) @ centers.T, axis=1, kind="stable")[:, :m].astype(np.int32)))

        return near

    q = queries.filter(usable(F.col("vector"), dim)).select("query_id", F.col("vector").alias("qv"), F.explode(cell_of(probes)("vector")).alias("cell"))
    r = rows.select("id", "vector", cell_of(1)("vector")[0].alias("cell"))

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series((matrix(a) * matrix(b)).sum(1))

    hits = r.join(q, "cell").select("query_id", "id", score("qv", "vector").alias("score"))
    return top_k(hits.filter(F.col("query_id") != F.col("id")), k)
