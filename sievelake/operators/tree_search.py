"""Search down the parent tree, merging with the flat list, and aggregation by source."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.functions.vectors import cosine
from sievelake.operators.fusion import ranked, rrf
from sievelake.operators.vector_search import vector_topk
from sievelake.session import cut


@dataclass(frozen=True)
class TreeConfig:
    pool: int = 50
    seeds: int = 10
    max_depth: int = 5
    least_score: float = 0.3
    alpha: float = 0.7
    decay: float = 0.9


def expand_tree(seeds: DataFrame, children: DataFrame, max_depth: int) -> DataFrame:
    """(query_id, id, parent, depth) of the nodes at most max_depth below the seeds (query_id, id), each link once.

    children: (id, parent). A loop ends at max_depth; a node keeps its least depth.
    """
    frontier = seeds.select("query_id", "id").distinct().withColumn("depth", F.lit(0))
    out = frontier.withColumn("parent", F.lit(None).cast("string"))
    for d in range(1, max_depth + 1):
        step = frontier.select("query_id", F.col("id").alias("parent")).join(children, "parent").select("query_id", "id", "parent").distinct().withColumn("depth", F.lit(d))
        frontier = cut(step)
        out = out.unionByName(frontier)
    return out.groupBy("query_id", "id", "parent").agg(F.min("depth").alias("depth"))


def best_first(nodes: pd.DataFrame, cfg: TreeConfig) -> pd.DataFrame:
    """The expansion of one query: nodes (id, parent, own, seed) to (id, score); small by construction (the seeds' subtrees).

    The highest score is taken first, ties by id. A node is skipped at the depth bound, under
    the least score or when it was expanded before; a child's score is
    alpha*own + (1-alpha)*parent's*decay^depth, its best score counts.
    """
    own = dict(zip(nodes["id"], nodes["own"]))
    kids: dict[str, list[str]] = {}
    for i, p in zip(nodes["id"], nodes["parent"]):
        if p is not None and p == p:
            kids.setdefault(p, []).append(i)
    best, heap, done = {}, [], set()
    for i in nodes.loc[nodes["seed"], "id"].unique():
        best[i] = own[i]
        heapq.heappush(heap, (-own[i], i, 0))
    while heap:
        neg, i, depth = heapq.heappop(heap)
        if depth >= cfg.max_depth or -neg < cfg.least_score or i in done:
            continue
        done.add(i)
        for c in sorted(set(kids.get(i, ()))):
            s = cfg.alpha * own[c] + (1 - cfg.alpha) * -neg * cfg.decay ** (depth + 1)
            if c not in best or s > best[c]:
                best[c] = s
            heapq.heappush(heap, (-s, c, depth + 1))
    return pd.DataFrame({"id": list(best), "score": list(best.values())})


def tree_scores(queries: DataFrame, seeds: DataFrame, children: DataFrame, vectors: DataFrame, cfg: TreeConfig = TreeConfig()) -> DataFrame:
    """(query_id, id, score) of the best-first expansion of each query's seeds.

    Groups hold one query's subtrees, at most ``seeds`` of them; distance to the query is
    computed before grouping. A missing vector counts as 0.
    """
    nodes = expand_tree(seeds, children, cfg.max_depth)
    q = queries.select("query_id", F.col("vector").alias("qv"))
    rated = (
        nodes.join(q, "query_id").join(vectors.select("id", "vector"), "id", "left")
        .select("query_id", "id", "parent", cosine(F.col("qv"), F.col("vector")).alias("own"), (F.col("depth") == 0).alias("seed"))
    )
    kind = queries.schema["query_id"].dataType.simpleString()

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return best_first(pdf, cfg).assign(query_id=key[0])[["query_id", "id", "score"]]

    return rated.groupBy("query_id").applyInPandas(run, f"query_id {kind}, id string, score double")


def tree_search(queries: DataFrame, docs: DataFrame, children: DataFrame, vectors: DataFrame, dim: int, k: int, cfg: TreeConfig = TreeConfig()) -> DataFrame:
    """Flat top pool, expansion of its first seeds, reciprocal-rank merge, aggregation by source, k best.

    docs: id, source_file, chunk_index, abstract. Returns query_id, id, score, chunk_count, abstract, rank.
    """
    flat = cut(vector_topk(queries, vectors.join(docs.select("id"), "id"), dim, cfg.pool))
    deep = ranked(tree_scores(queries, flat.filter(F.col("rank") <= cfg.seeds), children, vectors, cfg).withColumn("score", F.round("score", 9)), ["query_id"])
    merged = rrf([flat, deep], ["query_id"])
    return ranked(aggregate_by_source(merged.join(docs, "id")).withColumn("score", F.round("score", 6)), ["query_id"]).filter(F.col("rank") <= k)


def aggregate_by_source(results: DataFrame, by: str = "query_id") -> DataFrame:
    """(by, id, score, chunk_count, abstract): rows of one source file (or one row without a source) become one.

    The best score decides (ties: lower chunk_index, then id). The abstract lists the first
    three chunks by chunk_index and counts the others. Only three rows of a source are ever
    kept together: they are cut by rank before they are collected.
    """
    r = results.withColumn("grp", F.coalesce(F.nullif("source_file", F.lit("")), F.concat(F.lit("id:"), "id")))
    head = r.groupBy(by, "grp").agg(F.min_by("id", F.struct(-F.col("score"), F.coalesce("chunk_index", F.lit(0)), "id")).alias("id"), F.max("score").alias("score"), F.count("*").alias("chunk_count"))
    from pyspark.sql import Window as W

    nth = F.row_number().over(W.partitionBy(by, "grp").orderBy(F.coalesce("chunk_index", F.lit(0)), "id"))
    first = r.withColumn("nth", nth).filter("nth <= 3").groupBy(by, "grp").agg(F.array_sort(F.collect_list(F.struct("nth", F.coalesce("abstract", F.lit("")).alias("a"), F.coalesce("chunk_index", F.lit(0)).alias("i")))).alias("f"))
    lines = F.array_join(F.transform("f", lambda x: F.concat(F.lit("[Part "), (x["i"] + 1).cast("string"), F.lit("] "), x["a"], F.lit("\n"))), "")
    more = F.when(F.col("chunk_count") > 3, F.concat(F.lit("... (+"), (F.col("chunk_count") - 3).cast("string"), F.lit(" more chunks)\n"))).otherwise("")
    own = F.coalesce(F.col("f")[0]["a"], F.lit(""))
    return head.join(first, [by, "grp"]).select(by, "id", "score", "chunk_count", F.when(F.col("chunk_count") > 1, F.concat(lines, more)).otherwise(own).alias("abstract"))
