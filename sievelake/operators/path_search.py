"""Search along a path: every level of the query's path, weighted, with a global fallback.

One plan serves all queries and levels: text hits are joined on the prefixes of the document's
own path (an equi-join), so no prefix is compared with every document; vector hits are found
where the documents are, and only the best of each level are shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievelake.functions.scoring import ScoringConfig, apply_scoring
from sievelake.functions.text import level_weight, path_levels
from sievelake.functions.vectors import usable
from sievelake.operators.fulltext import search_text
from sievelake.operators.fusion import ranked, rrf
from sievelake.operators.vector_search import QUERIES, ROWS, Best, matrix, query_blocks, vector_scores
from sievelake.session import cut, materialize

OVERFETCH, FALLBACK = 2, 0.5


def query_levels(queries: DataFrame) -> DataFrame:
    """(query_id, level, weight) of queries (query_id, path)."""
    lv = queries.select("query_id", path_levels(F.col("path")).alias("ls")).select("query_id", F.size("ls").alias("n"), F.posexplode("ls").alias("i", "level"))
    return lv.select("query_id", "level", level_weight(F.col("i"), F.col("n")).alias("weight"))


def under_level(docs: DataFrame) -> DataFrame:
    """(id, level): a document is under each prefix of its path that ends before a slash, and under the path itself.

    The path "/" is under "/" only.
    """
    slashes = F.filter(F.sequence(F.lit(2), F.greatest(F.length("hierarchy_path"), F.lit(2))), lambda i: F.substring(F.col("hierarchy_path"), i, F.lit(1)) == "/")
    prefixes = F.transform(slashes, lambda i: F.substring(F.col("hierarchy_path"), F.lit(1), i - 1))
    return docs.filter("hierarchy_path IS NOT NULL").select("id", F.explode(F.array_distinct(F.concat(prefixes, F.array("hierarchy_path")))).alias("level"))


def level_hits(scores: DataFrame, docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, level, id, score, rank): the k best of scores (query_id, id, score) under each level of the query's path."""
    lv = query_levels(queries)
    hits = scores.join(lv, "query_id").join(under_level(docs), ["id", "level"])
    return ranked(hits.select("query_id", "level", "weight", "id", F.round("score", 6).alias("score")), ["query_id", "level"]).filter(F.col("rank") <= k)


def level_vector_hits(queries: DataFrame, docs: DataFrame, vectors: DataFrame, dim: int, k: int) -> DataFrame:
    """(query_id, level, weight, id, score, rank): the k most similar documents under each level of the query's path.

    Queries (query_id, vector, path) travel to the documents in blocks of at most QUERY_BLOCK, as in
    vector_scores; a task multiplies only the rows under a level with the queries that have it in their
    path, and carries its k best for each query and level.
    """
    spark, lists = docs.sparkSession, []
    rows = docs.filter("hierarchy_path IS NOT NULL").select("id", "hierarchy_path").join(vectors.filter(usable(F.col("vector"), dim)).select("id", "vector"), "id")
    asked = queries.filter(usable(F.col("vector"), dim)).select("query_id", "vector", path_levels(F.col("path")).alias("levels")).filter(F.size("levels") > 0).dropDuplicates(["query_id"])
    for block in query_blocks(asked):
        pairs = [(i, n, lv) for i, ls in enumerate(block["levels"]) for n, lv in enumerate(ls)]  # one for each level of each query
        under: dict[str, list[int]] = {}
        for j, (_, _, lv) in enumerate(pairs):
            under.setdefault(lv, []).append(j)
        held = spark.sparkContext.broadcast((block["query_id"].to_numpy(object), matrix(block["vector"]) if len(block) else np.zeros((0, dim)), np.array([i for i, _, _ in pairs], int), {lv: np.array(js) for lv, js in under.items()}, np.array([lv for _, _, lv in pairs], object)))

        def run(batches, held=held):
            qid, q, of, under, name = held.value
            best = Best(len(of), k)
            for pdf in batches:
                for at in range(0, len(pdf), ROWS):
                    part = pdf.iloc[at : at + ROWS]
                    x, ids, mine = matrix(part["vector"]), part["id"].to_numpy(object), {}
                    for i, path in enumerate(part["hierarchy_path"]):
                        for lv in prefixes(path):
                            if lv in under:
                                mine.setdefault(lv, []).append(i)
                    for lv, some in mine.items():
                        for lo in range(0, len(under[lv]), QUERIES):
                            js = under[lv][lo : lo + QUERIES]
                            best.add(js, ids[some], q[of[js]] @ x[some].T)
            best.prune()
            yield pd.DataFrame({"query_id": qid[of[best.rows]], "level": name[best.rows], "id": best.ids, "score": best.scores})

        kind = asked.schema["query_id"].dataType.simpleString()
        lists.append(rows.mapInPandas(run, f"query_id {kind}, level string, id string, score double"))
    found = lists[0]
    for x in lists[1:]:
        found = found.unionByName(x)
    found = found.repartition("query_id", "level").dropDuplicates(["query_id", "level", "id"]).withColumn("score", F.round("score", 6))
    return ranked(found.join(query_levels(queries), ["query_id", "level"]).select("query_id", "level", "weight", "id", "score"), ["query_id", "level"]).filter(F.col("rank") <= k)


def prefixes(path: str) -> list[str]:
    """The levels a path is under: its prefixes before a slash, and itself."""
    return [path[:i] for i in range(1, len(path)) if path[i] == "/"] + [path]


def path_search(queries: DataFrame, docs: DataFrame, vectors: DataFrame, dim: int, k: int, now: int, cfg: ScoringConfig = ScoringConfig(), match: str = "all") -> DataFrame:
    """(query_id, id, score, rank, source): levels, then global rows where levels leave room, scored.

    queries: query_id, query, path, vector (null: text only); docs: id, text, hierarchy_path,
    importance, ts. Global rows are those without a path; theirs are vector hits where the
    query has a vector, else text hits, at half their score.
    """
    text = materialize(search_text(docs, queries, match), "hits")  # read by the levels and by the fallback
    by = ["query_id", "level", "weight"]
    lists = [level_vector_hits(queries, docs, vectors, dim, OVERFETCH * k), level_hits(text, docs, queries, OVERFETCH * k)]
    fused = rrf(lists, by).withColumn("score", F.col("score") * F.col("weight"))
    best = cut(ranked(fused.groupBy("query_id", "id").agg(F.round(F.max("score"), 9).alias("score")), ["query_id"]).filter(F.col("rank") <= k))  # k rows a query
    found = best.groupBy("query_id").agg(F.count("*").alias("found"))

    loose = docs.filter("hierarchy_path IS NULL").select("id")
    with_vec = queries.filter("vector IS NOT NULL").select("query_id")
    gv = vector_scores(queries.filter("vector IS NOT NULL"), vectors.join(loose, "id"), dim, k)
    gt = text.join(with_vec, "query_id", "left_anti").join(loose, "id").select("query_id", "id", "score")
    glob = ranked(gv.select("query_id", "id", F.round("score", 6).alias("score")).unionByName(gt.select("query_id", "id", F.round("score", 6).alias("score"))), ["query_id"])
    room = glob.join(found, "query_id", "left").filter(F.col("rank") <= k - F.coalesce("found", F.lit(0)))
    both = best.select("query_id", "id", "score", F.lit("level").alias("source")).unionByName(room.select("query_id", "id", (F.col("score") * FALLBACK).alias("score"), F.lit("global").alias("source")))
    scored = apply_scoring(both.join(docs.select("id", "text", "importance", "ts"), "id"), now, cfg)
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.select("query_id", "id", F.round("score", 6).alias("score"), "source").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
