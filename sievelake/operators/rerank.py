"""Reranking: a bounded candidate list, a pluggable scorer, and the blend of both scores."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievelake.functions.words import words

CANDIDATES, DOC_BYTES, WEIGHT = 50, 2000, 0.6


def blend(score: Column, rerank: Column, has_text: Column) -> Column:
    """0.6*rerank + 0.4*score, at least half the score; rows the reranker left out lose a fifth, rows without text keep theirs."""
    both = F.greatest(WEIGHT * rerank + (1 - WEIGHT) * score, 0.5 * score)
    return F.when(~has_text, score).when(rerank.isNull(), score * 0.8).otherwise(both)


def cosine_fallback(score: Column, cosine: Column) -> Column:
    return 0.7 * score + 0.3 * cosine


def cut_bytes(text: Column, n: int = DOC_BYTES) -> Column:
    """The first n bytes without the piece of a character that the cut may leave."""
    cut = F.substring(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 1, n)
    return F.regexp_replace(F.try_validate_utf8(F.make_valid_utf8(cut.cast("string"))), "�+$", "")


def overlap_score(query: Column, doc: Column) -> Column:
    """The default scorer: the share of the query's words that the document holds."""
    q = F.array_distinct(words(query))
    return F.size(F.array_intersect(q, words(doc))) / F.nullif(F.size(q).cast("double"), F.lit(0.0))


def rerank(results: DataFrame, queries: DataFrame, docs: DataFrame, scorer: Callable[[Column, Column], Column] | None = None, enabled: bool = True, k: int = 10) -> DataFrame:
    """(query_id, id, score, rank): the first CANDIDATES of each query, blended and ranked again; what is beyond them goes.

    ``scorer`` builds a column from the query's and the document's text; None takes overlap_score. Disabled, the list is only cut.
    """
    by = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    if not enabled:
        return results.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "id", "score", "rank")
    cand = results.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= CANDIDATES)
    doc = cut_bytes(F.col("text"))
    rated = cand.join(docs.select("id", "text"), "id").join(queries.select("query_id", "query"), "query_id")
    score = (scorer or overlap_score)(F.col("query"), doc)
    out = rated.select("query_id", "id", F.round(blend(F.col("score"), score, F.length(F.trim(doc)) > 0), 6).alias("score"))
    return out.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def rerank_remote(results: DataFrame, client: Callable[[str, list[str]], list[tuple[int, float]]]) -> DataFrame:
    """(query_id, id, rerank) from a client that maps (query, documents) to (index, relevance); results has query_id, id, query, doc, at most CANDIDATES rows for each query.

    If the client fails, its query gets no rerank scores.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        try:
            got = dict(client(pdf["query"][0], pdf["doc"].tolist()))
        except Exception:
            got = {}
        return pd.DataFrame({"query_id": pdf["query_id"], "id": pdf["id"], "rerank": [got.get(i) for i in range(len(pdf))]})

    return results.groupBy("query_id").applyInPandas(run, f"query_id {results.schema['query_id'].dataType.simpleString()}, id string, rerank double")
