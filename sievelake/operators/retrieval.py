"""The retrieval modes in one call, and the ingest of documents into rows of the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.functions.embed import embed_udf
from sievelake.functions.text import l0_by_rule, path_levels
from sievelake.operators import chunking, fulltext, fusion, path_search, rerank, vector_search
from sievelake.operators.summaries import l1_by_rule
from sievelake.sources.files import Settings

OVERFETCH = 2


def retrieve(queries: DataFrame, docs: DataFrame, vectors: DataFrame, settings: Settings, fusion_by: str = "boost", match: str = "all") -> DataFrame:
    """(query_id, id, score, rank) in the mode of the settings: 1 full text, 2 hybrid, 3 hybrid and reranked.

    queries: query_id, query, vector (null: text only). docs: id, text, scope; statistics are
    those of all docs, scopes filter afterwards. Queries without words and vector find nothing.
    """
    allowed = docs.filter(F.col("scope").isin(list(settings.scopes))).select("id") if settings.scopes else docs.select("id")
    k = settings.limit
    wide = rerank.CANDIDATES if settings.reranks else k
    text = fulltext.search_text(docs, queries, match).join(allowed, "id")
    if not settings.uses_vectors:
        return fulltext.top_k(text, k)
    near = vector_search.vector_topk(queries, vectors.join(allowed, "id"), settings.dim, OVERFETCH * wide)
    words = fulltext.top_k(text, OVERFETCH * wide)
    found = fusion.boost_fusion(near, words, wide) if fusion_by == "boost" else fulltext.top_k(fusion.rrf([near, words], ["query_id"]), wide)
    return rerank.rerank(found, queries, docs, k=k) if settings.reranks else found


def route(queries: DataFrame, docs: DataFrame, vectors: DataFrame, settings: Settings, now: int) -> DataFrame:
    """(query_id, id, score): path search for the queries that have a path, hybrid search for the others."""
    with_path, without = queries.filter(F.coalesce("path", F.lit("")) != ""), queries.filter(F.coalesce("path", F.lit("")) == "")
    along = path_search.path_search(with_path, docs, vectors, settings.dim, settings.limit, now)
    flat = retrieve(without, docs, vectors, settings)
    return along.select("query_id", "id", "score").unionByName(flat.select("query_id", "id", "score"))


def ingest_rows(files: DataFrame, now: int, max_tokens: int = chunking.MAX_TOKENS, min_tokens: int = chunking.MIN_TOKENS) -> DataFrame:
    """Files (source_file, text) to rows of the store with a vector of their overview: chunks, summaries, embedding, path and level.

    Ids are digests of file and chunk number, so a file that comes again gives the same ids.
    """
    chunks = chunking.smart_split(files.select(F.col("source_file").alias("doc_id"), "text", F.col("source_file").alias("base")), max_tokens, min_tokens)
    rows = chunks.select(
        F.sha2(F.concat_ws("#", "doc_id", "chunk_index"), 256).alias("id"), F.col("content").alias("text"), l0_by_rule(F.col("content")).alias("abstract"), l1_by_rule("content").alias("overview"),
        F.lit("fact").alias("category"), F.lit("global").alias("scope"), F.lit(0.7).alias("importance"), F.lit(now).cast("long").alias("timestamp"), F.col("hierarchy").alias("hierarchy_path"),
        F.size(path_levels(F.col("hierarchy"))).alias("hierarchy_level"), "node_type", F.col("doc_id").alias("source_file"), "chunk_index", "token_count",
    )
    return rows.withColumn("vector", embed_udf()("overview"))
