"""Fusing a vector list and a full-text list: boost and reciprocal ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievelake.operators.fulltext import top_k

RRF_K, BOOST = 60, 0.15


def boost_fusion(vector: DataFrame, text: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): vector scores, 15 % more (at most 1) on a text hit; rows of the text list alone keep their score.

    Boosting keeps the sign: a negative cosine becomes more negative.
    """
    v = vector.select("query_id", "id", F.col("score").alias("v"))
    t = text.select("query_id", "id", F.col("score").alias("t"))
    fused = F.when(F.col("v").isNull(), F.col("t")).when(F.col("t").isNotNull(), F.least(F.col("v") + BOOST * F.col("v"), F.lit(1.0))).otherwise(F.col("v"))
    return top_k(v.join(t, ["query_id", "id"], "full").select("query_id", "id", fused.alias("score")), k)


def ranked(df: DataFrame, by: list[str]) -> DataFrame:
    """Adds rank from 1 by score, ties by id."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), "id")))


def rrf(lists: list[DataFrame], by: list[str], k: int = RRF_K) -> DataFrame:
    """(by..., id, score): sum of 1/(k + rank) over the lists, each with columns by..., id, rank (from 1)."""
    parts = [x.select(*by, "id", (1.0 / (k + F.col("rank"))).alias("part")) for x in lists]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.groupBy(*by, "id").agg(F.sum("part").alias("score"))
