"""Judging search results against expected terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def judged(results: DataFrame, docs: DataFrame, cases: DataFrame) -> DataFrame:
    """results (query_id, id, rank) with relevant: any expected term occurs in the text, whatever its case."""
    text = F.lower("text")
    hit = F.exists("expected_terms", lambda t: F.contains(text, F.lower(t)))
    return results.join(docs.select("id", "text"), "id").join(cases.select("query_id", "expected_terms"), "query_id").withColumn("relevant", F.coalesce(hit, F.lit(False)))


def precision(results: DataFrame, docs: DataFrame, cases: DataFrame) -> DataFrame:
    """(query_id, results, relevant, precision, passed), one row for each case; precision is over the case's k."""
    j = judged(results, docs, cases).join(cases.select("query_id", "k"), "query_id")
    by = j.groupBy("query_id").agg(F.count("*").alias("results"), F.sum(F.when(F.col("relevant") & (F.col("rank") <= F.col("k")), 1).otherwise(0)).alias("relevant"))
    c = cases.join(by, "query_id", "left").select("query_id", "name", "k", "min_results", "topk_relevant", F.coalesce("results", F.lit(0)).alias("results"), F.coalesce("relevant", F.lit(0)).alias("relevant"))
    return c.select(
        "query_id", "name", "results", "relevant", F.when(F.col("k") > 0, F.round(F.col("relevant") / F.col("k"), 6)).otherwise(0.0).alias("precision"),
        ((F.col("relevant") >= F.col("topk_relevant")) & (F.col("results") >= F.col("min_results"))).alias("passed"),
    )


def suites(per_case: DataFrame) -> DataFrame:
    """(suite, cases, passed, pass_rate, precision) by the first word of the case's name."""
    s = per_case.withColumn("suite", F.substring_index("name", "_", 1))
    return s.groupBy("suite").agg(
        F.count("*").alias("cases"), F.sum(F.col("passed").cast("int")).alias("passed"),
        F.round(F.avg(F.col("passed").cast("int")), 6).alias("pass_rate"), F.round(F.avg("precision"), 6).alias("precision"),
    )


def scenario(results: DataFrame, docs: DataFrame, cases: DataFrame) -> DataFrame:
    """(query_id, results, in_path, full_match, partial_match, best, total): where results lie and how many expected terms they hold; total / results is the mean score."""
    text = F.lower("text")
    got = F.size(F.filter("expected_terms", lambda t: F.contains(text, F.lower(t))))
    r = results.join(docs.select("id", "text", "hierarchy_path"), "id").join(cases.select("query_id", "path", "expected_terms"), "query_id")
    under = F.coalesce((F.col("hierarchy_path") == F.col("path")) | F.startswith("hierarchy_path", F.concat("path", F.lit("/"))), F.lit(False))
    return r.groupBy("query_id").agg(
        F.count("*").alias("results"), F.sum(F.when(under, 1).otherwise(0)).alias("in_path"),
        F.sum(F.when(got == F.size("expected_terms"), 1).otherwise(0)).alias("full_match"),
        F.sum(F.when((got > 0) & (got < F.size("expected_terms")), 1).otherwise(0)).alias("partial_match"),
        F.round(F.max("score"), 6).alias("best"), F.round(F.sum("score"), 6).alias("total"),
    )
