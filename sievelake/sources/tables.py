"""Reading the store's tables and their common clean-ups."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Times above this are milliseconds, the others seconds (1e11 s lies in the year 5138).
MS_FROM = 100_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_if_there(spark: SparkSession, path: str, schema) -> DataFrame | None:
    """The parquet table at a path; None where there is no such path. Other errors are raised."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def seconds(ts: Column) -> Column:
    """Whole Unix seconds of a time written in seconds or milliseconds; 0 and null are unknown (null)."""
    s = F.when(F.abs(ts) >= MS_FROM, F.floor(ts / 1000)).otherwise(ts).cast("bigint")
    return F.when(ts != 0, s)


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def memories(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Memories with each id once and ``ts`` in seconds; only the named columns are read.

    Repeated rows of an id differ at most in how the time is written, so any of them
    serves: the smallest value of each column is kept.
    """
    df = table(spark, sf_dir, "memories").withColumn("ts", seconds(F.col("timestamp")))
    keep = [c for c in columns if c != "id"]
    return df.select("id", *keep).groupBy("id").agg(*[F.min(c).alias(c) for c in keep]) if keep else df.select("id").distinct()
