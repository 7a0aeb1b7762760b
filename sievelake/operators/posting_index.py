"""A stored full-text index: postings in term buckets, so that a search reads only the buckets of its words.

Layout under one folder: ``postings`` (id, term, tf, dl), partitioned by bucket and sorted by
term within a file, so that a search skips row groups, too; ``docs`` (id, dl); ``gone`` (id) for
removals, applied when reading until ``compact`` rewrites the index. The number of buckets is
fixed when a folder is first written and grows with the size of that first batch (about
BUCKET_BYTES of text for each); ``compact`` chooses it anew. Appending a batch adds files; an
id has to be removed before it is added again (``put`` does both). Statistics are those of the
documents that are still there. A reader may be bound to
a list of batches; what a writer that failed has left behind is then never read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.functions.words import words
from sievelake.operators.fulltext import query_terms, scored
from sievelake.sources.tables import read_if_there

BUCKETS, MOST_BUCKETS, BUCKET_BYTES, SLICES = 64, 16_384, 64 << 20, 4
POSTING, DOC, GONE = "id STRING, term STRING, tf LONG, dl INT, batch LONG, bucket INT", "id STRING, dl INT, batch LONG", "id STRING, batch LONG"


class PostingIndex:
    def __init__(self, spark: SparkSession, path: str, batches: list[int] | None = None):
        self.spark, self.path, self.batches = spark, path, batches

    def _read(self, name: str, schema: str) -> DataFrame:
        """The table; empty where nothing was written yet."""
        df = read_if_there(self.spark, f"{self.path}/{name}", schema)
        if df is None:
            return self.spark.createDataFrame([], schema)
        return df if self.batches is None else df.filter(F.col("batch").isin(self.batches))

    def _buckets(self, docs: DataFrame | None = None) -> int:
        """Number of buckets of this folder; fixed with the first batch."""
        layout = read_if_there(self.spark, f"{self.path}/layout", "buckets INT")
        if layout is not None:
            return layout.first()["buckets"]
        size = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) if docs is not None else 0
        n = min(MOST_BUCKETS, max(BUCKETS, 1 << math.ceil(math.log2(max(1, size / BUCKET_BYTES)))))
        if docs is not None:
            self.spark.createDataFrame([(n,)], "buckets INT").coalesce(1).write.parquet(f"{self.path}/layout")
        return n

    def add(self, docs: DataFrame, batch: int) -> None:
        """Append documents (id, text) as a numbered batch; batches have to be numbered upwards."""
        w = docs.select("id", words(F.col("text")).alias("w")).filter(F.col("id").isNotNull() & (F.size("w") > 0))
        tf = w.select("id", F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))
        buckets = self._buckets(docs)
        rows = tf.select("id", "term", "tf", "dl", F.lit(batch).cast("long").alias("batch"), _bucket(F.col("term"), buckets).alias("bucket"))
        # one writer for each bucket and slice of ids: files stay few, and a frequent word does not meet one task
        rows.repartition(F.col("bucket"), F.pmod(F.xxhash64("id"), F.lit(SLICES))).sortWithinPartitions("bucket", "term").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/postings")
        w.select("id", F.size("w").alias("dl"), F.lit(batch).cast("long").alias("batch")).write.mode("append").parquet(f"{self.path}/docs")

    def remove(self, ids: DataFrame, batch: int) -> None:
        """Ids of batches before ``batch`` count as removed."""
        ids.select("id", F.lit(batch).cast("long").alias("batch")).distinct().write.mode("append").parquet(f"{self.path}/gone")

    def put(self, docs: DataFrame, batch: int) -> None:
        """Replace or add documents."""
        self.remove(docs.select("id"), batch)
        self.add(docs, batch)

    def _alive(self, df: DataFrame) -> DataFrame:
        gone = self._read("gone", GONE).groupBy("id").agg(F.max("batch").alias("until"))
        return df.join(gone, "id", "left").filter(F.col("until").isNull() | (F.col("batch") >= F.col("until"))).drop("until")

    def docs(self) -> DataFrame:
        return self._alive(self._read("docs", DOC))

    def postings(self) -> DataFrame:
        return self._alive(self._read("postings", POSTING))

    def compact(self, target: str) -> "PostingIndex":
        """The index without what was removed, in another folder, with as many buckets as its size asks for."""
        p = self.postings()
        size = p.agg(F.sum(F.octet_length("term") * F.col("tf"))).first()[0] or 0
        n = min(MOST_BUCKETS, max(BUCKETS, 1 << math.ceil(math.log2(max(1, size / BUCKET_BYTES)))))
        self.spark.createDataFrame([(n,)], "buckets INT").coalesce(1).write.parquet(f"{target}/layout")
        p = p.withColumn("bucket", _bucket(F.col("term"), n))
        p.repartition(F.col("bucket"), F.pmod(F.xxhash64("id"), F.lit(SLICES))).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{target}/postings")
        self.docs().write.parquet(f"{target}/docs")
        return PostingIndex(self.spark, target, self.batches)

    def search(self, queries: DataFrame, match: str = "all") -> DataFrame:
        """(query_id, id, score) as fulltext.bm25 gives it; only the buckets of the queries' words are read."""
        qt = query_terms(queries).withColumn("bucket", _bucket(F.col("term"), self._buckets()))
        asked = [r["bucket"] for r in qt.select("bucket").distinct().collect()]  # at most MOST_BUCKETS numbers
        tf = self._alive(self._read("postings", POSTING).filter(F.col("bucket").isin(asked)).join(qt.select("term").distinct(), "term", "left_semi"))
        size = self.docs().agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
        return scored(tf, qt, size, match)


def _bucket(term, buckets: int):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")
