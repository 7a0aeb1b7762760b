"""Capturing chat messages: filter, fingerprint, deduplicate, map to rows, count in windows.

Every step is a function of a DataFrame and works on a stream and on a table alike; the
batch twins are what the queries compare with. Streams carry ``ts`` TIMESTAMP.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievelake.session import shared_dir

LEAST_LENGTH, HEAD, QUIET, DEDUP_HOURS = 10, 100, "2 seconds", 1


def messages(captures: DataFrame) -> DataFrame:
    """Captured rows with a text of at least LEAST_LENGTH characters after trimming, and their time as a timestamp."""
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    return captures.withColumn("text", text).filter(F.length("text") >= LEAST_LENGTH).withColumn("ts", F.timestamp_millis("timestamp"))


def fingerprinted(m: DataFrame) -> DataFrame:
    """Adds print: platform, role, the text's first HEAD characters and the URL."""
    return m.withColumn("print", F.xxhash64(F.concat_ws(":", "platform", "role", F.substring("text", 1, HEAD), F.coalesce("url", F.lit("")))))


def deduplicated(m: DataFrame) -> DataFrame:
    """Batch: the first message of each fingerprint in time (unknown times last); ties by message_id. Combined before the shuffle, so a message that is repeated very often does no harm."""
    order = F.struct(F.col("timestamp").isNull(), "timestamp", "message_id")
    return m.groupBy("print").agg(F.min_by(F.struct(*[c for c in m.columns if c != "print"]), order).alias("m")).select("m.*", "print")


def deduplicated_stream(m: DataFrame, hours: int = DEDUP_HOURS) -> DataFrame:
    """Stream: a fingerprint is let through once while the watermark of ``hours`` remembers it."""
    return m.withWatermark("ts", f"{hours} hours").dropDuplicatesWithinWatermark(["print"])


def memory_rows(m: DataFrame) -> DataFrame:
    """Captured messages as rows of the store."""
    meta = F.to_json(F.struct(F.lit("browser-plugin").alias("source"), "url", "role", "platform", F.col("message_id").alias("messageId")))
    return m.select(
        F.col("message_id").alias("id"), "text", F.lit("conversation").alias("category"), F.concat(F.lit("browser:"), "platform").alias("scope"),
        F.lit(0.5).alias("importance"), F.floor(F.col("timestamp") / 1000).alias("timestamp"), meta.alias("metadata"),
    )


def sessions(m: DataFrame, quiet: str = QUIET) -> DataFrame:
    """(platform, url, started, ended, messages): bursts on a page without a pause of ``quiet``; pages are many, so no task meets a whole platform."""
    page = m.withColumn("url", F.coalesce("url", F.lit("")))
    return page.groupBy("platform", "url", F.session_window("ts", quiet).alias("w")).agg(F.count("*").alias("messages")).select("platform", "url", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "messages")


def rates(m: DataFrame, length: str, slide: str | None = None) -> DataFrame:
    """(platform, from, messages) in tumbling or sliding windows; what a rate limit compares with."""
    return m.groupBy("platform", F.window("ts", length, slide or length).alias("w")).agg(F.count("*").alias("messages")).select("platform", F.col("w.start").alias("from"), "messages")


def bounded_queue(m: DataFrame, cap: int = 500) -> DataFrame:
    """The last ``cap`` messages of each platform, the oldest dropped: what an offline queue still holds."""
    n = F.row_number().over(W.partitionBy("platform").orderBy(F.desc("timestamp"), "message_id"))
    return m.withColumn("n", n).filter(F.col("n") <= cap).drop("n")


def run_once(stream: DataFrame, path: str | None = None, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now, into parquet in the shared folder, and read the result.

    The checkpoint beside the result makes a restarted run go on where it ended.
    """
    base = path or f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/out")


def ingest(stream: DataFrame, write_batch, checkpoint: str):
    """Micro-batches of memory rows to a writer (rows, batch id); the writer has to skip a batch it has seen."""
    return stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
