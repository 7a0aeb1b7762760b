"""Summaries by rule, with a cache by content hash; a model client can be plugged in."""

from __future__ import annotations

import re
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sievelake.functions.text import l0_by_rule

# An overview ends after five sentences or 500 bytes.
MAX_SENTENCES, MAX_BYTES = 5, 500
_END = re.compile(r"[。！？]|[.!?](?=\s)")


def overview(text: str | None) -> str:
    """Up to five sentence ends or until 500 bytes are reached, trimmed."""
    if not text:
        return ""
    ends = [m.end() for _, m in zip(range(MAX_SENTENCES), _END.finditer(text))]
    stop = ends[-1] if len(ends) == MAX_SENTENCES else len(text)
    head, size = text[:stop], 0
    for i, c in enumerate(head[:MAX_BYTES]):  # a character has at least one byte
        size += len(c.encode())
        if size >= MAX_BYTES:
            head = head[: i + 1]
            break
    return head.strip() or text[:MAX_BYTES]


@F.pandas_udf(StringType())
def l1_by_rule(text: pd.Series) -> pd.Series:
    return text.map(overview)


def content_key(text, level: int):
    return F.concat(F.sha2(F.coalesce(text, F.lit("")), 256), F.lit(f":{level}"))


def summarized(docs: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """(id, abstract, overview) of docs (id, text): cached values (key, summary) first, rules for the rest; equal texts are summarized once."""
    distinct = docs.select(F.coalesce("text", F.lit("")).alias("text")).distinct()
    out = distinct.select("text", content_key(F.col("text"), 0).alias("k0"), content_key(F.col("text"), 1).alias("k1"), l0_by_rule(F.col("text")).alias("r0"), l1_by_rule("text").alias("r1"))
    if cache is not None:
        c = cache.select("key", "summary").dropDuplicates(["key"])
        for n in ("0", "1"):
            out = out.join(c.select(F.col("key").alias(f"k{n}"), F.col("summary").alias(f"c{n}")), f"k{n}", "left").withColumn(f"r{n}", F.coalesce(f"c{n}", f"r{n}"))
    return docs.select("id", F.coalesce("text", F.lit("")).alias("text")).join(out.select("text", F.col("r0").alias("abstract"), F.col("r1").alias("overview")), "text").select("id", "abstract", "overview")


def summarize_with(docs: DataFrame, client: Callable[[str], str], retries: int = 2, pause: float = 1.0) -> DataFrame:
    """(text, summary) from a client, with retries and growing pauses; where it fails for good, by rule. Called once for each distinct text."""

    def run(batches):
        for pdf in batches:
            out = []
            for t in pdf["text"]:
                got = None
                for attempt in range(retries + 1):
                    try:
                        got = client(t[:4000])
                        break
                    except Exception:
                        if attempt < retries:
                            time.sleep(pause * 2**attempt)
                out.append(got if got else overview(t))
            yield pd.DataFrame({"text": pdf["text"], "summary": out})

    return docs.select(F.coalesce("text", F.lit("")).alias("text")).distinct().mapInPandas(run, "text string, summary string")
