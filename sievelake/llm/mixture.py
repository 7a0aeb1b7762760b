"""Mixing sources to target weights.

Tokens of a public tokenizer are counted for each document and summed by source. A source's
rate is target_share * T / tokens, capped at max_repeats, where T are the tokens of all
documents of listed sources. Each document is emitted floor(rate) times, and once more with
a probability equal to the fraction, decided by a hash of seed and document id; so the same
input always gives the same mixture and no document exceeds the cap.

Documents with a null or unlisted source are left out; null and empty texts have 0 tokens;
a listed source without documents has 0 tokens and rate 0.
"""

from __future__ import annotations

import base64
import functools

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.session import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that belongs to this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(path: str = TOKENIZER):
    """Pandas UDF: tokens of a text; the vocabulary is loaded once in each worker."""

    @F.pandas_udf("long")
    def count(text: pd.Series) -> pd.Series:
        enc = _encoding(path)
        return text.map(lambda t: len(enc.encode_ordinary(t)) if t else 0).astype("int64")

    return count


def token_table(documents: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens), each document tokenized once and written."""
    return materialize(documents.filter(F.col(source_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), token_count(path)(text_col).alias("tokens")), "tokens")


def rates(tokens: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, tokens, wanted, rate, reachable), one row for each listed source."""
    targets = targets.select("source", "target_share", "max_repeats").filter("source IS NOT NULL").dropDuplicates(["source"])
    by = targets.join(tokens.groupBy("source").agg(F.sum("tokens").alias("tokens")), "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    wanted = F.col("target_share") * by.agg(F.sum("tokens")).scalar()
    return by.select(
        "source", "target_share", "max_repeats", "tokens", wanted.alias("wanted"),
        F.when(F.col("tokens") > 0, F.least(wanted / F.nullif("tokens", F.lit(0)), F.col("max_repeats").cast("double"))).otherwise(0.0).alias("rate"),
        (F.col("max_repeats") * F.col("tokens") >= wanted).alias("reachable"),
    )


def copies(rate: Column, doc_id: Column, seed: int) -> Column:
    """floor(rate), plus one with the probability of the fraction."""
    draw = F.pmod(F.xxhash64(F.lit(seed), doc_id), F.lit(1 << 40)) / float(1 << 40)
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mixture(tokens: DataFrame, rate: DataFrame, seed: int = 17) -> DataFrame:
    """(doc_id, source, tokens, copies) of the documents that are used; copies says how often."""
    used = tokens.join(rate.select("source", "rate"), "source").withColumn("copies", copies(F.col("rate"), F.col("doc_id"), seed))
    return used.filter("copies > 0").select("doc_id", "source", "tokens", "copies")


def expand(mixed: DataFrame) -> DataFrame:
    """One row for each copy, numbered from 0."""
    return mixed.select("*", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))


def reached_shares(tokens: DataFrame, targets: DataFrame, seed: int = 17) -> DataFrame:
    """(source, target_share, rate, documents, used_tokens, actual_share) of every listed source."""
    rate = rates(tokens, targets)
    used = mixture(tokens, rate, seed).groupBy("source").agg(F.sum("copies").alias("documents"), F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"))
    out = rate.join(used, "source", "left").select("source", "target_share", "rate", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"))
    total = F.nullif(out.agg(F.sum("used_tokens")).scalar(), F.lit(0))
    return out.select(*out.columns, (F.col("used_tokens") / total).alias("actual_share"))
