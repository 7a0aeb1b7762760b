"""Filters and heuristics on rows before they are stored or searched."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of replies that deny knowledge, of questions about the store itself, and of small talk.
DENIALS = (r"i don'?t have (any )?(access|information|data|memory|record)", r"i'?m not sure about", r"i don'?t recall", r"i (can't|cannot|am unable to)", "抱歉.*无法", "对不起.*不能")
META_QUESTIONS = (r"\bdo you (remember|recall|know about)\b", r"\bcan you (remember|recall)\b", r"^(what|how|why|when|where|who) (is|are|do|does)", "^(什么|怎么|为什么|何时|哪里|谁)")
SMALL_TALK = (r"^(hi|hello|hey|thanks|thank you|ok|okay|heartbeat)[.! ]*$",)
# Cues of the categories, in order of precedence.
CATEGORY_CUES = (("preference", r"\b(prefer|like|favou?rite|want)s?\b|更喜欢|偏好"), ("decision", r"\b(decided|decide|chose|agreed)\b|决定"), ("fact", r"\b(is|are|was|measured)\b|是|显示"))
CATEGORY_ELSE = "other"
# Second-level suffixes under which names are registered.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.cn", "com.br")


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    return F.coalesce(F.lower(text).rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def noise_kind(text: Column) -> Column:
    """'denial', 'meta', 'small_talk' or null."""
    return F.when(_any(text, DENIALS), "denial").when(_any(text, META_QUESTIONS), "meta").when(_any(F.trim(text), SMALL_TALK), "small_talk")


def reweighed(importance: Column, text: Column) -> Column:
    """Half the importance for questions about the store."""
    return F.when(_any(text, META_QUESTIONS), importance * 0.5).otherwise(importance)


def retrieval_decision(query: Column) -> Column:
    """'force' for questions about memory, 'skip' for small talk and very short queries (two ideographs count as enough), else 'search'."""
    q = F.trim(F.coalesce(query, F.lit("")))
    ideo = F.regexp_count(q, F.lit(r"[\x{4E00}-\x{9FFF}]"))
    return F.when(_any(q, META_QUESTIONS), "force").when(_any(q, SMALL_TALK) | ((F.length(q) < 4) & (ideo < 2)), "skip").otherwise("search")


def category(text: Column) -> Column:
    out = F.lit(CATEGORY_ELSE)
    for name, cue in reversed(CATEGORY_CUES):
        out = F.when(F.lower(text).rlike(cue), name).otherwise(out)
    return out


def importance_heuristic(text: Column, role: Column) -> Column:
    """0.5, +0.2 for a code block of 50 characters or more, +0.1 over 500 characters, +0.1 for the assistant; at most 1."""
    code = F.length(F.regexp_extract(text, r"(?s)```(.*?)```", 1)) >= 50
    s = F.lit(0.5) + F.when(code, 0.2).otherwise(0.0) + F.when(F.length(text) > 500, 0.1).otherwise(0.0) + F.when(role == "assistant", 0.1).otherwise(0.0)
    return F.least(s, F.lit(1.0))


def site_scope(url: Column) -> Column:
    """The registrable domain of a URL; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    parts = F.split(host, r"\.")
    n = F.when(F.substring_index(host, ".", -2).isin(*SUFFIXES), 3).otherwise(2)
    return F.when(host != "", F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), n), "."))


def accessible(memories: DataFrame, agent: str) -> DataFrame:
    """Rows an agent may see: global ones and its own."""
    return memories.filter(F.col("scope").isin("global", f"agent:{agent}"))


def mmr(candidates: DataFrame, k: int = 10, trade: float = 0.7) -> DataFrame:
    """(query_id, id, rank): maximal marginal relevance over at most 50 candidates (query_id, id, score, vector) of each query."""
    import numpy as np

    kind = candidates.schema["query_id"].dataType.simpleString()

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True]).head(50).reset_index(drop=True)
        x = np.array(pdf["vector"].tolist(), float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        sim, score, left, took = x @ x.T, pdf["score"].to_numpy(), list(range(len(pdf))), []
        while left and len(took) < k:
            gain = [trade * score[i] - (1 - trade) * (max(sim[i, j] for j in took) if took else 0.0) for i in left]
            took.append(left.pop(int(np.argmax(np.round(gain, 9)))))
        return pd.DataFrame({"query_id": key[0], "id": pdf["id"].iloc[took].to_numpy(), "rank": range(1, len(took) + 1)})

    return candidates.select("query_id", "id", "score", "vector").groupBy("query_id").applyInPandas(run, f"query_id {kind}, id string, rank int")


def consolidation(memories: DataFrame, least: int = 5) -> DataFrame:
    """(scope, day, rows, importance): days on which a scope gathered at least ``least`` rows and is due for consolidation."""
    day = F.floor(F.col("ts") / 86400)
    return memories.filter("ts IS NOT NULL").groupBy("scope", day.alias("day")).agg(F.count("*").alias("rows"), F.sum(F.when(F.col("importance") > 0, F.col("importance")).otherwise(0.7)).alias("importance")).filter(F.col("rows") >= least)
