"""Recency, importance and length factors of a score, and the pipeline of all three."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ScoringConfig:
    """recency_days is a time constant; a value <= 0 switches its factor off. The anchor counts bytes."""

    recency_days: float = 14.0
    recency_weight: float = 0.1
    length_anchor: int = 200
    least_score: float = 0.01


def recency_boost(ts: Column, now: int, cfg: ScoringConfig = ScoringConfig()) -> Column:
    """weight * exp(-age/days); an unknown time counts as now."""
    age = (F.lit(now) - F.coalesce(ts, F.lit(now))) / 86400.0
    return F.exp(-age / cfg.recency_days) * cfg.recency_weight


def importance_weight(importance: Column) -> Column:
    """0.7 + 0.3 * importance; null or not positive counts as 0.7."""
    return 0.7 + 0.3 * F.when(importance > 0, importance).otherwise(0.7)


def length_factor(text: Column, anchor: int) -> Column:
    """1 up to the anchor, then 1/(1 + log2(bytes/anchor))."""
    ratio = F.octet_length(F.coalesce(text, F.lit(""))) / float(anchor)
    return F.when(ratio > 1, 1 / (1 + F.log2(ratio))).otherwise(1.0)


def scored(score: Column, ts: Column, importance: Column, text: Column, now: int, cfg: ScoringConfig = ScoringConfig()) -> Column:
    """The score after recency (capped at 1), importance and length."""
    s = F.least(score + recency_boost(ts, now, cfg), F.lit(1.0)) if cfg.recency_days > 0 and cfg.recency_weight > 0 else score
    s = s * importance_weight(importance)
    return s * length_factor(text, cfg.length_anchor) if cfg.length_anchor > 0 else s


def apply_scoring(df: DataFrame, now: int, cfg: ScoringConfig = ScoringConfig()) -> DataFrame:
    """Rescore a result with columns score, ts, importance, text; rows under the least score go."""
    out = df.withColumn("score", scored(F.col("score"), F.col("ts"), F.col("importance"), F.col("text"), now, cfg))
    return out.filter(F.col("score") >= cfg.least_score)
