"""Vector expressions on ARRAY columns; arithmetic in double, all JVM-side but the byte codec."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product; 0 for null, empty or unequal lengths."""
    s = F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), s).otherwise(0.0)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda acc, x: acc + x * x))


def normalize(v: Column) -> Column:
    """Unit length; a zero vector stays as it is, null stays null."""
    n = norm(v)
    return F.when(n > 0, F.transform(doubles(v), lambda x: x / n)).otherwise(doubles(v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 for null, unequal lengths, zero norms and non-finite results."""
    n = norm(a) * norm(b)
    c = dot(a, b) / F.nullif(n, F.lit(0.0))
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)


def usable(v: Column, dim: int) -> Column:
    """Exactly ``dim`` finite numbers that are not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def dequantize(u8: Column) -> Column:
    """Unsigned bytes around 128 to a unit vector."""
    return normalize(F.transform(u8, lambda x: (x.cast("double") - 128.0) / 128.0))


@F.pandas_udf(BinaryType())
def to_bytes(v: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats."""
    return v.map(lambda x: np.asarray(x, "<f4").tobytes(), na_action="ignore")


@F.pandas_udf(ArrayType(FloatType()))
def from_bytes(b: pd.Series) -> pd.Series:
    """The inverse of to_bytes; null where the length is no multiple of four."""
    return b.map(lambda x: np.frombuffer(x, "<f4") if len(x) % 4 == 0 else None, na_action="ignore")
