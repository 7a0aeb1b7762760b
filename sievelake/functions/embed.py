"""A deterministic embedder by feature hashing, and the surface for others."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from sievelake.functions.words import py_words

DIM, BATCH = 64, 32
Embed = Callable[[list[str]], np.ndarray]


def hashed_vectors(texts: list[str], dim: int = DIM) -> np.ndarray:
    """Unit vectors of signed word counts; a text without words is all zero."""
    out = np.zeros((len(texts), dim))
    for i, t in enumerate(texts):
        for w in py_words(t):
            h = xxhash.xxh64_intdigest(w)
            out[i, h % dim] += 1 if h >> 63 else -1
    n = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, n, out=out, where=n > 0)


def embed_udf(load: Callable[[], Embed] = lambda: hashed_vectors):
    """A UDF text -> vector; ``load`` runs once in each worker, texts go to it in batches of BATCH."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = load()
        for s in batches:
            texts = s.fillna("").tolist()
            yield pd.Series([v.astype(np.float32) for at in range(0, len(texts), BATCH) for v in embed(texts[at : at + BATCH])], index=s.index)

    return run
