"""Vectors as arrays: norms, cosines, and an offline embedding."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(v: Column) -> Column:
    """The vector by its length, so that later cosines are products; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """In 0 to 1; 0 for zero vectors; the shorter length counts."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(a, b) / norms))).otherwise(0.0)


@lru_cache(maxsize=1 << 16)
def _token_hash(token: str) -> int:
    """FNV-1a of 32 bits over UTF-16 units, as a number without its sign."""
    h = 2166136261
    raw = token.encode("utf-16-le")
    for i in range(0, len(raw), 2):
        h = ((h ^ (raw[i] | raw[i + 1] << 8)) * 16777619) & 0xFFFFFFFF
    return abs(h - (1 << 32) if h >> 31 else h)


def hashed_vectors(texts: Iterable[str | None], dims: int = 512) -> list[list[float]]:
    """Hashed counts of each text's tokens, of length one; zeros without tokens."""
    out = []
    for text in texts:
        v = np.zeros(dims)
        for token in re.sub("[^a-z0-9+#.]+", " ", (text or "").lower()).split():
            if len(token) > 1:
                v[_token_hash(token) % dims] += 1
        norm = np.linalg.norm(v)
        out.append((v / norm if norm else v).tolist())
    return out


def hashed_embedding(dims: int = 512):
    """A pandas UDF ``text -> array<double>`` of :func:`hashed_vectors`."""

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(hashed_vectors(texts, dims))

    return embed
