"""Plug-ins for models: text encoders and pair scorers, applied to columns in Arrow batches.

An encoder turns a list of texts into unit vectors, a scorer a list of (query, passage) pairs into numbers. Both are made
on the executor by a factory, once per Python worker. `hashed_encoder` needs no model files: its vectors prove plumbing,
not relevance.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[list[str]], list[list[float]]]
Scorer = Callable[[list[tuple[str, str]]], list[float]]
_made: dict = {}


def _once(factory: Callable):
    if factory not in _made:
        _made[factory] = factory()
    return _made[factory]


def encode(text: Column, factory: Callable[[], Encoder], batch: int = 64) -> Column:
    """Unit vectors of a text column; null texts count as empty."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        model, texts, out = _once(factory), s.fillna("").tolist(), []
        for k in range(0, len(texts), batch):
            out += model(texts[k : k + batch])
        return pd.Series(out)

    return run(text)


def score_pairs(query: Column, passage: Column, factory: Callable[[], Scorer], batch: int = 32) -> Column:
    """Scores of pairs; give it a bounded head, as models of this kind are slow."""

    @F.pandas_udf("double")
    def run(q: pd.Series, p: pd.Series) -> pd.Series:
        model, pairs, out = _once(factory), list(zip(q.fillna(""), p.fillna(""), strict=True)), []
        for k in range(0, len(pairs), batch):
            out += model(pairs[k : k + batch])
        return pd.Series(out, dtype="float64")

    return run(query, passage)


def hashed_encoder(size: int = 64) -> Callable[[], Encoder]:
    """Signed counts of hashed words at length 1; the same on every machine."""

    def factory() -> Encoder:
        def run(texts: list[str]) -> list[list[float]]:
            out = []
            for t in texts:
                v = [0.0] * size
                for w in t.lower().split():
                    h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                    v[h % size] += 1.0 if h >> 63 else -1.0
                n = math.sqrt(sum(x * x for x in v))
                out.append([x / n for x in v] if n else v)
            return out

        return run

    return factory


def keyword_vectors(keywords: DataFrame, factory: Callable[[], Encoder]) -> DataFrame:
    """(name, vector) of every distinct keyword, folded to lower case."""
    names = keywords.select(F.lower(F.trim("name")).alias("name")).where("name IS NOT NULL").distinct()
    return names.select("name", encode(F.col("name"), factory).alias("vector"))

