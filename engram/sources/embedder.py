"""Embedding providers and their use on columns: distinct texts are embedded once and joined back."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fnv1a


class Embedder(Protocol):
    """Anything with a dimension that turns texts into vectors."""

    dim: int

    def embed(self, text: str) -> list[float]: ...


def summarize(texts: list[str]) -> str:
    """The default summary: the texts side by side."""
    return " · ".join(texts)


class HashingEmbedder:
    """Deterministic vectors without a model: each lower-cased word adds a signed unit at its hash's place."""

    def __init__(self, dim: int = 384):
        self.dim = dim

    def embed(self, text: str) -> list[float]:
        v = np.zeros(self.dim)
        for word in text.lower().split():
            h = fnv1a(word)
            v[h % self.dim] += -1.0 if h >> 63 else 1.0
        size = np.sqrt(v @ v)
        return (v / size if size else v).tolist()


class CachingEmbedder:
    """Keeps every text's vector; ``clear`` forgets them but not the counts."""

    def __init__(self, inner: Embedder):
        self.inner, self.dim = inner, inner.dim
        self.kept: dict[str, list[float]] = {}
        self.hits = self.misses = 0

    def embed(self, text: str) -> list[float]:
        if text in self.kept:
            self.hits += 1
        else:
            self.misses += 1
            self.kept[text] = self.inner.embed(text)
        return self.kept[text]

    def clear(self) -> None:
        self.kept.clear()

    def stats(self) -> dict[str, float]:
        asked = self.hits + self.misses
        return {"hits": self.hits, "misses": self.misses, "entries": len(self.kept), "hit_rate": self.hits / asked if asked else 1.0}


def embed(rows: DataFrame, text: str, embedder: Embedder, name: str = "embedding") -> DataFrame:
    """``rows`` with a vector for each text. A null text gets a null vector."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(embedder.embed)

    once = rows.where(F.col(text).isNotNull()).select(F.col(text).alias("_text")).distinct().withColumn(name, run("_text"))
    return rows.join(once, F.col(text) == F.col("_text"), "left").drop("_text")
