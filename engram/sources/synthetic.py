"""Labelled synthetic data for calibration, from a seeded generator per row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..functions import physics

# Spreads around the core, and ranges of salience and half-life.
CORE_SPREAD, SIGNAL_SPREAD, NOVEL_SPREAD = 0.03, 0.28, 0.05
NOISE_SALIENCE, NOISE_HOURS = (0.05, 0.30), (0.5, 4.0)
MEMORY_SALIENCE, MEMORY_DAYS = (0.6, 1.0), (1.0, 7.0)
REINFORCED_SHARE, REINFORCED_BY = 0.4, 0.3


def _rng(seed: int, row: int) -> np.random.Generator:
    return np.random.default_rng((seed, row))


def labelled_vectors(spark: SparkSession, redundant: int, signal: int, anomaly: int, *, dim: int, seed: int) -> DataFrame:
    """(id, kind, embedding, cosine): vectors close to a core, some way off, or in a new direction; cosine to the core."""
    core = _rng(seed, -1 & 0xFFFF).normal(size=dim)
    core /= np.sqrt(core @ core)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i in b["id"]:
                rng = _rng(seed, int(i))
                kind = "redundant" if i < redundant else "signal" if i < redundant + signal else "anomaly"
                base = core
                if kind == "anomaly":
                    base = rng.normal(size=dim)
                    base -= (base @ core) * core
                    base /= np.sqrt(base @ base)
                v = base + rng.normal(size=dim) * {"redundant": CORE_SPREAD, "signal": SIGNAL_SPREAD / np.sqrt(dim / 8), "anomaly": NOVEL_SPREAD}[kind]
                rows.append((int(i), kind, v.tolist(), float(v @ core / np.sqrt(v @ v))))
            yield pd.DataFrame(rows, columns=["id", "kind", "embedding", "cosine"])

    return spark.range(redundant + signal + anomaly).mapInPandas(run, "id long, kind string, embedding array<double>, cosine double")


def traces(spark: SparkSession, noise: int, memory: int, *, seed: int) -> DataFrame:
    """(id, is_noise, trace): short-lived noise, and memories of which some are reinforced."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i in b["id"]:
                rng = _rng(seed, int(i))
                is_noise = bool(i < noise)
                salience = rng.uniform(*(NOISE_SALIENCE if is_noise else MEMORY_SALIENCE))
                life = rng.uniform(*NOISE_HOURS) * 3600 if is_noise else rng.uniform(*MEMORY_DAYS) * physics.DAY
                touched = not is_noise and rng.random() < REINFORCED_SHARE
                lam = physics.lambda_from_halflife(life) * (1 - REINFORCED_BY if touched else 1)
                rows.append((int(i), is_noise, salience, lam, 1.0 if touched else 0.0, 0.0))
            yield pd.DataFrame(rows, columns=["id", "is_noise", "salience", "lambda", "reinforcement", "last_touch"])

    return spark.range(noise + memory).mapInPandas(run, "id long, is_noise boolean, salience double, lambda double, reinforcement double, last_touch double")
