"""Threshold calibration: confusion metrics, sweeps over grids, and the Pareto front."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import physics

# The grids of the report, its horizon, and the gain below which the default stays.
REDUNDANCY_GRID = (0.80, 0.84, 0.88, 0.90, 0.92, 0.94, 0.96)
ANOMALY_GRID = (0.10, 0.20, 0.30, 0.40, 0.50, 0.60)
FADE_GRID = (0.01, 0.02, 0.05, 0.10, 0.15, 0.20, 0.30)
HORIZON = 3 * physics.DAY
MIN_GAIN = 0.01


def confusion(rows: DataFrame, keys: Sequence[str], predicted: Column, actual: Column, times: Column | None = None) -> DataFrame:
    """tp, fp, fn, tn per key; a row counts ``times``, once by default."""
    one = F.lit(1) if times is None else times
    n = lambda c: F.coalesce(F.sum(F.when(c, one).otherwise(0)), F.lit(0)).cast("long")
    return rows.groupBy(*keys).agg(n(predicted & actual).alias("tp"), n(predicted & ~actual).alias("fp"), n(~predicted & actual).alias("fn"), n(~predicted & ~actual).alias("tn"))


def _reached(value: Column, grid: Sequence[float]) -> Column:
    """How many thresholds of a grid a value reaches; null for null."""
    return reduce(lambda a, b: a + b, [(value >= t).cast("int") for t in grid], F.lit(0))


def _thresholds(counts: DataFrame, name: str, grid: Sequence[float]) -> DataFrame:
    """Counted positions, a handful of rows, under each threshold of a grid with its place."""
    each = F.array(*(F.struct(F.lit(k).alias("place"), F.lit(t).alias("theta")) for k, t in enumerate(grid)))
    return counts.withColumn("_t", F.explode(each)).select("*", F.col("_t.place").alias(f"_{name}"), F.col("_t.theta").alias(name)).drop("_t")


def ratio(hit: Column, all_: Column) -> Column:
    """A share; of nothing it is 1."""
    return F.when(all_ == 0, F.lit(1.0)).otherwise(hit / all_)


def metrics(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1; F1 is 0 where both are."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    rows = counts.withColumns({"precision": p, "recall": r})
    both = F.col("precision") + F.col("recall")
    return rows.withColumn("f1", F.when(both == 0, F.lit(0.0)).otherwise(2.0 * F.col("precision") * F.col("recall") / both))


def sweep(rows: DataFrame, thetas: Sequence[float], score: str = "score", actual: str = "actual") -> DataFrame:
    """Metrics of ``score >= theta`` for each threshold of the grid.

    A row counts once, at the number of thresholds that it reaches; sums over these positions give every threshold's counts.
    Rows without a score or a truth don't count.
    """
    grid = sorted(set(thetas))
    counts = rows.groupBy(_reached(F.col(score), grid).alias("_at"), F.col(actual).alias("_actual")).agg(F.count("*").alias("_n"))
    each = _thresholds(counts.where("_at is not null and _actual is not null"), "theta", grid)
    return metrics(confusion(each, ["theta"], F.col("_at") > F.col("_theta"), F.col("_actual"), F.col("_n")))


def sweep_semantic(rows: DataFrame, redundancy: Sequence[float] = REDUNDANCY_GRID, anomaly: Sequence[float] = ANOMALY_GRID) -> DataFrame:
    """Rows (cosine, kind in redundant / anomaly / signal) under every pair of thresholds.

    The objective is the smaller F1 of the two, times the share of signal that isn't taken for redundant.
    A row counts once, at its place among both grids. Rows without a cosine don't count.
    """
    high, low = sorted(set(redundancy)), sorted(set(anomaly))
    below = reduce(lambda a, b: a + b, [(F.col("cosine") <= t).cast("int") for t in low], F.lit(0))  # thresholds at or above the cosine
    counts = rows.groupBy(_reached(F.col("cosine"), high).alias("_high"), below.alias("_low"), "kind").agg(F.count("*").alias("_n")).where("_high is not null")
    grid = _thresholds(_thresholds(counts, "theta_redundancy", high), "theta_anomaly", low)
    red = F.col("_high") > F.col("_theta_redundancy")
    odd = ~red & (F.col("_theta_anomaly") >= len(low) - F.col("_low"))
    keys, n = ["theta_redundancy", "theta_anomaly"], F.col("_n")
    of = lambda flag, kind, name: metrics(confusion(grid, keys, flag, F.col("kind") == kind, n)).select(*keys, F.col("f1").alias(f"f1_{name}"), F.col("recall").alias(f"recall_{name}"))
    is_signal = F.when(F.col("kind") == "signal", n).otherwise(0)
    lost = grid.groupBy(*keys).agg(ratio(F.sum(F.when(red, is_signal).otherwise(0)), F.sum(is_signal)).alias("_lost"), F.sum(is_signal).alias("_signal"))
    all_ = of(red, "redundant", "redundancy").join(of(odd, "anomaly", "anomaly"), keys).join(lost, keys)
    faded = F.when(F.col("_signal") == 0, F.lit(0.0)).otherwise(F.col("_lost"))
    return all_.withColumn("signal_faded", faded).withColumn("objective", F.least("f1_redundancy", "f1_anomaly") * (1.0 - F.col("signal_faded"))).drop("_lost", "_signal")


def sweep_fade(traces: DataFrame, thetas: Sequence[float] = FADE_GRID, horizon: float = HORIZON) -> DataFrame:
    """Traces (salience, lambda, reinforcement, last_touch, is_noise) after ``horizon``: F1 of fading noise, and memory lost.

    A trace counts once, at the number of thresholds that its weight reaches.
    """
    grid = sorted(set(thetas))
    w = physics.weight(horizon, F.col("salience"), F.col("lambda"), F.col("last_touch"), F.col("reinforcement"))
    counts = traces.groupBy(_reached(w, grid).alias("_at"), F.col("is_noise").alias("_noise")).agg(F.count("*").alias("_n"))
    each = _thresholds(counts.where("_at is not null and _noise is not null"), "theta", grid)
    scored = metrics(confusion(each, ["theta"], F.col("_at") <= F.col("_theta"), F.col("_noise"), F.col("_n")))
    kept = F.col("fp") + F.col("tn")
    return scored.withColumn("memory_loss", F.when(kept == 0, F.lit(0.0)).otherwise(F.col("fp") / kept)).withColumn("objective", F.col("f1") * (1.0 - F.col("memory_loss")))


RANGES = 64


def pareto_front(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Rows that no other row beats in one of ``x`` and ``y`` without losing in the other.

    A row is dominated if the best ``y`` among rows of larger ``x`` reaches its own, or
    the best among equal ``x`` exceeds it. Rows are first cut to the best ``y`` of each
    ``x``; these are compared within ranges of ``x``, and with the best of the ranges above.
    """
    from pyspark.sql import Window

    best = rows.groupBy(x).agg(F.max(y).alias("_best"))
    limits = sorted(set(best.approxQuantile(x, [k / RANGES for k in range(1, RANGES)], 0.25 / RANGES)))
    ranged = best.withColumn("_range", F.size(F.filter(F.array(*map(F.lit, limits)).cast("array<double>"), lambda c: c < F.col(x))))
    beyond = ranged.groupBy("_range").agg(F.max("_best").alias("_most")).withColumn("_beyond", F.max("_most").over(Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)))
    within = Window.partitionBy("_range").orderBy(F.desc(x)).rowsBetween(Window.unboundedPreceding, -1)
    above = ranged.withColumn("_within", F.max("_best").over(within)).join(beyond.select("_range", "_beyond"), "_range").withColumn("_above", F.greatest("_within", "_beyond"))
    front = above.where(F.col("_above").isNull() | (F.col("_best") > F.col("_above")))
    return rows.join(front.select(F.col(x).alias("_x"), "_best"), (F.col(x) == F.col("_x")) & (F.col(y) == F.col("_best")), "left_semi")


def verdict(swept: DataFrame, default: Column) -> DataFrame:
    """The best row of a sweep beside the default's, and whether the default should stay."""
    best = swept.orderBy(F.desc("objective"), *(c for c in swept.columns if c.startswith("theta"))).limit(1).select(F.col("objective").alias("best_objective"), *(F.col(c).alias(f"best_{c}") for c in swept.columns if c.startswith("theta")))
    own = swept.where(default).select(F.col("objective").alias("default_objective"))
    return best.crossJoin(own).withColumn("keep_default", F.col("best_objective") - F.col("default_objective") < MIN_GAIN)


def report(labelled: DataFrame, traces: DataFrame, horizon: float = HORIZON) -> tuple[DataFrame, DataFrame]:
    """Verdicts on the semantic and on the fade thresholds, over the fixed grids."""
    near = lambda c, v: F.abs(F.col(c) - v) < 1e-9
    semantic = verdict(sweep_semantic(labelled), near("theta_redundancy", 0.92) & near("theta_anomaly", 0.30))
    return semantic, verdict(sweep_fade(traces, horizon=horizon), near("theta", physics.THETA_FADE))
