"""Decay physics as column expressions.

``weight(t) = salience * exp(-lambda * max(t - last_touch, 0)) * (1 + reinforcement)``.
Weight only falls with time, so "weight >= theta at t" is the plain comparison
``t <= expires_at``, which Parquet statistics can prune on.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the memory model.
THETA_FADE = 0.05
DAY = 86_400.0
MAX_HALFLIFE = 10 * 365 * DAY
LAMBDA_FLOOR = math.log(2) / MAX_HALFLIFE
RESILIENCE_HALFLIFE = {"low": 30 * DAY, "medium": 180 * DAY, "high": 720 * DAY}


def lambda_from_halflife(halflife: float | Column) -> float | Column:
    """``ln 2 / halflife``. A number must be above 0; in a column other values raise at run time."""
    if isinstance(halflife, Column):
        return F.lit(math.log(2)) / F.when(halflife > 0, halflife).otherwise(F.raise_error(F.lit("half-life must be positive")).cast("double"))
    if not halflife > 0:
        raise ValueError("half-life must be positive")
    return math.log(2) / halflife


def halflife_from_lambda(lam: float | Column) -> float | Column:
    """``ln 2 / lambda``, with the same checks."""
    if isinstance(lam, Column):
        return F.lit(math.log(2)) / F.when(lam > 0, lam).otherwise(F.raise_error(F.lit("lambda must be positive")).cast("double"))
    if not lam > 0:
        raise ValueError("lambda must be positive")
    return math.log(2) / lam


def delta_t(now: Column | float, last_touch: Column) -> Column:
    """Elapsed time; a clock that runs backwards gives 0."""
    return F.greatest(F.lit(now) - last_touch, F.lit(0.0))


def weight(now: Column | float, salience: Column, lam: Column, last_touch: Column, reinforcement: Column | float = 0.0) -> Column:
    return salience * F.exp(-lam * delta_t(now, last_touch)) * (F.lit(1.0) + F.lit(reinforcement))


def expires_at(salience: Column, lam: Column, last_touch: Column, reinforcement: Column | float = 0.0, theta: float = THETA_FADE) -> Column:
    """The last tick at which the weight is at least ``theta``; null if it never is."""
    start = salience * (F.lit(1.0) + F.lit(reinforcement))
    return F.when(start >= theta, last_touch + F.ln(start / F.lit(theta)) / lam)


def is_faded(now: Column | float, expires: Column) -> Column:
    """Weight below the threshold at ``now``, from the stored expiry."""
    return F.coalesce(expires < F.lit(now), F.lit(True))


def reinforcement_after(touches: Column) -> Column:
    """Reinforcement after n touches: R(0) = 0, R(n) = R(n-1) + 1 / (1 + R(n-1))."""
    steps = F.when(touches > 0, F.sequence(F.lit(1), touches.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(0.0), lambda r, _: r + F.lit(1.0) / (F.lit(1.0) + r))


def lambda_after(lam: Column, touches: Column, consolidation: float | Column) -> Column:
    """Decay rate after n touches of one consolidation; the floor holds from the first touch on."""
    return F.when(touches > 0, F.greatest(lam * F.pow(F.lit(1.0) - F.lit(consolidation), touches.cast("double")), F.lit(LAMBDA_FLOOR))).otherwise(lam)
