"""Facts of a hot subject: groups that may merge, found exactly, give the same facts as one fold."""

import random

import numpy as np
import pytest

from engram.operators import facts
from engram.operators.links import components, groups_of

NEW = "seq bigint, subject string, text string, embedding array<double>, provenance string, tick double, salience double, halflife double"


def closure(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components(spark):
    rnd = random.Random(2)
    pairs = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(200)] + [(5000, 5001 + i) for i in range(500)] + [(7, 7)]
    got = {r.rid: r.group for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: g for x, g in closure([p for p in pairs if p[0] != p[1]]).items()}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("theta", [0.95, 0.8, 1.0])
def test_groups_are_exact(spark, theta):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (60, 12))[rng.integers(0, 60, 500)] + rng.normal(0, 0.25, (500, 12))
    x[400:450] = x[:50]
    x[450:] = x[3] * rng.uniform(0.5, 2, (50, 1))
    rows = [(i, f"s{i % 2}", x[i].tolist()) for i in range(500)] + [(900, "s0", [1.0, 0.0]), (901, "s0", [1.0, 0.0]), (902, "s0", None), (903, "s0", []), (904, "s0", [0.0] * 12), (905, "s0", [0.0] * 12)]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= theta - 1e-9
    want = closure([(i, j) for i in range(500) for j in range(i + 1, 500) if i % 2 == j % 2 and near[i, j]] + [(900, 901), (904, 905)])
    got = {r.rid: r.group for r in groups_of(spark.createDataFrame(rows, "rid long, subject string, v array<double>"), theta, block=16).collect()}
    assert got == want


def test_a_hot_subject_gives_the_same_facts(spark):
    """Vectors around the threshold, many of them equal; old facts and new ones; half of all rows in one subject."""
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 1, (40, 8))
    v = centres[rng.integers(0, 40, 1500)] + rng.normal(0, 0.22, (1500, 8))
    v[::5] = v[0]
    rows = [(i, "hot" if i % 2 else f"s{i % 9}", f"t{i}", [round(float(c), 3) for c in v[i]], "p", float(i), 0.9, 1e6) for i in range(1500)]
    old = facts.remember(None, spark.createDataFrame(rows[:500], NEW))
    old = spark.createDataFrame(old.collect(), old.schema)
    new = spark.createDataFrame(rows[500:], NEW)
    plain, cut = ({r.seq: r.asDict() for r in facts.remember(old, new, hot=hot).collect()} for hot in (10**9, 200))
    assert cut == plain and 50 < len(plain) < 1400
    assert any(r["reinforcement"] > 1 for r in plain.values())
