"""Sparse trajectories and cumulative sweeps against dense computations."""

import random

import numpy as np

from engram.operators import arc, calibrate


def dense(rows):
    out = {}
    for s in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == s]
        cycles = sorted({r[1] for r in own})
        total = {c: sum(r[4] for r in own if r[1] == c) for c in cycles}
        for label in {r[3] for r in own}:
            n = {r[1]: r[4] for r in own if r[3] == label}
            out[s, label] = [n.get(c, 0) / total[c] for c in cycles]
    return out


def rows_of(rnd):
    rows = []
    for s in range(40):
        for c in sorted(rnd.sample(range(30), rnd.randint(1, 12))):
            for label in rnd.sample("abcde", rnd.randint(1, 3)):
                rows.append((f"s{s}", c, float(c), label, rnd.choice([1, 1, 2, 9, 40])))
    # Shares so small that a milestone without the label counts as the peak.
    rows += [("tiny", c, float(c), "big", 10**7) for c in range(6)] + [("tiny", c, float(c), "rare", 1) for c in (1, 2, 5)]
    return rows


def test_revivals_and_trajectories(spark):
    rows = rows_of(random.Random(6))
    counts = spark.createDataFrame(rows, "subject string, cycle int, tick double, label string, n long")
    series = dense(rows)
    want = set()
    for (s, label), x in series.items():
        peak = max(x)
        if len(x) < 3 or peak <= 0:
            continue
        top = next(i for i, v in enumerate(x) if abs(v - peak) <= 1e-6)
        fell = next((i for i, v in enumerate(x) if i > top and v < peak * 0.25), None)
        if fell is not None and any(v >= peak * 0.25 for v in x[fell + 1 :]):
            want.add((s, label))
    assert {tuple(r) for r in arc.revivals(counts).collect()} == want and ("tiny", "rare") in want and len(want) > 10
    got = {(r.subject, r.label): r for r in arc.trajectories(counts, 2).collect()}
    for s in {k[0] for k in series}:
        ranked = sorted(((-round(max(x) * (1 + float(np.var(x))), 12), label) for (t, label), x in series.items() if t == s))[:2]
        assert [label for _, label in ranked] == [r.label for r in sorted((r for k, r in got.items() if k[0] == s), key=lambda r: r.rank)]
        for score, label in ranked:
            assert abs(got[s, label].score + score) < 1e-9 and np.allclose(got[s, label].series, series[s, label])


def test_sweeps(spark):
    rnd = random.Random(9)
    scores = [(rnd.choice([0.0, 0.1, 0.5, 0.9, 1.0, rnd.random()]), rnd.random() < 0.4) for _ in range(500)] + [(None, True), (0.3, None), (float("nan"), True)]
    table = spark.createDataFrame(scores, "score double, actual boolean")
    got = {r.theta: (r.tp, r.fp, r.fn, r.tn) for r in calibrate.sweep(table, [0.5, 0.1, 0.9, 0.5]).collect()}
    known = [((np.inf if s != s else s), a) for s, a in scores if s is not None and a is not None]
    assert got == {t: tuple(sum((s >= t) == p and a == q for s, a in known) for p, q in ((True, True), (True, False), (False, True), (False, False))) for t in (0.1, 0.5, 0.9)}
    kinds = [(rnd.choice([0.1, 0.3, 0.92, 0.96, rnd.random()]), rnd.choice(["redundant", "anomaly", "signal"])) for _ in range(400)]
    for r in calibrate.sweep_semantic(spark.createDataFrame(kinds, "cosine double, kind string")).collect():
        red = [c >= r.theta_redundancy for c, _ in kinds]
        odd = [not x and c <= r.theta_anomaly for x, (c, _) in zip(red, kinds, strict=True)]
        for flags, kind, f1 in ((red, "redundant", r.f1_redundancy), (odd, "anomaly", r.f1_anomaly)):
            tp = sum(f and k == kind for f, (_, k) in zip(flags, kinds, strict=True))
            assert abs(f1 - (2 * tp / (sum(flags) + sum(k == kind for _, k in kinds)) if tp else 0)) < 1e-9
        lost = sum(x and k == "signal" for x, (_, k) in zip(red, kinds, strict=True)) / sum(k == "signal" for _, k in kinds)
        assert abs(r.signal_faded - lost) < 1e-12


def test_sweeps_shuffle_positions_only(spark):
    table = spark.range(100_000).selectExpr("rand(3) as cosine", "element_at(array('redundant', 'anomaly', 'signal'), cast(id % 3 as int) + 1) as kind")
    plan = calibrate.sweep_semantic(table)._jdf.queryExecution().optimizedPlan().toString()
    first_generate, first_aggregate = plan.rfind("Generate"), plan.rfind("Aggregate")
    assert first_aggregate > first_generate  # the tree prints sources last: rows are counted before thresholds are laid out
