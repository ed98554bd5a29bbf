"""Copies within a hot subject are counted, not folded, with the same facts."""

import numpy as np

from engram.operators import facts


def test_copies_of_a_hot_subject_stay_out_of_the_folds(spark, monkeypatch):
    rng = np.random.default_rng(5)
    angle = rng.integers(0, 40, 1200) * 0.11
    v = [[round(float(np.cos(a)), 6), round(float(np.sin(a)), 6)] for a in angle]
    for i in range(0, 1200, 97):
        v[i] = [[0.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.2, 0.9]][i % 3]
    kind = "seq long, subject string, text string, embedding array<double>, provenance string, tick double, salience double, halflife double"
    rows = [(i, "hot" if i % 4 else f"s{i % 9}", f"t{i}", v[i], "p", float(i * 7 % 1000), 0.9, 1e6) for i in range(1200)]
    old = facts.remember(None, spark.createDataFrame([(-9 + i, "hot", f"o{i}", [1.0, 0.2 * (i // 2)], "p", float(i), 0.9, 1e6) for i in range(6)], kind), theta=0.9999999)
    old = old.unionByName(old.selectExpr("seq + 1000000 AS seq", *[c for c in old.columns if c != "seq"]))
    new = spark.createDataFrame(rows, kind)
    seen, plain_groups = [], facts.groups_of

    def counted(rows, theta):
        seen.append(rows.count())
        return plain_groups(rows, theta)

    monkeypatch.setattr(facts, "groups_of", counted)
    for known in (None, old):
        plain, cut = ({r.seq: r.asDict() for r in facts.remember(known, new, hot=hot).collect()} for hot in (10**9, 200))
        assert plain == cut and len(plain) > 5
    assert max(seen) < 100
