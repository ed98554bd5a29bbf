"""Leader clustering in segments equals the fold."""

import numpy as np
import pytest

from engram.operators.distill import cluster_modes
from engram.operators.segments import cluster_segments


def seeds_of(rows):
    return {r.subject: [(s.mode, s.absorbed, s.label, [(h.label, h.n) for h in s.label_histogram], [round(c, 6) for c in s.centroid]) for s in r.seeds] for r in rows.collect()}


@pytest.mark.parametrize("kind", ["stable", "drifting", "late leaders"])
def test_equal_to_the_fold(spark, kind):
    rng = np.random.default_rng(11)
    n = 3000
    centres = rng.normal(0, 1, (12, 6))
    at = rng.integers(0, 4 if kind == "stable" else 12, n)
    if kind == "late leaders":  # directions that come up one after another, some in the last segments
        at = np.minimum(at, np.arange(n) // 260)
    x = centres[at] + rng.normal(0, 0.3, (n, 6))
    if kind == "drifting":
        x += np.linspace(0, 4, n)[:, None] * rng.normal(0, 1, 6)
    rows = [(i, "hot" if i % 2 else f"s{i % 3}", x[i].tolist(), f"l{at[i]}" if i % 7 else "") for i in range(n)]
    rows += [(n + 1, "hot", [1.0, 2.0], "short"), (n + 2, "hot", [0.0] * 6, "zero"), (n + 3, "s0", None, "none")]
    table = spark.createDataFrame(rows, "seq long, subject string, embedding array<double>, label string")
    plain = seeds_of(cluster_modes(table, ["subject"], hot=10**9))
    whole = table.where("embedding is not null").select("subject", "seq", "embedding", "label")
    assert seeds_of(cluster_segments(whole, ["subject"], theta=0.5, max_modes=8, segment_rows=250)) == plain
    assert len(plain["hot"]) >= 4
    if kind == "stable":
        assert seeds_of(cluster_modes(table, ["subject"], hot=1000)) == plain
