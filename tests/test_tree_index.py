"""The tree index: recall and share as rows grow, changes without a rebuild, odd rows."""

import numpy as np
import pyarrow as pa
import pytest

from engram.operators import tree_index
from engram.operators.retrieval import nearest_exact
from engram.operators.tree_index import TreeIndex


def vectors_of(n, seed=3):
    rng = np.random.default_rng(seed)
    return rng.normal(0, 1, (150, 32))[rng.integers(0, 150, n)] + rng.normal(0, 0.35, (n, 32))


def table(spark, x, first=0):
    return spark.createDataFrame(pa.table({"id": np.arange(first, first + len(x)), "v": list(x)}))


def recall(index, rows, queries, k=10):
    got = {(r.query, r.id) for r in index.join(queries, "id", "v", k).collect()}
    want = {(r.query, r.id) for r in nearest_exact(rows, "id", "v", queries, "id", "v", k).collect()}
    return len(got & want) / len(want)


def test_share_falls_as_rows_grow(spark):
    shares = []
    for n in (4_000, 40_000):
        rows = table(spark, vectors_of(n))
        queries = rows.where(f"id % {n // 40} = 0")
        index = TreeIndex(rows, "id", "v")
        assert recall(index, rows, queries) >= 0.9 and index.recall >= 0.9
        assert len(index.tree.leaves) >= n**0.5
        shares.append(index.candidate_share(queries, "id", "v"))
        index.close()
    assert shares[1] < shares[0] < 0.02


def test_changes_without_a_rebuild(spark, monkeypatch):
    monkeypatch.setattr(tree_index, "MAX_PARTS", 4)
    x = vectors_of(6_000)
    rows = table(spark, x[:4000])
    index = TreeIndex(rows, "id", "v")
    tree = index.tree
    index.insert(table(spark, x[4000:5000], 4000))
    both = table(spark, x[:5000])
    assert index.count == 5000 and recall(index, both, both.where("id % 100 = 0")) >= 0.9
    # A new version: some rows moved, some gone, some new; only these are written.
    y = x.copy()
    y[:50] = x[5000:5050]
    new = table(spark, y[:5500]).where("id not between 60 and 99")
    assert index.refresh(new) == 50 + 40 + 500
    assert index.refresh(new) == 0 and index.count == 5460
    assert recall(index, new, new.where("id % 100 = 0")) >= 0.9
    assert [r.id for r in index.nearest(y[7].tolist(), 1).collect()] == [7]
    assert index.tree is tree
    for k in range(3):
        index.insert(table(spark, x[5500 + k : 5501 + k], 5500 + k))
    assert len(index.parts) < 4 and index.count == 5463 and index.tree is tree
    index.insert(table(spark, vectors_of(12_000, 5), 10_000))
    assert index.tree is not tree and index.count == 17_463


def test_copies_and_odd_rows(spark):
    x = vectors_of(600)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[0].tolist()) for i in range(400)] + [(5000, None), (5001, [1.0, 2.0]), (5002, [0.0] * 32), (5003, [])]
    table_ = spark.createDataFrame(rows, "id long, v array<double>").selectExpr("*", "1 as leaf", "'c' as code")
    index = TreeIndex(table_, "id", "v")
    got = index.join(table_.where("id in (5, 5000, 5001, 5002)"), "id", "v", 3).collect()
    assert [r.id for r in got if r["query"] == 5][0] == 5 and not {r["query"] for r in got} & {5000, 5001}
    assert all(r.cosine == 0 for r in got if r["query"] == 5002)
    near = index.nearest(x[0].tolist(), 401).collect()
    assert {r.id for r in near} == {0, *range(1000, 1400)}
    assert index.nearest([1.0], 3).count() == 0
    empty = TreeIndex(table_.limit(0), "id", "v")
    assert empty.join(table_, "id", "v", 3).count() == 0
    empty.insert(table_.where("id < 10"))
    assert empty.count == 0 or empty.join(table_.where("id = 3"), "id", "v", 1).first().id == 3


def test_lengths_of_exact_search(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0, 1.0]), (3, None), (4, [0.0])], "id long, v array<double>")
    got = {(r["query"], r.id): r.cosine for r in nearest_exact(rows, "id", "v", rows.where("id <= 2"), "id", "v", 4).collect()}
    assert got[1, 1] == pytest.approx(1) and got[1, 2] == pytest.approx(3**-0.5) and got[1, 3] == got[2, 4] == 0
