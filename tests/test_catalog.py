"""Every query with a DuckDB twin gives its rows, on the smallest tables."""

import os

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from engram.functions import vectors
from engram.operators import retrieval
from engram.operators.retrieval import nearest_exact
from engram.operators.tree_index import TreeIndex
from engram.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, db, name):
    got = QUERIES[name](spark, SF)
    want = db.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(want.columns, want.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(ORACLES) > 55


def test_rows_only_queries(spark):
    assert QUERIES["resonate_subjects"](spark, SF).count() == 5
    norms = {r.norm for r in QUERIES["hashed_embeddings"](spark, SF).collect()}
    assert norms <= {0.0, 1.0}
    report = {r.what: r for r in QUERIES["calibration_report"](spark, SF).collect()}
    assert set(report) == {"semantic", "fade"} and all(0 <= r.default_objective <= r.best_objective <= 1 for r in report.values())


def test_ann_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    near = rows.alias("a").where("vec_id % 20 = 0").crossJoin(rows.alias("b")).select(F.col("a.vec_id").alias("query"), F.col("b.vec_id").alias("id"), vectors.cosine(F.col("a.embedding"), F.col("b.embedding")).alias("c"))
    best = {}
    for r in near.orderBy("query", F.desc("c"), "id").collect():
        best.setdefault(r.query, []).append(r.id)
    got = {(r.query, r.id) for r in QUERIES["resonate_ann"](spark, SF).collect()}
    want = {(q, i) for q, ids in best.items() for i in ids[:10]}
    assert len(got & want) >= 0.9 * len(want)


def test_all_pairs_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 7)
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id < 120").select("vec_id", "label", "embedding")
    a, b = rows.alias("a"), rows.alias("b")
    want = a.join(b, (F.col("a.label") == F.col("b.label")) & (F.col("a.vec_id") < F.col("b.vec_id"))).select("a.vec_id", "b.vec_id", F.round(vectors.dot(F.col("a.embedding"), F.col("b.embedding")), 6), F.round(vectors.cosine(F.col("a.embedding"), F.col("b.embedding")), 6))
    got = retrieval.all_pairs(rows, "label", "vec_id", "embedding").select("left_id", "right_id", F.round("dot", 6), F.round("cosine", 6))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize(("kind", "most"), [("clustered", 0.02), ("structureless", 0.6)])
def test_index_of_cells_prunes_and_finds(spark, kind, most):
    """20,000 vectors of 48 places: recall of the ten nearest, and the share of pairs compared."""
    rng = np.random.default_rng(3)
    x = rng.uniform(-1, 1, (20_000, 48)) if kind == "structureless" else rng.normal(0, 1, (200, 48))[rng.integers(0, 200, 20_000)] + rng.normal(0, 0.35, (20_000, 48))
    rows = spark.createDataFrame(pa.table({"id": np.arange(len(x)), "v": list(x)}))
    queries = rows.where("id % 400 = 0")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    best = {int(q): set(np.argsort(-(unit[q] @ unit.T))[:10].tolist()) for q in range(0, len(x), 400)}
    index = TreeIndex(rows, "id", "v")
    found = {}
    for r in index.join(queries, "id", "v", 10).collect():
        found.setdefault(r.query, set()).add(r.id)
    assert sum(len(found[q] & best[q]) for q in best) >= 0.9 * 10 * len(best)
    assert all(len(f) == 10 for f in found.values())
    share = index.candidate_share(queries, "id", "v")
    print(kind, "candidate share", share)
    assert share <= most
    exact = {}
    for r in nearest_exact(rows, "id", "v", queries, "id", "v", 10).collect():
        exact.setdefault(r.query, set()).add(r.id)
    assert exact == best
    one = [r.id for r in index.nearest(x[400].tolist(), 10).collect()]
    assert set(one) == found[400]
