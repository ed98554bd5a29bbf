"""Predicates with what a scan can use of them: the same rows, and row groups skipped."""

import random

from engram.operators.predicate import compile_predicate, perception_scope, select_where, with_hot_traits

NOW = 1000.0


def some(rnd, depth):
    if depth and rnd.random() < 0.7:
        kind = rnd.choice(["AND", "OR", "NOT"])
        if kind == "NOT":
            return f"NOT ({some(rnd, depth - 1)})"
        return f"({some(rnd, depth - 1)}) {kind} ({some(rnd, depth - 1)})"
    op = rnd.choice(["<", "<=", ">", ">=", "==", "!="])
    return rnd.choice([f'act {op} "{rnd.choice("abc")}"', f"k {op} {rnd.choice([0, 3, 7.5])}", f"cold {op} 3", f"salience {op} {rnd.choice([0.2, 0.5, 0.9])}", f"age {op} {rnd.choice([0, 10, 400, 2000])}", f"weight now {op} 0.3", f'k {op} "x"', f"act {op} 1"])


def test_the_same_rows(spark):
    rnd = random.Random(12)
    value = lambda: rnd.choice([None, "3", "7.5", "x", "nan", "-1", "1e3"])
    rows = []
    for i in range(400):
        traits = {k: v for k, v in (("act", rnd.choice([None, "a", "b", "c", "1"])), ("k", value()), ("cold", value())) if v is not None}
        rows.append((i, traits, rnd.choice([0.2, 0.5, 0.9, None, float("nan")]), 0.001, rnd.choice([0.0, 600.0, 990.0, 1000.0, 1500.0, None])))
    table = spark.createDataFrame(rows, "seq long, traits map<string,string>, salience double, lambda double, tick double")
    hot = with_hot_traits(table, ["act", "k"]).cache()
    for _ in range(60):
        p = some(rnd, 3)
        ids = lambda found: sorted(r.seq for r in found.select("seq").collect())
        assert ids(select_where(hot, p, perception_scope(NOW))) == ids(table.where(compile_predicate(p, perception_scope(NOW)))), p
    hot.unpersist()


def test_row_groups_are_skipped(spark, tmp_path):
    table = spark.range(200_000).selectExpr("id as seq", "map('act', concat('a', lpad(cast(id div 1000 as string), 3, '0')), 'k', cast(id % 10 as string)) as traits", "0.5D as salience", "0.001D as lambda", "cast(id as double) as tick")
    with_hot_traits(table, ["act", "k"]).coalesce(1).sortWithinPartitions("trait_act").write.option("parquet.block.size", 1 << 18).parquet(str(tmp_path / "t"))
    kept = spark.read.parquet(str(tmp_path / "t"))
    found = select_where(kept, 'act == "a150" AND NOT k >= 5', perception_scope(1e6))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(trait_act,a150)" in plan
    assert found.count() == 500
    found.collect()
    scan = found._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert scan.metrics().get("numOutputRows").get().value() < 100_000
