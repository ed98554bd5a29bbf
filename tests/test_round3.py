"""Work and memory that follow the input: archetypes made once, tasks by rows, slices, ties among copies."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from engram.operators import archetype, consolidate, evoke, tree_index
from engram.plans import catalog
from engram.sources import fixtures as fx
from engram.streaming import breath

SF = "/root/testdata/sf0.001"


def test_a_search_over_subjects_makes_the_archetypes_once(spark):
    made = consolidate.replay(fx.alive_per_cycle(fx.perceptions_onehot(spark, SF)), fx.CYCLE_SECONDS).persist()
    seen, n = spark.sparkContext.accumulator(0), made.count()

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    found = tree_index.Retriever(flat_limit=5).resonate_subjects(made.mapInArrow(counted, made.schema), [0.2, 0.1, 0.9, 0.3, 0.15], 5, 31 * fx.CYCLE_SECONDS)
    assert found.count() == 5 and n > 5 and seen.value == n
    made.unpersist()


def test_tasks_of_a_replay_follow_the_rows(spark, monkeypatch):
    live = fx.alive_per_cycle(fx.perceptions_onehot(spark, SF))
    whole = {r.subject: r for r in archetype.mode_rows(consolidate.replay(live, fx.CYCLE_SECONDS)).groupBy("subject").agg(F.sum("absorbed").alias("n"), F.count("*").alias("modes")).collect()}
    monkeypatch.setattr(consolidate, "ROWS_A_TASK", 100)
    cut = consolidate.replay(live, fx.CYCLE_SECONDS)
    assert cut.rdd.getNumPartitions() == -(-live.count() // 100) > 4
    assert {r.subject: r for r in archetype.mode_rows(cut).groupBy("subject").agg(F.sum("absorbed").alias("n"), F.count("*").alias("modes")).collect()} == whole


def test_slices_of_batches():
    batches = [pa.record_batch({"x": list(range(n))}) for n in (0, 1, 700)]
    assert [b.num_rows for b in evoke.slices(batches, 256)] == [1, 256, 256, 188]


def test_copies_cost_an_index_no_recall_and_no_leaves(spark):
    x = np.random.default_rng(3).normal(0, 1, (60, 12))
    rows = spark.createDataFrame([(j * 60 + i, x[i].tolist()) for j in range(100) for i in range(60)], "id long, v array<double>")
    index = tree_index.TreeIndex(rows, "id", "v")
    assert index.recall == 1.0 and index.probes < len(index.tree.leaves) / 4
    found = index.join(rows.where("id < 60"), "id", "v", 10).select("query", "id").collect()
    assert {(r.query, r.id) for r in found} == {(i, j * 60 + i) for i in range(60) for j in range(10)}
    index.close()


def test_streams_keep_few_states_and_plain_sums(spark, monkeypatch):
    """Subjects share states, and each is told as if alone; living perceptions are summed by the engine, without Python."""
    monkeypatch.setattr(breath, "BUCKETS", 3)
    state = breath.expiring(fx.perceptions_of(spark.readStream.schema(spark.read.parquet(f"{SF}/events.parquet").schema).parquet(SF)))
    assert "bucket" in state._jdf.queryExecution().analyzed().toString()
    rows = breath.living(fx.perceptions(spark, SF), 864_000.0)
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString() and rows.count() > 5


def test_arrivals_come_in_as_many_files_whatever_the_table_is_cut_into(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").repartition(30).write.parquet(str(tmp_path / "events.parquet"))
    read = spark.read.parquet(catalog._arrivals(spark, str(tmp_path)))
    assert read.count() == spark.read.parquet(f"{SF}/events.parquet").count() and len(read.inputFiles()) <= 21
