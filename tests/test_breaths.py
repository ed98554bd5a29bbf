"""Breaths over many files and many cores."""

from pyspark.sql import functions as F

from engram.operators import consolidate
from engram.plans import catalog
from engram.sources import fixtures as fx
from engram.sources import store
from engram.streaming.breath import BreathingStream, enqueue, event_stream

SF = "/root/testdata/sf0.001"


def test_a_turn_of_many_files_is_one_breath(spark, tmp_path):
    run = BreathingStream(store.TableStore(spark, str(tmp_path / "tables")), watermark=1)
    for turn, part in enumerate(catalog._turns(fx.read(spark, SF, "events"))):
        enqueue(part.repartition(3), str(tmp_path / "in"), 64)
        rows = event_stream(spark, str(tmp_path / "in"), None).withColumn("embedding", fx.one_hot())
        run.start(rows, str(tmp_path / "checkpoint")).awaitTermination()
        assert run.stats.breaths == turn + 1
    assert len(spark.read.parquet(str(tmp_path / "in")).inputFiles()) > 7
    assert run.stats.short_term_len + run.stats.faded == fx.read(spark, SF, "events").count()


def test_archetypes_are_folded_on_all_cores_without_a_join(spark):
    p, now = fx.perceptions_onehot(spark, SF), 20 * fx.CYCLE_SECONDS
    first = consolidate.breathe(None, p, now)
    first = spark.createDataFrame(first.collect(), first.schema)
    second = consolidate.breathe(first, p, now + 1)
    assert "Join" not in second._jdf.queryExecution().executedPlan().toString()
    assert second.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_perceptions_without_a_subject_go_on_in_one_archetype(spark):
    p = fx.perceptions_onehot(spark, SF).withColumn("subject", F.when(F.col("seq") % 2 == 0, F.col("subject")))
    now = 20 * fx.CYCLE_SECONDS
    first = consolidate.breathe(None, p, now)
    rows = consolidate.breathe(spark.createDataFrame(first.collect(), first.schema), p, now).where("subject IS NULL").collect()
    assert [len(r.arc) for r in rows] == [2]
