"""Bounded batches, and counters that outlive the driver."""

from dataclasses import asdict

from pyspark.sql import functions as F

from engram.sources import fixtures as fx
from engram.sources import store
from engram.streaming.breath import BreathingStream, enqueue, event_stream

SF = "/root/testdata/sf0.001"


def test_no_batch_admits_more_than_the_queue(spark, tmp_path):
    enqueue(spark.read.parquet(f"{SF}/events.parquet").where("event_id < 500"), str(tmp_path / "in"), 64)
    sizes = []
    run = event_stream(spark, str(tmp_path / "in")).writeStream.foreachBatch(lambda rows, _: sizes.append(rows.count())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert sum(sizes) == 500 and max(sizes) <= 64 and len(sizes) >= 8


def test_counters_survive_a_restart_and_a_repeated_batch(spark, tmp_path):
    p = fx.perceptions_onehot(spark, SF).where("seq < 60")
    tables = store.TableStore(spark, str(tmp_path / "tables"))
    first = BreathingStream(tables, watermark=20)
    first.breathe(p.where("seq < 20"), 0)
    first.breathe(p.where("seq between 20 and 29"), 1)
    told = asdict(first.stats)
    assert told["breaths"] == told["breaths_pressure"] == 1 and told["pending"] == 10 and told["perceptions_absorbed"] > 0
    second = BreathingStream(tables, watermark=20)
    assert asdict(second.stats) == told
    second.breathe(p.where("seq between 20 and 29"), 1)
    assert asdict(second.stats) == told
    second.breathe(p.where("seq between 30 and 59"), 2)
    s = second.stats
    assert (s.breaths, s.pending, s.short_term_len + s.faded) == (2, 0, 60) and s.perceptions_absorbed > told["perceptions_absorbed"]
    assert asdict(BreathingStream(tables).stats) == asdict(s)
    assert tables.read("archetypes", "").agg(F.count("*")).first()[0] == s.long_term_len
