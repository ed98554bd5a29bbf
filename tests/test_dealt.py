"""Rows of a key meet in one task, however they were dealt before."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from engram.operators import consolidate, retrieval
from engram.operators.ordered import ordered_fold

ROWS = [(i, f"s{i % 40}", "a" if i % 3 else "b") for i in range(2000)]


CONF = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b"}


@pytest.fixture
def joined(spark):
    """Rows that two joins without a broadcast have dealt by subject, one above the other; the sides differ in size, so their partitions are joined differently."""
    before = {k: spark.conf.get(k) for k in CONF}
    for k, v in CONF.items():
        spark.conf.set(k, v)
    rows = spark.createDataFrame(ROWS, "seq long, subject string, label string").withColumn("embedding", F.array(F.lit(1.0), F.lit(0.5)))
    known = rows.select("subject").distinct()
    yield rows.withColumn("cycle", F.lit(1)).join(known, "subject", "left_semi").unionByName(rows.where("seq < 80").withColumn("cycle", F.lit(2)).join(known, "subject", "left_semi"))
    for k, v in before.items():
        spark.conf.set(k, v)


def test_a_cycle_has_all_its_rows(spark, joined):
    got = consolidate.cycles_of(joined, F.lit(0.0)).select("subject", "cycle", "absorbed", "core_label").collect()
    want = Counter((s, c) for i, s, _ in ROWS for c in (1, 2) if c == 1 or i < 80)
    assert sorted((r.subject, r.cycle, r.absorbed, r.core_label) for r in got) == sorted((*k, n, "a") for k, n in want.items())


@pytest.mark.parametrize("tasks", [None, 4])
def test_a_key_is_folded_once(spark, joined, tasks):
    assert int(spark.conf.get("spark.sql.shuffle.partitions")) == 4

    def fold(key, own):
        yield {"subject": key[0], "n": sum(1 for _ in own)}

    got = ordered_fold(joined.select("subject", "seq"), ["subject"], ["seq"], fold, "subject string, n bigint", tasks).collect()
    assert Counter({r.subject: r.n for r in got}) == Counter(s for _, s, _ in ROWS) + Counter(s for i, s, _ in ROWS if i < 80) and len(got) == 40


def test_pairs_send_floats_as_they_are(spark):
    rows = spark.createDataFrame([(i, i % 3, [0.1 * i, 0.3, 1.0 / (i + 1)]) for i in range(60)], "id long, label int, v array<float>")
    pairs = retrieval.all_pairs(rows, "label", "id", "v")
    assert "as array<double>" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    wide = retrieval.all_pairs(rows.withColumn("v", F.col("v").cast("array<double>")), "label", "id", "v")
    assert sorted(pairs.collect()) == sorted(wide.collect()) and pairs.count() == 3 * 190
