"""Token ids don't pass through Python when pieces are placed."""

from engram.llm.packing import pack
from engram.llm.token_counts import read_tokenizer


def test_ids_stay_out_of_the_placing_step(spark):
    docs = spark.createDataFrame([(i, "a few words of text " * (i % 7)) for i in range(40)], "doc_id long, text string")
    packed = pack(docs, read_tokenizer("byte_bpe_50k.json"), with_ids=True)
    plan = packed._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "ArrowEvalPython" in plan
    rows = packed.collect()
    assert len(rows) == 40 and all(len(r.ids) == r.length for r in rows)
    assert len({(r.sequence_id, r.offset) for r in rows}) == 40
