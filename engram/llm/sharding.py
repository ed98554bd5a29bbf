"""Contiguous shards of near equal bytes from global prefix sums.

A row's size is the UTF-8 bytes of its text (null: none) plus 8. Rows are
ordered by doc_id (then size and checksum of the text, then place in the input,
which only tells apart rows that look alike in the result).

Method. The rows are dealt to ranges of that order; each range's total gives the
bytes before it; within a range a running sum gives each row's first byte. With
T bytes in all, a row goes to the shard that holds its middle byte when 0..T is
cut into equal parts. So shards are contiguous, and each holds its part of T to
within the size of one row at either end.

Scale. Only (doc_id, size, checksum) is kept from a row, written once. Ranges
are as many as shuffle partitions, times four, and split ties by place in the
input, so equal rows never pile up. The totals (one row per range) are the only
rows that meet in one task, and the only ones broadcast. Built-in functions
throughout.

Nulls and odd rows: a null text counts 8 bytes and checksum 0; a null doc_id
comes first; repeated rows are sharded each. An empty table gives no rows. If
rows are fewer or much larger than shards, shards may be empty. Extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, stage_table

SHARDS = 24
ROW_BYTES = 8


def shard(documents: DataFrame, *, shards: int = SHARDS, row_bytes: int = ROW_BYTES) -> DataFrame:
    """One row per document: its shard, and its slot there, gapless from 0."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    sized = stage_table(
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + row_bytes).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.monotonically_increasing_id().alias("row")),
        "sizes",
    )
    order = ["doc_id", "size", "text_crc32", "row"]
    ranges = 4 * shuffle_partitions(documents.sparkSession)
    ranged = stage_table(sized.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "ranges")
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    zero = F.lit(0).cast("long")
    starts = totals.select("range", F.coalesce(F.sum("bytes").over(earlier), zero).alias("bytes_before"), F.coalesce(F.sum("rows").over(earlier), zero).alias("rows_before"), F.sum("bytes").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("range").orderBy(*order)
    running = ranged.withColumns({"upto": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)), "place": F.row_number().over(inside)})
    placed = running.join(F.broadcast(starts), "range").select(
        "doc_id",
        "size",
        "text_crc32",
        (F.col("rows_before") + F.col("place") - 1).alias("at_row"),
        F.expr(f"cast(least({shards} - 1, ((2 * (bytes_before + upto) - size) * {shards}) div (2 * total)) as int)").alias("shard"),
    )
    placed = stage_table(placed, "placed")
    firsts = placed.groupBy("shard").agg(F.min("at_row").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at_row") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
