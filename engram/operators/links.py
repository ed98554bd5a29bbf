"""Which vectors of a subject may merge: groups of rows linked by a cosine of at least a threshold, exactly.

1. Equal vectors are linked to the first of them, so that copies cost a row each, not a pair each.
2. Angles obey the triangle inequality: two vectors within the angle a of one another differ by
   at most a in their angle to any pivot. With a few pivots each vector falls into a
   cell of a grid of step a, and only the same and adjacent cells can hold partners.
3. Cells are cut into blocks; two blocks are compared as a matrix product inside a task, which gives out one
   link for each row that has any, to the smallest row it reaches within the two blocks.
4. Groups are the connected components of the links, by alternating star contractions.

Scale. Nothing is gathered by subject. A row goes to the blocks of at most 3^``PIVOTS`` cells;
where a cell holds very many different vectors all near one another, its blocks are compared pairwise, so that work grows
with the square of such a set, a task at a time; memory is two blocks a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import staged
from .retrieval import _padded, _unit

PIVOTS = 3
BLOCK = 2048
SLACK = 1e-9  # links may be too many, never too few


def _cells(pivots: dict[int, np.ndarray], step: float):
    """Rows with their cell: the angles to the pivots of their length, in steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("width").to_numpy()
            cells = np.zeros((batch.num_rows, PIVOTS), np.int32)
            for width in np.unique(size).tolist():
                own = np.flatnonzero(size == width)
                x = _unit(_padded(pa.chunked_array([batch.column("v").take(pa.array(own))])))
                angles = np.arccos(np.clip(x @ pivots[width].T, -1, 1))
                cells[own] = np.floor(angles / step)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(cells[:, k]) for k in range(PIVOTS))], [*batch.schema.names, *(f"c{k}" for k in range(PIVOTS))])

    return run


def _linked(theta: float):
    """Links within two blocks (or one): each row that has a partner, with the smallest row that it reaches."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        ids = np.concatenate([left.column("rid").to_numpy(), right.column("other").to_numpy()])
        near = _unit(_padded(left.column("v"))) @ _unit(_padded(right.column("w"))).T >= theta - SLACK
        n = len(left)
        label = ids.copy()
        while True:  # labels sink to the smallest reachable one
            low = label.copy()
            low[:n] = np.minimum(low[:n], np.where(near, label[n:][None, :], np.iinfo(np.int64).max).min(axis=1))
            low[n:] = np.minimum(low[n:], np.where(near, low[:n][:, None], np.iinfo(np.int64).max).min(axis=0))
            if np.array_equal(low, label):
                break
            label = low
        moved = label < ids
        return pa.table({"a": ids[moved], "b": label[moved]})

    return run


def components(links: DataFrame) -> DataFrame:
    """(rid, group) of every row in links (a, b), the group being its smallest row; alternating large and small stars."""
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = staged(large.where("a <> b").distinct(), "links")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        edges = staged(small.where("a <> b").distinct(), "links")
        seen = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if before == seen:
            roots = edges.select(F.col("b").alias("rid"), F.col("b").alias("group")).distinct()
            return edges.select(F.col("a").alias("rid"), F.col("b").alias("group")).unionByName(roots)
        before = seen


def groups_of(rows: DataFrame, theta: float, *, block: int = BLOCK) -> DataFrame:
    """(rid, group) of the rows (rid, subject, v) that may merge with another one; ``theta`` above 0. All others are alone."""
    step = math.acos(min(1.0, theta - SLACK)) if theta < 1 else 1e-3
    known = staged(rows.where(F.size("v") > 0).select("rid", "subject", "v", F.size("v").alias("width")), "rows")
    same = known.groupBy("subject", "v").agg(F.min("rid").alias("first"), F.count("*").alias("n"), F.first("width").alias("width"))
    firsts = staged(same, "firsts")
    copies = known.join(firsts.where("n > 1").select("subject", "v", "first"), ["subject", "v"]).where("rid > first").select(F.col("rid").alias("a"), F.col("first").alias("b"))
    # A pivot or so for each length: any rows do; they are few, whatever the table's size.
    picked = firsts.select("width", "v").groupBy("width").agg(*(F.min_by("v", F.xxhash64("v", F.lit(k))).alias(f"p{k}") for k in range(PIVOTS))).collect()
    pivots = {r["width"]: _unit(np.array([r[f"p{k}"] for k in range(PIVOTS)], float)) for r in picked}
    names = [f"c{k}" for k in range(PIVOTS)]
    placed = firsts.select("subject", F.col("first").alias("rid"), "v", "width").mapInArrow(_cells(pivots, step), "subject string, rid bigint, v array<double>, width int, " + ", ".join(f"{c} int" for c in names))
    placed = staged(placed, "cells")
    cell = ["subject", "width", *names]
    sizes = staged(placed.groupBy(*cell).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "sizes")
    # Pairs of cells, each once: the greater is reached from the smaller by a step in each direction.
    steps = F.array(*(F.struct(*(F.lit(d).alias(f"d{k}") for k, d in enumerate(ds))) for ds in product((-1, 0, 1), repeat=PIVOTS) if ds >= (0,) * PIVOTS))
    to = sizes.select(*cell, "blocks", F.explode(steps).alias("s")).select("subject", "width", *names, "blocks", *((F.col(c) + F.col(f"s.d{k}")).alias(f"t{k}") for k, c in enumerate(names)))
    other = sizes.select("subject", "width", *(F.col(c).alias(f"t{k}") for k, c in enumerate(names)), F.col("blocks").alias("other_blocks"))
    met = to.join(other, ["subject", "width", *(f"t{k}" for k in range(PIVOTS))])
    own = F.forall(F.array(*(F.struct(F.col(c).alias("x"), F.col(f"t{k}").alias("y")) for k, c in enumerate(names))), lambda z: z["x"] == z["y"])
    pairs = met.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("other_blocks") - 1))).where(~own | (F.col("i") <= F.col("j")))
    # A cell of one row alone has nothing to compare with itself.
    pairs = staged(pairs.select(*cell, *(f"t{k}" for k in range(PIVOTS)), "i", "j").withColumn("pair", F.monotonically_increasing_id()), "pairs")
    blocked = placed.join(sizes, cell).withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    left = blocked.join(pairs.select(*cell, F.col("i").alias("block"), "pair"), [*cell, "block"]).select("pair", "rid", "v")
    right = blocked.join(pairs.select("subject", "width", *(F.col(f"t{k}").alias(c) for k, c in enumerate(names)), F.col("j").alias("block"), "pair"), [*cell, "block"]).select(F.col("pair").alias("other_pair"), F.col("rid").alias("other"), F.col("v").alias("w"))
    links = left.groupBy("pair").cogroup(right.groupBy("other_pair")).applyInArrow(_linked(theta), "a bigint, b bigint")
    return components(copies.unionByName(links))
