"""Ordered folds: state machines over the rows of each key in a given order.

Rows are dealt by key, sorted inside the partition and streamed through the fold
in Arrow batches. A key's rows are never gathered: memory holds one batch and the
fold's state. A key with a large share of all rows is slow; where the state grows with the
rows (facts of a subject), such keys are cut into independent groups before they come here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

Row = dict
Fold = Callable[[tuple, Iterator[Row]], Iterator[Row]]


def dealt(df: DataFrame, keys: Sequence[str], tasks: int | None = None) -> DataFrame:
    """The rows of each key in one partition, by a hash of the keys.

    Not by the keys themselves: the planner leaves out a repartition by columns by which a join or a union of joins is dealt already. Nothing then
    holds adaptive execution to that deal, and it joins the partitions of each side of a union, or splits those of a join, by their sizes.
    """
    return df.repartition(*([tasks] if tasks else []), F.xxhash64(*keys))


def ordered_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], fold: Fold, schema: str | StructType, tasks: int | None = None) -> DataFrame:
    """Run ``fold(key, rows in order)`` for each key; it yields rows of ``schema``.

    The engine chooses the number of tasks by the size of the shuffle, unless ``tasks`` is given: states of repeated vectors weigh little there and much in Python.
    """
    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for start in range(0, b.num_rows, 1024) for r in b.slice(start, 1024).to_pylist())
        out: list[Row] = []
        for key, own in groupby(rows, key=lambda r: tuple(r[k] for k in keys)):
            for row in fold(key, own):
                out.append(row)
                if len(out) >= 1024:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out = []
            for _ in own:  # what the fold left
                pass
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return dealt(df, keys, tasks).sortWithinPartitions(*keys, *order).mapInArrow(run, kind)
