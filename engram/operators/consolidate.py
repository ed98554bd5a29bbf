"""Breathing: consolidation cycles over perceptions, all at once or one at a time."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..functions import physics, vectors
from .archetype import SCHEMA, Archetype
from .distill import INTENTION, THETA_ANOMALY, THETA_REDUNDANCY, Leaders, cluster_modes, ranked_labels
from .ordered import Row, dealt, ordered_fold


ROWS_A_TASK = 500_000


def state_tasks(spark: SparkSession) -> int:
    """The number of tasks that fold archetypes; for all cores, and more, so that none holds many."""
    return 2 * spark.sparkContext.defaultParallelism


def _in_order(live: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of each subject by cycle and arrival, after a row with the cycle's centroid (summed before, map-side first).

    Rows without a vector don't take part. Tasks grow in number with the rows, which are counted first: their compressed size in the shuffle
    says little about the memory that a task's sort takes.
    """
    live = live.where(F.col("embedding").isNotNull())
    tasks = max(1, live.sparkSession.sparkContext.defaultParallelism, math.ceil(live.count() / ROWS_A_TASK))
    marks = vectors.centroids(live, keys).select(*keys, F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("seq"), F.col("centroid").alias("v"), F.lit(None).cast("string").alias("label"))
    rows = live.select(*keys, F.lit(1).alias("kind"), F.col("seq").cast("bigint").alias("seq"), vectors.as_double(F.col("embedding")).alias("v"), "label")
    return dealt(marks.unionByName(rows), ["subject"], tasks).sortWithinPartitions(*keys, "kind", "seq")


class _Cycle:
    """The intention vector of one cycle, from its centroid and then its rows in order."""

    def __init__(self, centroid: np.ndarray):
        self.centroid, self.size = centroid, float(np.sqrt(centroid @ centroid))
        self.absorbed = self.redundant = 0
        self.anomalies: list[list[float]] = []
        self.anomaly_labels: list[str] = []
        self.labels: Counter = Counter()
        self.leaders = Leaders()

    def add(self, rows: list[np.ndarray], labels: list[str | None]) -> None:
        for same in _alike(rows):
            x = np.stack([rows[i] for i in same])
            n = min(x.shape[1], len(self.centroid))
            sizes = np.sqrt(np.einsum("ij,ij->i", x, x))
            both = sizes * self.size
            near = np.divide(x[:, :n] @ self.centroid[:n], both, out=np.zeros(len(x)), where=both > 0)
            redundant = near >= THETA_REDUNDANCY
            self.redundant += int(redundant.sum())
            for k in np.flatnonzero(~redundant & (near <= THETA_ANOMALY)).tolist():
                self.anomalies.append(x[k].tolist())
                self.anomaly_labels.append(labels[same[k]])
            for k, i in enumerate(same):
                self.leaders.add(x[k], labels[i], float(sizes[k]))
        self.absorbed += len(rows)
        self.labels.update(x for x in labels if x)

    def row(self) -> Row:
        ranked = ranked_labels(self.labels)
        return {
            "centroid": self.centroid.tolist(), "absorbed": self.absorbed, "redundant": self.redundant, "anomalies": self.anomalies, "anomaly_labels": self.anomaly_labels,
            "label_histogram": ranked, "core_label": ranked[0]["label"] if ranked else "", "seeds": list(self.leaders.seeds()),
        }


def _alike(rows: list[np.ndarray]) -> Iterator[list[int]]:
    """Runs of rows of one length."""
    start = 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or len(rows[i]) != len(rows[start]):
            yield list(range(start, i))
            start = i


def _cycles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Row]]:
    """(subject, cycle, intention vector) of each cycle; memory holds one cycle's state, never its rows."""
    key, state = None, None
    for batch in batches:
        subject, cycle, kind, label = (batch.column(c).to_pylist() for c in ("subject", "cycle", "kind", "label"))
        v = batch.column("v")
        flat, ends = v.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(v.value_lengths().fill_null(0))]).tolist()
        at, n = 0, batch.num_rows
        while at < n:
            here = (subject[at], cycle[at])
            if kind[at] == 0:
                if state is not None:
                    yield (*key, state.row())
                key, state = here, _Cycle(flat[ends[at] : ends[at + 1]].copy())
                at += 1
                continue
            if here != key:  # a cycle of vectors of several lengths has no centroid and is left out
                at += 1
                continue
            stop = at
            while stop < n and kind[stop] and (subject[stop], cycle[stop]) == here:
                stop += 1
            state.add([flat[ends[i] : ends[i + 1]] for i in range(at, stop)], label[at:stop])
            at = stop
    if state is not None:
        yield (*key, state.row())


def _written(rows: Iterator[Row], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, 512)):
        yield pa.RecordBatch.from_pylist(some, schema=schema)


def cycles_of(live: DataFrame, tick: Column) -> DataFrame:
    """Intention vectors with seeds per (subject, cycle), from rows alive in each cycle, in one ordered pass."""
    schema = _parse_datatype_string(f"subject string, cycle int, {INTENTION}")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _written(({"subject": s, "cycle": c} | iv for s, c, iv in _cycles(batches)), arrow)

    return _in_order(live, ["subject", "cycle"]).mapInArrow(run, schema).withColumn("tick", tick)


def replay(live: DataFrame, span: float, resilience: str = "high") -> DataFrame:
    """Archetypes after all cycles of ``live`` rows (subject, cycle, seq, embedding, label), in the same ordered pass."""
    schema = _parse_datatype_string(SCHEMA)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[Row]:
            for subject, own in groupby(_cycles(batches), key=lambda x: x[0]):
                state = Archetype(subject)
                for _, cycle, iv in own:
                    state.absorb(iv, cycle * span, resilience)
                yield state.row()

        yield from _written(rows(), arrow)

    return _in_order(live, ["subject", "cycle"]).mapInArrow(run, schema)


def breathe(archetypes: DataFrame | None, perceptions: DataFrame, now: float, *, resilience: str = "high", theta: float = physics.THETA_FADE, where: Column | None = None, subjects: list[str] | None = None) -> DataFrame:
    """Archetypes after one cycle at ``now``: living perceptions (that pass ``where``) are distilled and imprinted.

    Perceptions stay, and are absorbed again by later cycles until they fade.
    """
    live = perceptions.where((F.col("tick") <= now) & (F.col("expires_at") >= now))
    if subjects is not None:
        live = live.where(F.col("subject").isin(subjects))
    if where is not None:
        live = live.where(where)
    fresh = cycles_of(live.withColumn("cycle", F.lit(0)), F.lit(now)).drop("cycle")
    rows = fresh.select("subject", F.lit(1).alias("kind"), F.struct(*[c for c in fresh.columns if c != "subject"]).alias("iv"))
    if archetypes is not None:  # each before its intention vector: one shuffle, no join
        rows = archetypes.select("subject", F.lit(0).alias("kind"), F.struct(*archetypes.columns).alias("old")).unionByName(rows, allowMissingColumns=True)

    def fold(key: tuple, own: Iterator[Row]) -> Iterator[Row]:
        state = Archetype(key[0])
        for r in own:
            if r["kind"] == 0:
                state = Archetype.of(r["old"])
            else:
                state.absorb(r["iv"], r["iv"]["tick"], resilience)
        yield state.row()

    return ordered_fold(rows, ["subject"], ["kind"], fold, SCHEMA, state_tasks(perceptions.sparkSession))


def sweep(perceptions: DataFrame, now: float, drop_if: Column | None = None) -> DataFrame:
    """FADE: the perceptions left after dropping those below the threshold, or all that match ``drop_if``."""
    return perceptions.where(~drop_if if drop_if is not None else ~physics.is_faded(now, F.col("expires_at")))


def breath_report(perceptions: DataFrame, ticks: list[float]) -> DataFrame:
    """Per cycle tick: subjects distilled, perceptions absorbed, and perceptions swept since the last cycle."""
    first, step = ticks[0], (ticks[1] - ticks[0]) if len(ticks) > 1 else 1.0
    last = len(ticks)
    seen = F.greatest(F.lit(1), F.ceil((F.col("tick") - first) / step) + 1).cast("int")
    gone = F.when(F.col("expires_at").isNull(), seen).otherwise(F.greatest(seen, F.floor((F.col("expires_at") - first) / step + 2).cast("int")))
    rows = perceptions.select("subject", seen.alias("seen"), gone.alias("gone")).where(F.col("seen") <= last)
    absorbed = rows.where("gone > seen").select("subject", F.explode(F.sequence("seen", F.least(F.col("gone") - 1, F.lit(last)))).alias("cycle")).groupBy("cycle").agg(F.countDistinct("subject").alias("distilled_subjects"), F.count("*").alias("perceptions_absorbed"))
    faded = rows.where(F.col("gone") <= last).groupBy(F.col("gone").alias("cycle")).agg(F.count("*").alias("faded"))
    every = perceptions.sparkSession.range(1, last + 1).select(F.col("id").cast("int").alias("cycle"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return every.join(absorbed, "cycle", "left").join(faded, "cycle", "left").select("cycle", zero("distilled_subjects"), zero("perceptions_absorbed"), zero("faded"))


def predictive_compression(events: DataFrame, fraction: float = 0.7) -> DataFrame:
    """Per subject: how well modes and the centroid of the first part resonate with the rest.

    The split is at ``round(n * fraction)``, at least 1 and at most n - 1.
    """
    order = Window.partitionBy("subject").orderBy("seq")
    placed = events.withColumns({"_i": F.row_number().over(order), "_n": F.count("*").over(Window.partitionBy("subject"))}).where("_n > 1")
    cut = F.greatest(F.lit(1), F.least(F.floor(F.col("_n") * F.lit(fraction) + 0.5), F.col("_n") - 1))
    placed = placed.withColumn("_train", F.col("_i") <= cut)
    known, held = placed.where("_train"), placed.where(~F.col("_train"))
    model = vectors.centroids(known, ["subject"]).join(cluster_modes(known, ["subject"]), "subject")
    q = F.col("embedding")
    by_mode = F.array_max(F.transform("seeds", lambda s: vectors.cosine(s["centroid"], q)))
    rows = held.join(model, "subject").select("subject", by_mode.alias("m"), vectors.cosine(F.col("centroid"), q).alias("c"))
    return rows.groupBy("subject").agg(F.avg("m").alias("modal"), F.avg("c").alias("centroid"), F.count("*").alias("held_out"))


