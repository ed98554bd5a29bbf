"""Breaths over streams: by time, by pressure, and per-subject state with expiry.

A breath is a consolidation cycle. By time, micro-batches are aggregated per day of
event time; by pressure, a cycle runs once enough perceptions are pending.
Late rows are taken in order of arrival; elapsed time never counts below 0.
"""

from __future__ import annotations

import math
import time
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import physics
from ..sources import fixtures as fx
from ..operators.archetype import SCHEMA as ARCHETYPES
from ..sources.ingest import SCHEMA as PERCEPTIONS
from ..sources.store import is_folder, shared_folder

# Defaults of the runtime.
BREATH_SECONDS, WATERMARK, QUEUE = 60.0, 256, 1024

# The names of the metrics. Names of counters end in "total".
METRICS = {
    "breaths_total": "Cycles run so far, of any cause.",
    "breaths_basal_total": "Cycles begun by the clock.",
    "breaths_pressure_total": "Cycles begun because enough was pending.",
    "breaths_ondemand_total": "Cycles begun by a call.",
    "distilled_subjects_total": "Subjects taken up by cycles, each time anew.",
    "perceptions_absorbed_total": "Perceptions taken into archetypes, each time anew.",
    "faded_total": "Perceptions forgotten.",
    "pending": "Perceptions that no cycle has seen yet.",
    "short_term_len": "Perceptions held.",
    "long_term_len": "Archetypes held.",
}


@dataclass
class Stats:
    breaths: int = 0
    breaths_basal: int = 0
    breaths_pressure: int = 0
    breaths_ondemand: int = 0
    distilled_subjects: int = 0
    perceptions_absorbed: int = 0
    faded: int = 0
    pending: int = 0
    short_term_len: int = 0
    long_term_len: int = 0

    def add(self, cause: str, distilled: int, absorbed: int, faded: int) -> None:
        self.breaths += 1
        setattr(self, f"breaths_{cause}", getattr(self, f"breaths_{cause}") + 1)
        self.distilled_subjects += distilled
        self.perceptions_absorbed += absorbed
        self.faded += faded

    def prometheus(self, prefix: str = "engram") -> str:
        """Text exposition: help, type and value of each metric."""
        values, out = asdict(self), []
        for name, said in METRICS.items():
            kind = "counter" if name.endswith("_total") else "gauge"
            out += [f"# HELP {prefix}_{name} {said}", f"# TYPE {prefix}_{name} {kind}", f"{prefix}_{name} {values[name.removesuffix('_total')]}"]
        return "\n".join(out) + "\n"


def enqueue(rows: DataFrame, folder: str, queue: int = QUEUE) -> None:
    """Put arrivals into a folder for a stream to read, in files of at most ``queue`` rows.

    A stream takes a file a trigger, so no batch admits more rows than that, however many are
    waiting; what waits is on shared storage, and a producer never waits for the stream.
    """
    rows.write.mode("append").option("maxRecordsPerFile", queue).parquet(folder)


def event_stream(spark: SparkSession, path: str, files_per_trigger: int | None = 1) -> DataFrame:
    """Perceptions of a growing event table, a file at a time (see :func:`enqueue`), or with none all that wait."""
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        source = source.option("maxFilesPerTrigger", files_per_trigger)
    if not is_folder(spark, path):  # a stream watches a folder: here that of the one file
        path, _, name = path.rpartition("/")
        source = source.option("pathGlobFilter", name)
    return fx.perceptions_of(source.parquet(path))


def _drained(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream until its source has no more, and give back its result, or all its updates with their ``batch``.

    Batches are written to the shared folder, each to a folder of its own that a repeated batch replaces.
    """
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")

    run = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    if run.exception() is not None:
        raise run.exception()
    found = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{folder}/out")
    return found if mode == "update" else found.where(F.col("batch") == found.agg(F.max("batch")).first()[0]).drop("batch")


def basal(perceptions: DataFrame, span: float = fx.CYCLE_SECONDS) -> DataFrame:
    """Arrivals by the basal breath that first sees them, in batch or streaming."""
    breath = F.greatest(F.lit(1), F.ceil(F.col("tick") / span)).cast("int")
    return perceptions.groupBy(breath.alias("breath")).agg(F.count("*").alias("arrived"))


def stream_basal(spark: SparkSession, path: str) -> DataFrame:
    return _drained(basal(event_stream(spark, path)), "complete")


def pressure(perceptions: DataFrame, watermark: int = WATERMARK) -> DataFrame:
    """Arrivals by the breath that their number brings on; ``seq`` counts arrivals. In batch or streaming."""
    breath = F.floor(F.col("seq") / watermark)
    return perceptions.groupBy(breath.alias("breath")).agg(F.count("*").alias("arrived"), F.round(F.max("tick"), 3).alias("tick"))


def stream_by_pressure(spark: SparkSession, path: str) -> DataFrame:
    return _drained(pressure(event_stream(spark, path)), "complete")


def living(perceptions: DataFrame, now: float) -> DataFrame:
    """(subject, living, weight) of the perceptions that live at ``now``, in batch or streaming.

    What has come after ``now`` or faded by then never enters the state, which is a number and a sum for each subject.
    """
    rows = perceptions.where((F.col("tick") <= now) & (F.col("expires_at") >= now))
    w = physics.weight(now, F.col("salience"), F.col("lambda"), F.col("tick"))
    return rows.groupBy("subject").agg(F.count("*").alias("living"), F.round(F.sum(w), 6).alias("weight"))


def stream_living(spark: SparkSession, path: str, now: float) -> DataFrame:
    """Living perceptions per subject after the stream ran dry; the last state of each subject counts."""
    return _drained(living(event_stream(spark, path), now), "update").groupBy("subject").agg(F.max_by("living", "batch").alias("living"), F.max_by("weight", "batch").alias("weight"))


BUCKETS = 2048  # of subjects, each with one state

_EXPIRING = "subjects array<string>, expires array<double>"
_LEFT = "subject string, living bigint"


def _expire(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keeps when the perceptions of a bucket of subjects expire; a timer at the next of these drops it once event time has come there.

    A call costs the same for one subject as for hundreds, hence buckets. Subjects with arrivals or losses are given out.
    """
    subjects, expires = (list(x) for x in state.get) if state.exists else ([], [])
    known = len(subjects)
    for b in batches:
        subjects += b["subject"].tolist()
        expires += b["expires"].tolist()
    now = state.getCurrentWatermarkMs()
    held = [(s, x) for s, x in zip(subjects, expires, strict=True) if x * 1000 >= now]
    told = dict.fromkeys(subjects[known:]) | dict.fromkeys(s for s, x in zip(subjects, expires, strict=True) if x * 1000 < now)
    if held:
        state.update(([s for s, _ in held], [x for _, x in held]))
        state.setTimeoutTimestamp(max(int(min(x for _, x in held) * 1000) + 1, now + 1))
    elif state.exists:
        state.remove()
    left = Counter(s for s, _ in held)
    yield pd.DataFrame({"subject": pd.Series(list(told), dtype=object), "living": pd.Series([left[s] for s in told], dtype="int64")})


def expiring(perceptions: DataFrame, lateness: str = "0 seconds") -> DataFrame:
    """Updates (subject, living) of a stream: with each arrival, and when event time passes an expiry.

    State holds living perceptions only. Rows later than ``lateness`` are left out, as everywhere behind a watermark.
    """
    epoch = lambda c: F.col(c) + fx.EPOCH_START
    rows = perceptions.where(F.col("expires_at").isNotNull()).select("subject", epoch("tick").cast("timestamp").alias("at"), epoch("expires_at").alias("expires"))
    rows = rows.withWatermark("at", lateness).withColumn("bucket", F.pmod(F.xxhash64("subject"), F.lit(BUCKETS)))
    return rows.groupBy("bucket").applyInPandasWithState(_expire, _LEFT, _EXPIRING, "update", GroupStateTimeout.EventTimeTimeout)


def stream_expiry(spark: SparkSession, path: str, lateness: str = "0 seconds") -> DataFrame:
    """Perceptions per subject that live when event time, less the lateness that is allowed, has come to the stream's end."""
    last = _drained(expiring(event_stream(spark, path), lateness), "update").groupBy("subject").agg(F.max_by("living", "batch").alias("living"))
    return last.where("living > 0")


class BreathingStream:
    """A stream of perceptions that breathes by pressure or by the clock.

    A batch is appended; once ``watermark`` rows are pending, or ``span`` seconds have
    passed with any, it brings on a breath, which replaces archetypes and perceptions in
    the same commit. The commit also holds the batch's number, the pending rows and the counters, so a
    batch that is tried again after a failure counts once, and another driver on the same
    store counts on from there. Clock ticks that were missed are skipped.
    """

    def __init__(self, store, stats: Stats | None = None, *, watermark: int = WATERMARK, span: float | None = None, clock: Callable[[], float] = time.monotonic):
        self.store, self.watermark, self.span, self.clock = store, watermark, span, clock
        self.stats = stats if stats is not None else self._stored()
        self.next_tick = None if span is None else clock() + span

    def _stored(self) -> Stats:
        """The counters of the store, and its sizes."""
        sizes = {"short_term_len": self.store.read("perceptions", PERCEPTIONS).count(), "long_term_len": self.store.read("archetypes", ARCHETYPES).count()}
        return Stats(**self.store.marks().get("stats", {}) | sizes)

    def _is_due(self) -> bool:
        if self.next_tick is None or (now := self.clock()) < self.next_tick:
            return False
        self.next_tick += self.span * (math.floor((now - self.next_tick) / self.span) + 1)
        return True

    def breathe(self, batch: DataFrame, batch_id: int) -> None:
        """Take in one batch of the stream."""
        marks = self.store.marks()
        if marks.get("batch", -1) >= batch_id:
            return
        batch = batch.select(*(f.split()[0] for f in PERCEPTIONS.split(", "))).persist()
        try:
            pending, due = marks.get("pending", 0) + batch.count(), self._is_due()
            cause = "pressure" if pending >= self.watermark else "basal" if due and pending else None
            self._take(batch, cause, {"batch": batch_id}, pending)
        finally:
            batch.unpersist()

    def breathe_now(self) -> None:
        """A breath on demand."""
        self._take(None, "ondemand", {}, 0)

    def _take(self, batch: DataFrame | None, cause: str | None, marks: dict, pending: int) -> None:
        from ..operators import consolidate

        known = self.store.read("perceptions", PERCEPTIONS)
        if cause is None:
            told = replace(self.stats, pending=pending, short_term_len=known.count() + batch.count())
            self.store.commit(appended={"perceptions": batch}, marks=marks | {"pending": pending, "stats": asdict(told)})
            self._tell(told)
            return
        known = known if batch is None else known.unionByName(batch)
        now = known.agg(F.max("tick")).first()[0]
        if now is None:
            return
        old = self.store.read("archetypes", ARCHETYPES) if self.store.version("archetypes") else None
        alive, left = (F.col("tick") <= now) & (F.col("expires_at") >= now), consolidate.sweep(known, now)
        held = known.select("subject", alive.alias("alive"), physics.is_faded(now, F.col("expires_at")).alias("faded"))
        total, kept, absorbed, subjects = held.agg(F.count("*"), F.count_if(~F.col("faded")), F.count_if("alive"), F.countDistinct(F.when(F.col("alive"), F.col("subject")))).first()
        told = replace(self.stats, pending=0, short_term_len=kept)
        told.add(cause, subjects, absorbed, total - kept)
        self.store.commit({"archetypes": consolidate.breathe(old, known, now), "perceptions": left}, marks=marks | {"pending": 0, "stats": asdict(told)})
        told.long_term_len = self.store.read("archetypes", ARCHETYPES).count()
        self._tell(told)

    def _tell(self, told: Stats) -> None:
        """Show what has been committed, in the object that others may hold."""
        for name, value in asdict(told).items():
            setattr(self.stats, name, value)

    def start(self, stream: DataFrame, checkpoint: str, every: float | None = None):
        """Run until drained, or with ``every`` seconds between batches."""
        writer = stream.writeStream.foreachBatch(self.breathe).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=f"{every} seconds")).start()
