"""Lazy breaths: a cycle touches only the subjects whose living perceptions have changed.

A subject whose living set is the same as in the cycle before would be given the same
intention vector again. Such cycles are left open and made up when the subject is
next touched or read: its old living set is distilled once, and the vector is
absorbed at the tick of each open cycle. The result equals that of breathing every time.

Which subjects change is read from the calendar: perceptions are kept by the week they
expire and by the breath before which they came, so a breath reads what arrived since
the last one and what expires between the two, and of these subjects the living rows. It
writes a row for each changed subject, beside the earlier ones; the newest counts.

A perception is alive in cycle c (counted from 1) if it came before that breath and its
``tick`` and ``expires_at`` enclose the breath's tick. Rows without an expiry never are.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import physics
from ..sources.ingest import SCHEMA as PERCEPTIONS
from .archetype import SCHEMA, Archetype
from .consolidate import cycles_of, state_tasks
from .ordered import Row, ordered_fold

WEEK = 7 * physics.DAY

#: ``upto``: cycles that the row has made up.
STORED = f"{SCHEMA}, upto int"


def alive_in(cycle: int, ticks: list[float]) -> Column:
    """Whether a perception (with ``since``, the breaths before it came) is alive in a cycle; in cycle 0 nothing is."""
    if cycle < 1:
        return F.lit(False)
    now = ticks[cycle - 1]
    return F.coalesce((F.col("since") < cycle) & (F.col("tick") <= now) & (F.col("expires_at") >= now), F.lit(False))


def changed_subjects(perceptions: DataFrame, ticks: list[float]) -> DataFrame:
    """Subjects whose living set differs between the last cycle and the one before."""
    k, now = len(ticks), ticks[-1]
    before = ticks[-2] if k > 1 else float("-inf")
    came = F.col("since") == k - 1
    began = (F.col("tick") > before) & (F.col("tick") <= now)
    ended = (F.col("expires_at") >= before) & (F.col("expires_at") < now)
    return perceptions.where(came | began | ended).where(alive_in(k, ticks) != alive_in(k - 1, ticks)).select("subject").distinct()


def _made_up(archetypes: DataFrame, perceptions: DataFrame, ticks: list[float], resilience: str, last: bool) -> DataFrame:
    """Archetypes of the subjects of ``perceptions``: open cycles made up, with the last cycle's own living set if ``last``."""
    k = len(ticks)
    sets = [(k - 1, 0), (k, 1)] if last else [(k, 0)]
    rows = None
    for cycle, tag in sets:
        own = perceptions.where(alive_in(cycle, ticks)).withColumn("cycle", F.lit(tag))
        rows = own if rows is None else rows.unionByName(own)
    vectors_ = cycles_of(rows, F.lit(0.0))
    iv = F.struct(*[c for c in vectors_.columns if c not in ("subject", "cycle")])
    found = vectors_.groupBy("subject").agg(F.max_by(iv, F.when(F.col("cycle") == 0, 1)).alias("before"), F.max_by(iv, F.when(F.col("cycle") == 1, 1)).alias("now"))
    names = [f.split()[0] for f in SCHEMA.replace("<", " <").split(", ")]
    old = archetypes.select("subject", F.struct(*[c for c in archetypes.columns if c in names or c == "upto"]).alias("old"))
    open_until = k - 1 if last else k

    def fold(key: tuple, own: Iterator[Row]) -> Iterator[Row]:
        for r in own:
            state = Archetype.of(r["old"]) if r["old"] else Archetype(key[0])
            done = r["old"]["upto"] if r["old"] else open_until
            if r["before"]:
                for cycle in range(done + 1, open_until + 1):
                    state.absorb(r["before"], ticks[cycle - 1], resilience)
            if last and r["now"]:
                state.absorb(r["now"], ticks[-1], resilience)
            if state.trace is not None:
                yield state.row() | {"upto": k}

    return ordered_fold(old.join(found, "subject", "full_outer"), ["subject"], [], fold, STORED, state_tasks(perceptions.sparkSession))


def lazy_breath(archetypes: DataFrame, perceptions: DataFrame, ticks: list[float], *, resilience: str = "high") -> DataFrame:
    """The rows that the breath at ``ticks[-1]`` rewrites: one for each changed subject. ``ticks`` are those of all breaths."""
    changed = changed_subjects(perceptions, ticks)
    return _made_up(archetypes.join(changed, "subject", "left_semi"), perceptions.join(changed, "subject", "left_semi"), ticks, resilience, last=True)


def caught_up(archetypes: DataFrame, perceptions: DataFrame, ticks: list[float], *, resilience: str = "high") -> DataFrame:
    """The archetypes with all open cycles made up, for reading."""
    behind = archetypes.where(F.col("upto") < len(ticks))
    alive = perceptions.where(alive_in(len(ticks), ticks)).join(behind.select("subject"), "subject", "left_semi")
    current = archetypes.where(F.col("upto") >= len(ticks))
    return current.unionByName(_made_up(behind, alive, ticks, resilience, last=False)).drop("upto")


class LazyMemory:
    """Perceptions and archetypes in a folder that all executors share, with lazy breaths.

    ``perceptions/since=s/due=d`` holds what came after s breaths and expires in week d, ``archetypes/cycle=k``
    what breath k rewrote, ``ticks`` the tick of each breath. A breath counts once its tick is
    written, after its rows; one that failed before is run again and replaces what it left.
    """

    def __init__(self, spark: SparkSession, folder: str, *, resilience: str = "high"):
        self.spark, self.folder, self.resilience = spark, folder.rstrip("/"), resilience
        found = self._read("ticks", "cycle int, tick double")
        self.ticks: list[float] = [r.tick for r in found.orderBy("cycle").collect()]

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def perceptions(self) -> DataFrame:
        return self._read("perceptions", f"{PERCEPTIONS}, since int, due int")

    def stored(self) -> DataFrame:
        """The newest row of each subject among breaths that count."""
        rows = self._read("archetypes", f"{STORED}, cycle int").where(F.col("cycle") <= len(self.ticks))
        newest = F.row_number().over(Window.partitionBy("subject").orderBy(F.desc("cycle")))
        return rows.withColumn("_r", newest).where("_r = 1").drop("_r", "cycle")

    def perceive(self, rows: DataFrame) -> None:
        """Take in perceptions, by the week they expire."""
        due = F.coalesce(F.floor(F.col("expires_at") / WEEK), F.lit(-1)).cast("int")
        kept = rows.select(*(f.split()[0] for f in PERCEPTIONS.split(", "))).withColumn("due", due)
        kept.repartition("due").sortWithinPartitions("due", "expires_at").write.mode("append").partitionBy("due").parquet(f"{self.folder}/perceptions/since={len(self.ticks)}")

    def breathe(self, now: float) -> int:
        """One breath; the number of rows it wrote."""
        if self.ticks and now < self.ticks[-1]:
            raise ValueError("time doesn't run backwards")
        ticks = [*self.ticks, now]
        path = f"{self.folder}/archetypes/cycle={len(ticks)}"
        known = self.perceptions().where(F.col("due") >= int((self.ticks[-1] if self.ticks else 0.0) // WEEK))  # earlier weeks are over
        lazy_breath(self.stored(), known, ticks, resilience=self.resilience).write.mode("overwrite").parquet(path)
        tick = self.spark.createDataFrame([(len(ticks), float(now))], "cycle int, tick double")
        tick.coalesce(1).write.mode("append").parquet(f"{self.folder}/ticks")
        self.ticks = ticks
        return self.spark.read.schema(STORED).parquet(path).count()

    def archetypes(self, subject: str | None = None) -> DataFrame:
        """All archetypes (or one) as after the last breath."""
        if not self.ticks:
            return self.spark.createDataFrame([], SCHEMA)
        stored, known = self.stored(), self.perceptions().where(F.col("due") >= int(self.ticks[-1] // WEEK))
        if subject is not None:
            stored, known = stored.where(F.col("subject") == subject), known.where(F.col("subject") == subject)
        return caught_up(stored, known, self.ticks, resilience=self.resilience)
