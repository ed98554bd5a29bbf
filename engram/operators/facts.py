"""Facts: verbatim texts with semantic dedup, spaced repetition and decay."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import physics, vectors
from ..sources.shared import staged
from .archetype import Trace
from .links import SLACK, groups_of
from .ordered import Row, ordered_fold

# Fixed values of the memory model.
THETA_DEDUP = 0.95
CONSOLIDATION = 0.1
DEFAULT_K = 3

HOT_ROWS = 20_000

SCHEMA = "seq bigint, subject string, text string, embedding array<double>, provenance string, created_at double, salience double, lambda double, reinforcement double, last_touch double"


class _Units:
    """Unit vectors of one length with the places of their facts, in a matrix that doubles as it fills."""

    def __init__(self, width: int):
        self.rows, self.places = np.zeros((8, width)), []

    def add(self, v: np.ndarray, place: int) -> None:
        if len(self.places) == len(self.rows):
            self.rows = np.vstack([self.rows, np.zeros_like(self.rows)])
        size = np.sqrt(v @ v)
        self.rows[len(self.places)] = v / size if size else v
        self.places.append(place)

    def nearest(self, v: np.ndarray) -> tuple[float, int]:
        """The best cosine and the place of its fact, the last of equals."""
        if not self.places:
            return -2.0, -1
        size = np.sqrt(v @ v)
        near = self.rows[: len(self.places)] @ (v / size if size else v)
        at = len(near) - 1 - int(near[::-1].argmax())
        return float(near[at]), self.places[at]


def remember(known: DataFrame | None, new: DataFrame, *, theta: float = THETA_DEDUP, hot: int = HOT_ROWS) -> DataFrame:
    """Facts after remembering ``new`` rows (seq, subject, text, embedding, provenance, tick, salience, halflife) in order.

    A row whose best match among the subject's facts is at least ``theta`` (the last of
    equals, faded or not) touches that fact and is discarded; else it is a new fact.
    Facts of another length than the row's match nothing.

    The rows of a subject are folded in order, in one task. A subject with more than ``hot`` rows is
    first cut into groups that may merge (see :mod:`links`): rows alone in their group are
    facts as they are, each other group is folded by itself, without copies, which are counted. The result is the same.
    """
    rows = new.select("seq", "subject", "text", vectors.as_double(F.col("embedding")).alias("embedding"), "provenance", F.col("tick").alias("created_at"), "salience", physics.lambda_from_halflife(F.col("halflife")).alias("lambda"), F.lit(0.0).alias("reinforcement"), F.col("tick").alias("last_touch"), F.lit(1).alias("_new"))
    if known is not None:
        rows = known.select(*(f.split()[0] for f in SCHEMA.split(", "))).withColumn("_new", F.lit(0)).unionByName(rows)

    if theta > 0:
        counts = rows.groupBy("subject").agg(F.count("*").alias("n")).where(F.col("n") > hot)
        if not counts.isEmpty():
            return _remember_hot(rows, counts.select("subject"), theta)
    return _folded(rows, ["subject"], theta)


def _remember_hot(rows: DataFrame, hot: DataFrame, theta: float) -> DataFrame:
    """Copies of a vector don't go through the folds: only the first can become a fact, the others touch the fact nearest to it at their time and are counted."""
    rows = staged(rows.withColumn("rid", F.monotonically_increasing_id()), "facts")
    many = rows.join(hot, "subject", "left_semi")
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    # Copies whose cosine to one another is surely above theta; a zero vector's is 0.
    alike = (F.col("_new") == 1) & vectors.norm(F.col("embedding")).between(1e-100, 1e100) & F.lit(theta <= 1 - SLACK)
    firsts = staged(many.where(alike).groupBy("subject", "embedding").agg(F.min("seq").alias("first"), F.count("*").alias("n")).where("n > 1"), "firsts")
    met = many.join(firsts.withColumn("_new", F.lit(1)), ["subject", "embedding", "_new"], "left")
    kept = staged(met.where("first IS NULL OR seq = first"), "kept")
    copies = met.where("seq > first").select("subject", "embedding", "seq", "created_at")
    groups = staged(groups_of(kept.select("rid", "subject", F.col("embedding").alias("v")), theta), "groups")
    placed = kept.join(groups, "rid", "left").withColumn("group", F.coalesce("group", F.when(F.col("first").isNotNull(), F.col("rid"))))
    alone = placed.where(F.col("group").isNull()).select(*names)
    found = staged(_told(placed.where(F.col("group").isNotNull()).drop("first", "n"), theta), "told")
    nearest = staged(_nearest_in_time(found, placed.where(F.col("first").isNotNull())), "nearest")
    counted = copies.join(nearest, ["subject", "embedding"]).where((F.col("seq") >= F.col("since")) & (F.col("seq") < F.col("until"))).groupBy("fact").agg(F.count("*").alias("more"), F.max("seq").alias("more_seq"), F.max_by("created_at", "seq").alias("more_at"))
    touched = _touched(found.join(counted, found["rid"] == counted["fact"], "left").drop("fact"))
    return alone.unionByName(touched).unionByName(_folded(rows.join(hot, "subject", "left_anti").drop("rid"), ["subject"], theta))


def _told(rows: DataFrame, theta: float) -> DataFrame:
    """The facts of each group as they began, with how many rows touched them, and the last of these."""

    def fold(key: tuple, own: Iterator[Row]) -> Iterator[Row]:
        facts: list[Row] = []
        units: dict[int, _Units] = {}  # by length
        for r in own:
            v = np.asarray(r["embedding"], float)
            same = units.setdefault(len(v), _Units(len(v)))
            best, at = same.nearest(v) if r["_new"] else (-2.0, -1)
            if at >= 0 and best >= theta:
                facts[at] |= {"touches": facts[at]["touches"] + 1, "touch_seq": r["seq"], "touch_at": r["created_at"]}
            else:
                same.add(v, len(facts))
                facts.append(r | {"touches": 0, "touch_seq": None, "touch_at": None})
        yield from facts

    return ordered_fold(rows, ["subject", "group"], ["_new", "seq"], fold, f"{SCHEMA}, rid bigint, group bigint, _new int, touches bigint, touch_seq bigint, touch_at double")


def _nearest_in_time(facts: DataFrame, firsts: DataFrame) -> DataFrame:
    """(subject, embedding, fact, since, until): the fact that a vector's copies touch from one ``seq`` on until another. A later fact counts from its own ``seq`` on, if it is as near."""
    columns = ["subject", "group", "embedding", "_new", "seq", "rid"]
    both = facts.select(*columns, F.lit(0).alias("kind")).unionByName(firsts.select(*columns, F.lit(1).alias("kind")))

    def fold(key: tuple, own: Iterator[Row]) -> Iterator[Row]:
        units: dict[int, _Units] = {}  # by length
        known: dict[int, list[tuple[int, int, int]]] = {}
        for r in own:
            v = np.asarray(r["embedding"], float)
            same, orders = units.setdefault(len(v), _Units(len(v))), known.setdefault(len(v), [])
            if r["kind"] == 0:
                same.add(v, len(orders))
                orders.append((r["_new"], r["seq"], r["rid"]))
                continue
            near = same.rows[: len(orders)] @ (v / np.sqrt(v @ v))
            best = np.flatnonzero(near >= np.maximum.accumulate(near)).tolist()  # each as near as all before it
            before = sum(orders[i][:2] <= (1, r["seq"]) for i in best)
            steps = best[max(before - 1, 0) :]
            since = [r["seq"], *(orders[i][1] for i in steps[1:])]
            for i, start, end in zip(steps, since, [*since[1:], 2**63 - 1], strict=True):
                yield {"subject": key[0], "embedding": r["embedding"], "fact": orders[i][2], "since": start, "until": end}

    return ordered_fold(both, ["subject", "group"], ["kind", "_new", "seq"], fold, "subject string, embedding array<double>, fact bigint, since bigint, until bigint")


def _touched(facts: DataFrame) -> DataFrame:
    """Facts after all their touches, by rows and by copies (``more``)."""

    def fold(key: tuple, own: Iterator[Row]) -> Iterator[Row]:
        for r in own:
            trace = Trace.of(r)
            last, at = max([(r[f"{x}_seq"], r[f"{x}_at"]) for x in ("touch", "more") if r[f"{x}_seq"] is not None], default=(None, None))
            for _ in range(r["touches"] + (r["more"] or 0)):
                trace.touch(at, CONSOLIDATION)
            yield r | trace.row()

    return ordered_fold(facts, ["rid"], [], fold, SCHEMA)


def _folded(rows: DataFrame, keys: list[str], theta: float) -> DataFrame:
    def fold(key: tuple, own: Iterator[Row]) -> Iterator[Row]:
        facts: list[Row] = []
        units: dict[int, _Units] = {}  # by length
        for r in own:
            v = np.asarray(r["embedding"], float)
            same = units.setdefault(len(v), _Units(len(v)))
            best, at = same.nearest(v) if r.pop("_new") else (-2.0, -1)
            if at >= 0 and best >= theta:
                trace = Trace.of(facts[at])
                trace.touch(r["created_at"], CONSOLIDATION)
                facts[at] |= trace.row()
            else:
                same.add(v, len(facts))
                facts.append(r)
        yield from facts

    return ordered_fold(rows, keys, ["_new", "seq"], fold, SCHEMA)


def living(facts: DataFrame, now: float, theta: float = physics.THETA_FADE) -> DataFrame:
    """Facts with a weight of at least ``theta``, and that weight."""
    w = physics.weight(now, F.col("salience"), F.col("lambda"), F.col("last_touch"), F.col("reinforcement"))
    return facts.withColumn("weight", w).where(F.col("weight") >= theta)


def fade(facts: DataFrame, now: float, theta: float = physics.THETA_FADE) -> DataFrame:
    """The facts that a sweep at ``now`` leaves."""
    return living(facts, now, theta).drop("weight")


def scored(facts: DataFrame, query: Column, now: float, theta: float = physics.THETA_FADE) -> DataFrame:
    """Living facts with ``score = max(0, cosine to the query) * weight``."""
    resonance = vectors.cosine(F.col("embedding"), query)
    rows = living(facts, now, theta).withColumn("resonance", resonance)
    return rows.withColumn("score", F.greatest(F.col("resonance"), F.lit(0.0)) * F.col("weight"))


def search(facts: DataFrame, query: list[float], now: float, k: int = DEFAULT_K, *, subject: str | None = None, theta: float = physics.THETA_FADE) -> DataFrame:
    """The k best facts of a subject (or of each subject) for one query; facts of score 0 are returned too."""
    own = facts if subject is None else facts.where(F.col("subject") == subject)
    rows = scored(own, F.lit([float(x) for x in query]), now, theta)
    if subject is not None:
        return rows.orderBy(F.desc("score"), "seq").limit(k)
    rank = F.row_number().over(Window.partitionBy("subject").orderBy(F.desc("score"), "seq"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def reinforce(facts: DataFrame, ids: DataFrame, now: float, consolidation: float = CONSOLIDATION) -> DataFrame:
    """The facts with those in ``ids`` (seq) touched at ``now``."""
    hit = facts.join(ids.select("seq").distinct().withColumn("_hit", F.lit(True)), "seq", "left")
    touched = F.coalesce("_hit", F.lit(False))
    r = F.col("reinforcement")
    return hit.withColumns({
        "lambda": F.when(touched, F.greatest(F.col("lambda") * (1 - consolidation), F.lit(physics.LAMBDA_FLOOR))).otherwise(F.col("lambda")),
        "reinforcement": F.when(touched, r + 1.0 / (1.0 + r)).otherwise(r), "last_touch": F.when(touched, F.lit(now)).otherwise(F.col("last_touch")),
    }).drop("_hit").select(*facts.columns)


def pack_budget(rows: DataFrame, budget: int | str) -> DataFrame:
    """Greedy knapsack per subject: by score falling (then ``seq``), skip what no longer fits, and go on.

    ``rows`` has subject, seq, score, cost; ``budget`` is a number or a column's name. Rows
    are streamed in order, so a subject with very many facts needs no more memory.
    """
    limit = F.lit(budget) if isinstance(budget, int) else F.col(budget)
    ranked = rows.select("subject", "seq", "score", F.negative("score").alias("_order"), "cost", limit.cast("long").alias("_budget"))

    def fold(key: tuple, own: Iterator[Row]) -> Iterator[Row]:
        left = None
        for r in own:
            left = r["_budget"] if left is None else left
            if r["cost"] <= left:
                left -= r["cost"]
                yield {"subject": r["subject"], "seq": r["seq"], "score": r["score"], "cost": r["cost"], "left": left}

    return ordered_fold(ranked, ["subject"], ["_order", "seq"], fold, "subject string, seq bigint, score double, cost bigint, left bigint")
