"""Archetypes: the incremental aggregate of a subject's cycles.

The core, the volume, the trace and the arc have closed forms (weighted means,
sums, counts), used for analytics over all cycles at once. Modes depend on the
order of cycles and are kept by a fold with bounded state per subject.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import physics
from .distill import HISTOGRAM, THETA_MODE, ranked_labels
from .ordered import Row

# Fixed values of the memory model.
CONSOLIDATION = 0.1
IMPRINT_CONSOLIDATION = {"high": 0.2, "medium": 0.1, "low": 0.05, None: 0.05}

TRACE = "salience double, lambda double, reinforcement double, last_touch double"
_TRACE = "salience:double,lambda:double,reinforcement:double,last_touch:double"
MODE = f"struct<centroid:array<double>,origin:array<double>,label:string,label_histogram:{HISTOGRAM},absorbed:bigint,{_TRACE}>"
MILESTONE = f"struct<tick:double,direction:array<double>,absorbed:bigint,label:string,label_histogram:{HISTOGRAM}>"
SCHEMA = f"subject string, core array<double>, core_label string, anomalies array<array<double>>, anomaly_labels array<string>, represented bigint, arc array<{MILESTONE}>, modes array<{MODE}>, {TRACE}"


@dataclass
class Trace:
    salience: float
    lam: float
    reinforcement: float
    last_touch: float

    def touch(self, now: float, consolidation: float) -> None:
        self.last_touch = now
        self.reinforcement += 1 / (1 + self.reinforcement)
        self.lam = max(self.lam * (1 - consolidation), physics.LAMBDA_FLOOR)

    def weight(self, now: float) -> float:
        return self.salience * float(np.exp(-self.lam * max(now - self.last_touch, 0.0))) * (1 + self.reinforcement)

    def row(self) -> Row:
        return {"salience": self.salience, "lambda": self.lam, "reinforcement": self.reinforcement, "last_touch": self.last_touch}

    @classmethod
    def of(cls, r: Row) -> Trace:
        return cls(r["salience"], r["lambda"], r["reinforcement"], r["last_touch"])


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    n = min(len(a), len(b))
    both = float(np.sqrt(a @ a) * np.sqrt(b @ b))
    return float(a[:n] @ b[:n]) / both if both else 0.0


def cosines(rows: list, v: np.ndarray) -> np.ndarray:
    """The cosine of each row to ``v``."""
    if any(len(r) != len(v) for r in rows):
        return np.array([cosine(np.asarray(r, float), v) for r in rows])
    x = np.array(rows, float).reshape(len(rows), -1)
    both = np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(v @ v)
    return np.divide(x @ v, both, out=np.zeros(len(x)), where=both > 0)


@dataclass
class Archetype:
    """State of one subject: created by its first cycle, evolved by each later one."""

    subject: str
    core: np.ndarray | None = None
    core_label: str = ""
    anomalies: list = field(default_factory=list)
    anomaly_labels: list[str] = field(default_factory=list)
    represented: int = 0
    arc: list[Row] = field(default_factory=list)
    modes: list[Row] = field(default_factory=list)
    trace: Trace | None = None

    def absorb(self, iv: Row, now: float, resilience: str = "high") -> None:
        """One cycle's intention vector."""
        centroid = np.asarray(iv["centroid"], float)
        if self.trace is None:
            self.core = centroid
            halflife = physics.RESILIENCE_HALFLIFE[resilience]
            self.trace = Trace(1.0, physics.lambda_from_halflife(halflife), 0.0, now)
            self.modes = [self._mode(s, self.trace.lam, now) for s in iv["seeds"]]
        else:
            if len(self.core) == len(centroid) and self.represented + iv["absorbed"]:
                share = iv["absorbed"] / (self.represented + iv["absorbed"])
                self.core = self.core * (1 - share) + centroid * share
            for seed in iv["seeds"]:
                self._join_or_add(seed, now)
            self.trace.touch(now, CONSOLIDATION)
        self.represented += iv["absorbed"]
        self.core_label = iv["core_label"]
        self.anomalies += iv["anomalies"]
        self.anomaly_labels += iv["anomaly_labels"]
        self.arc.append({"tick": now, "direction": centroid.tolist(), "absorbed": iv["absorbed"], "label": iv["core_label"], "label_histogram": iv["label_histogram"]})

    @staticmethod
    def _mode(seed: Row, lam: float, now: float) -> Row:
        return {"centroid": list(seed["centroid"]), "origin": list(seed["centroid"]), "label": seed["label"], "label_histogram": seed["label_histogram"], "absorbed": seed["absorbed"]} | Trace(1.0, lam, 0.0, now).row()

    def _join_or_add(self, seed: Row, now: float) -> None:
        v = np.asarray(seed["centroid"], float)
        near = cosines([m["centroid"] for m in self.modes], v)
        if not len(near) or near.max() < THETA_MODE:
            self.modes.append(self._mode(seed, self.trace.lam, now))
            return
        mode = self.modes[len(near) - 1 - int(near[::-1].argmax())]  # the last of equals
        total = mode["absorbed"] + seed["absorbed"]
        if total and len(mode["centroid"]) == len(v):
            mode["centroid"] = ((np.asarray(mode["centroid"]) * mode["absorbed"] + v * seed["absorbed"]) / total).tolist()
        labels = Counter()
        for h in (mode["label_histogram"], seed["label_histogram"]):
            for x in h:
                labels[x["label"]] += x["n"]
        mode["label_histogram"] = ranked_labels(labels)
        mode["label"] = mode["label_histogram"][0]["label"] if labels else mode["label"]
        mode["absorbed"] = total
        trace = Trace.of(mode)
        trace.touch(now, CONSOLIDATION)
        mode |= trace.row()

    def consolidate(self, now: float, consolidation: float) -> None:
        """Touch the archetype and all its modes, living or not."""
        self.trace.touch(now, consolidation)
        for mode in self.modes:
            trace = Trace.of(mode)
            trace.touch(now, consolidation)
            mode |= trace.row()

    def row(self) -> Row:
        return {
            "subject": self.subject, "core": self.core.tolist(), "core_label": self.core_label, "anomalies": self.anomalies, "anomaly_labels": self.anomaly_labels, "represented": self.represented, "arc": self.arc, "modes": self.modes,
        } | self.trace.row()

    @classmethod
    def of(cls, r: Row) -> Archetype:
        """From a stored row; what older tables lack gets its default, an empty origin the centroid."""
        modes = [dict(m) | {"origin": m.get("origin") or m["centroid"], "label": m.get("label") or "", "label_histogram": m.get("label_histogram") or []} for m in r.get("modes") or []]
        arc = [dict(a) | {"label": a.get("label") or "", "label_histogram": a.get("label_histogram") or []} for a in r.get("arc") or []]
        return cls(r["subject"], np.asarray(r["core"], float), r.get("core_label") or "", list(r.get("anomalies") or []), list(r.get("anomaly_labels") or []), r["represented"], arc, modes, Trace.of(r))


def running_core(cycles: DataFrame) -> DataFrame:
    """Core, volume and trace after each cycle in closed form; rows (subject, cycle, tick, absorbed, centroid)."""
    upto = Window.partitionBy("subject", "pos").orderBy("cycle").rowsBetween(Window.unboundedPreceding, 0)
    parts = cycles.select("subject", "cycle", "tick", "absorbed", F.posexplode("centroid").alias("pos", "x"))
    represented = F.sum("absorbed").over(upto)
    touches = F.row_number().over(Window.partitionBy("subject", "pos").orderBy("cycle")) - 1
    lam = F.lit(physics.lambda_from_halflife(physics.RESILIENCE_HALFLIFE["high"]))
    run = parts.select("subject", "cycle", "tick", "pos", (F.sum(F.col("absorbed") * F.col("x")).over(upto) / represented).alias("core"), represented.alias("represented"), touches.alias("touches"))
    return run.select("subject", "cycle", "tick", "pos", "core", "represented", physics.reinforcement_after(F.col("touches")).alias("reinforcement"), physics.lambda_after(lam, F.col("touches"), CONSOLIDATION).alias("lambda"))


def consolidate(archetypes: DataFrame, subject: str, now: float, consolidation: float) -> DataFrame:
    """IMPRINT: touch one subject's archetype and all its modes."""
    mine = F.col("subject") == subject

    def touched(lam, r):
        return F.greatest(lam * (1 - consolidation), F.lit(physics.LAMBDA_FLOOR)), r + 1.0 / (1.0 + r)

    lam, r = touched(F.col("lambda"), F.col("reinforcement"))

    def mode(m):
        lam, r = touched(m["lambda"], m["reinforcement"])
        return m.withField("lambda", lam).withField("reinforcement", r).withField("last_touch", F.lit(now))

    return archetypes.withColumns({
        "lambda": F.when(mine, lam).otherwise(F.col("lambda")), "reinforcement": F.when(mine, r).otherwise(F.col("reinforcement")),
        "last_touch": F.when(mine, F.lit(now)).otherwise(F.col("last_touch")), "modes": F.when(mine, F.transform("modes", mode)).otherwise(F.col("modes")),
    })


def mode_rows(archetypes: DataFrame) -> DataFrame:
    """One row per mode, with its drift from the direction it was born with."""
    from ..functions import vectors

    rows = archetypes.select("subject", F.posexplode("modes").alias("mode", "m")).select("subject", "mode", "m.*")
    return rows.withColumn("drift", F.greatest(F.lit(1.0) - vectors.cosine(F.col("centroid"), F.col("origin")), F.lit(0.0)))
