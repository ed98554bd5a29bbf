"""DISTILL: from the living perceptions of a subject to its centroid, split, labels and modes."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from .ordered import Row, ordered_fold

# Fixed values of the memory model.
THETA_REDUNDANCY = 0.92
THETA_ANOMALY = 0.30
THETA_MODE = 0.5
MAX_MODES = 8

HOT_ROWS = 100_000

HISTOGRAM = "array<struct<label:string,n:bigint>>"
SEED = f"struct<mode:int,centroid:array<double>,label:string,label_histogram:{HISTOGRAM},absorbed:bigint>"
INTENTION = f"centroid array<double>, absorbed bigint, redundant bigint, anomalies array<array<double>>, anomaly_labels array<string>, label_histogram {HISTOGRAM}, core_label string, seeds array<{SEED}>"


def label_counts(rows: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """(keys, label, n, rank): labels in histogram order, by n falling, then label. Empty labels don't count."""
    counts = rows.where(F.col(label) != "").groupBy(*keys, F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "label")))


def histograms(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key: the ordered histogram, and its head as core label (empty if there is none)."""
    packed = counts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "label", "n"))).alias("h"))
    return packed.select(*keys, F.transform("h", lambda x: F.struct(x["label"].alias("label"), x["n"].alias("n"))).alias("label_histogram"), F.coalesce(F.get(F.col("h.label"), F.lit(0)), F.lit("")).alias("core_label"))


def merge_histograms(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add up the counts of several histograms and rank them anew."""
    total = counts.groupBy(*keys, "label").agg(F.sum("n").cast("long").alias("n"))
    return total.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "label")))


def split(rows: DataFrame, keys: Sequence[str], *, redundancy: float = THETA_REDUNDANCY, anomaly: float = THETA_ANOMALY) -> DataFrame:
    """Each row with its cosine to the key's centroid, and whether it is redundant or else an anomaly."""
    # The centroids are joined back on the keys; a hot key's rows are split by adaptive execution.
    near = vectors.cosine(F.col("embedding"), F.col("centroid"))
    scored = rows.join(vectors.centroids(rows, keys), list(keys)).withColumn("cosine", near)
    redundant = F.col("cosine") >= redundancy
    return scored.withColumns({"redundant": redundant, "anomaly": ~redundant & (F.col("cosine") <= anomaly)})


def intentions(rows: DataFrame, keys: Sequence[str], **thresholds: float) -> DataFrame:
    """One row per key: centroid, counts, ordered anomalies, histogram and core label."""
    parts = split(rows, keys, **thresholds)
    odd = F.when(F.col("anomaly"), F.struct("seq", F.col("label").alias("label"), vectors.as_double(F.col("embedding")).alias("v")))
    summed = parts.groupBy(*keys).agg(F.first("centroid").alias("centroid"), F.count("*").alias("absorbed"), F.sum(F.col("redundant").cast("long")).alias("redundant"), F.array_sort(F.collect_list(odd)).alias("odd"))
    labels = histograms(label_counts(rows, keys), keys)
    out = summed.join(labels, list(keys), "left")
    return out.select(
        *keys, "centroid", "absorbed", "redundant", F.col("odd.v").alias("anomalies"), F.col("odd.label").alias("anomaly_labels"), F.coalesce("label_histogram", F.array().cast(HISTOGRAM)).alias("label_histogram"), F.coalesce("core_label", F.lit("")).alias("core_label")
    )


class Leaders:
    """Leader clustering in arrival order.

    A vector joins the leader whose sum of members is nearest by cosine (the first
    of equals) if that is at least ``theta``, or if there are ``max_modes`` already;
    else it leads a new mode. Vectors of another length than the first are skipped.
    """

    def __init__(self, theta: float = THETA_MODE, max_modes: int = MAX_MODES):
        self.theta, self.max_modes = theta, max_modes
        self.sums = np.zeros((0, 0))  # a row per leader
        self.squares: list[float] = []
        self.sizes = np.zeros(0)  # their lengths, without end where 0, so that cosines to a zero vector are 0
        self.counts: list[int] = []
        self.labels: list[Counter] = []

    def restore(self, sums: np.ndarray, counts: Sequence[int]) -> None:
        """Go on from leaders of given sums and counts."""
        self.sums, self.counts = sums.copy(), list(counts)
        self.squares = np.einsum("ij,ij->i", sums, sums).tolist()
        self.sizes = np.array([math.sqrt(s) or math.inf for s in self.squares])
        self.labels = [Counter() for _ in counts]

    def add(self, vector: Sequence[float], label: str | None, size: float | None = None) -> int:
        """The leader that the vector joins or becomes; -1 if it is skipped."""
        v = np.asarray(vector, float)
        if self.counts and len(v) != self.sums.shape[1]:
            return -1
        size = math.sqrt(v @ v) if size is None else size
        at, dots = -1, None
        if self.counts:
            dots = self.sums @ v
            near = dots / (self.sizes * (size or math.inf))
            at = int(near.argmax())
        if at < 0 or near[at] < self.theta and len(self.counts) < self.max_modes:
            self.sums = np.vstack([self.sums, v]) if self.counts else v[None, :].copy()
            self.sizes = np.append(self.sizes, size or math.inf)
            self.squares.append(size * size)
            self.counts.append(1)
            self.labels.append(Counter())
            at = len(self.counts) - 1
        else:
            self.sums[at] += v
            self.squares[at] += 2.0 * float(dots[at]) + size * size
            self.sizes[at] = math.sqrt(max(self.squares[at], 0.0)) or math.inf
            self.counts[at] += 1
        if label:
            self.labels[at][label] += 1
        return at

    def seeds(self) -> Iterator[Row]:
        for i, (s, n, labels) in enumerate(zip(self.sums, self.counts, self.labels, strict=True)):
            ranked = ranked_labels(labels)
            yield {"mode": i, "centroid": (s / n).tolist(), "label": ranked[0]["label"] if ranked else "", "label_histogram": ranked, "absorbed": n}


def ranked_labels(counts: Counter) -> list[Row]:
    return [{"label": k, "n": n} for k, n in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]


def cluster_modes(rows: DataFrame, keys: Sequence[str], *, theta: float = THETA_MODE, max_modes: int = MAX_MODES, hot: int = HOT_ROWS) -> DataFrame:
    """(keys, seeds) of the leader clustering of each key's rows by ``seq``.

    A key is folded in one task; those of more than ``hot`` rows in segments, see :mod:`segments`, with the same result.
    """
    rows = rows.where(F.col("embedding").isNotNull())
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > hot)
    if not counts.isEmpty():
        from .segments import cluster_segments

        large = cluster_segments(rows.join(counts, list(keys), "left_semi").select(*keys, "seq", vectors.as_double(F.col("embedding")).alias("embedding"), "label"), keys, theta=theta, max_modes=max_modes)
        return large.unionByName(_cluster(rows.join(counts, list(keys), "left_anti"), keys, theta, max_modes))
    return _cluster(rows, keys, theta, max_modes)


def _cluster(rows: DataFrame, keys: Sequence[str], theta: float, max_modes: int) -> DataFrame:
    kinds = dict(rows.dtypes)

    def fold(key: tuple, own: Iterator[Row]) -> Iterator[Row]:
        leaders = Leaders(theta, max_modes)
        for r in own:
            leaders.add(r["embedding"], r["label"])
        yield dict(zip(keys, key, strict=True)) | {"seeds": list(leaders.seeds())}

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + f", seeds array<{SEED}>"
    return ordered_fold(rows.select(*keys, "seq", "embedding", "label"), keys, ["seq"], fold, schema)
