"""EVOKE: a token-budgeted digest of an archetype, alone or with the facts that fit.

An archetype is one row of bounded series, so a context is made row by row; the
heavy part, the aggregation to archetypes, is done before.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..functions import physics
from .archetype import Trace, cosine
from .distill import HISTOGRAM
from .ordered import Row

# Fixed values of the memory model.
TOKENS_PER_VECTOR = 24
SUMMARY_POINTS = 4

SLICE = 64  # archetypes that are Python objects at once

SCHEMA = (
    "subject string, core array<double>, core_label string, anomalies array<array<double>>, anomaly_labels array<string>, arc_points array<struct<tick:double,drift:double>>, arc_labels array<string>, "
    f"arc_label_histograms array<{HISTOGRAM}>, domain_arcs array<struct<label:string,series:array<double>>>, mode_drifts array<struct<label:string,drift:double>>, represented bigint, anomalies_included bigint, vectors_returned bigint, token_estimate bigint, compression_ratio double, resonating_mode string"
)


@dataclass(frozen=True)
class Request:
    token_budget: int
    detail: str = "full"  # full, summary, none
    since: float | None = None
    tokens_per_vector: int = TOKENS_PER_VECTOR
    query: tuple[float, ...] | None = None


def vector_budget(tokens: int, per_vector: int = TOKENS_PER_VECTOR) -> int:
    return tokens // max(per_vector, 1)


def arc_quota(budget: int, detail: str) -> int:
    """Milestones that may be returned: two thirds of what the core leaves."""
    quota = max(budget - 1, 0) * 2 // 3
    return {"none": 0, "summary": min(quota, SUMMARY_POINTS), "full": quota}[detail]


def thinned(n: int, quota: int) -> list[int]:
    return list(range(n)) if n <= quota else [i * (n - 1) // max(quota - 1, 1) for i in range(quota)]


def domain_series(arc: list[Row], cap: int) -> list[Row]:
    """Labels with their shares over the milestones, by peak times (1 + variance)."""
    labels = sorted({x["label"] for m in arc for x in m["label_histogram"]})
    rows = []
    for label in labels:
        series = []
        for m in arc:
            total = sum(x["n"] for x in m["label_histogram"])
            series.append(sum(x["n"] for x in m["label_histogram"] if x["label"] == label) / total if total else 0.0)
        rows.append((-max(series) * (1 + float(np.var(series))), label, series))
    return [{"label": label, "series": series} for _, label, series in sorted(rows)[: max(cap, 1)]]


def evoke_row(a: Row, request: Request, now: float) -> Row | None:
    """The context of one archetype row, or none if it has faded."""
    if Trace.of(a).weight(now) < physics.THETA_FADE:
        return None
    budget = vector_budget(request.token_budget, request.tokens_per_vector)
    arc = [m for m in a["arc"] if request.since is None or m["tick"] >= request.since]
    picked = [arc[i] for i in thinned(len(arc), arc_quota(budget, request.detail))]
    origin = np.asarray(a["arc"][0]["direction"], float) if a["arc"] else None
    odd = min(len(a["anomalies"]), max(budget - 1 - len(picked), 0))
    vectors = 1 + len(picked) + odd
    drift = lambda v, w: max(1.0 - cosine(np.asarray(v, float), np.asarray(w, float)), 0.0)
    mode = None
    if request.query is not None and a["modes"]:
        q = np.asarray(request.query, float)
        mode = max((cosine(np.asarray(m["centroid"], float), q), i) for i, m in enumerate(a["modes"]))[1]
    return {
        "subject": a["subject"], "core": list(a["core"]), "core_label": a["core_label"], "anomalies": a["anomalies"][:odd], "anomaly_labels": a["anomaly_labels"][:odd],
        "arc_points": [{"tick": m["tick"], "drift": 1.0 - cosine(np.asarray(m["direction"], float), origin)} for m in picked], "arc_labels": [m["label"] for m in picked], "arc_label_histograms": [m["label_histogram"] for m in picked],
        "domain_arcs": [] if request.detail == "none" else domain_series(arc, budget), "mode_drifts": [{"label": m["label"], "drift": drift(m["centroid"], m["origin"])} for m in a["modes"] if Trace.of(m).weight(now) >= physics.THETA_FADE],
        "represented": a["represented"], "anomalies_included": odd, "vectors_returned": vectors, "token_estimate": vectors * request.tokens_per_vector, "compression_ratio": a["represented"] / vectors if vectors else 0.0,
        "resonating_mode": None if mode is None else a["modes"][mode]["label"],
    }


def slices(batches: Iterable[pa.RecordBatch], size: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            yield batch.slice(start, size)


def evoke(archetypes: DataFrame, request: Request, now: float) -> DataFrame:
    """Contexts of all living archetypes."""
    kind = _parse_datatype_string(SCHEMA)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [c for r in batch.to_pylist() if (c := evoke_row(r, request, now)) is not None]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return archetypes.mapInArrow(run, kind)


def evoke_counts(archetypes: DataFrame, request: Request, now: float) -> DataFrame:
    """The numbers of :func:`evoke` alone, in column expressions: what is returned, and what it costs."""
    budget = vector_budget(request.token_budget, request.tokens_per_vector)
    w = physics.weight(now, F.col("salience"), F.col("lambda"), F.col("last_touch"), F.col("reinforcement"))
    arc = F.col("arc") if request.since is None else F.filter("arc", lambda m: m["tick"] >= request.since)
    points = F.least(F.size(arc), F.lit(arc_quota(budget, request.detail)))
    odd = F.least(F.size("anomalies"), F.greatest(F.lit(max(budget - 1, 0)) - F.col("arc_count"), F.lit(0)))
    rows = archetypes.where(w >= physics.THETA_FADE).withColumn("arc_count", points).withColumn("anomalies_included", odd)
    vectors = 1 + F.col("arc_count") + F.col("anomalies_included")
    out = rows.select("subject", F.col("arc_count").cast("long").alias("arc_count"), F.col("anomalies_included").cast("long").alias("anomalies_included"), vectors.cast("long").alias("vectors_returned"), "represented")
    return out.withColumns({"token_estimate": F.col("vectors_returned") * request.tokens_per_vector, "compression_ratio": F.col("represented") / F.col("vectors_returned")})


def evoke_unified(archetypes: DataFrame, facts: DataFrame, request: Request, fact_budget: int, now: float) -> DataFrame:
    """(subject, gist, facts, fact_tokens, total_tokens): facts first, within ``fact_budget``, then the gist with the rest.

    ``facts`` has subject, seq, text, provenance, score, cost; the gist is null where less
    than one vector's tokens remain. A subject with only one of the two layers is kept.
    """
    from .facts import pack_budget

    chosen = pack_budget(facts, fact_budget).join(facts.select("subject", "seq", "text", "provenance"), ["subject", "seq"])
    entry = F.struct(F.negative("score").alias("rank"), "seq", "text", "provenance", "score", "cost")
    packed = chosen.groupBy("subject").agg(F.array_sort(F.collect_list(entry)).alias("facts"), F.sum("cost").alias("fact_tokens"))
    both = archetypes.withColumn("_has", F.lit(True)).join(packed, "subject", "full_outer")
    gist = _parse_datatype_string(SCHEMA)
    kind = _parse_datatype_string("subject string, facts array<struct<text:string,provenance:string,score:double,cost:bigint>>, fact_tokens bigint, total_tokens bigint").add("gist", gist)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for r in batch.to_pylist():
                spent = r["fact_tokens"] or 0
                left = max(request.token_budget - spent, 0)
                own = None
                if r["_has"] and left >= request.tokens_per_vector:
                    own = evoke_row(r, Request(left, request.detail, request.since, request.tokens_per_vector, request.query), now)
                listed = [{k: f[k] for k in ("text", "provenance", "score", "cost")} for f in r["facts"] or []]
                out.append({"subject": r["subject"], "facts": listed, "fact_tokens": spent, "total_tokens": spent + (own["token_estimate"] if own else 0), "gist": own})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return both.mapInArrow(run, kind)
