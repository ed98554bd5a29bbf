"""Leader clustering of a key with very many rows: segments folded at once from a guessed state, until the guess is true.

Leader clustering is a fold: which leader a vector joins depends on the sums of all
rows before it. Sums change all the time, but decisions seldom do. So

1. the rows of a key are cut into segments of their order, and the first one is folded;
2. all others are folded at the same time, each from a guess of what comes before it: at first the end of the first segment,
   then the sums of the segments before it as they came out;
3. where a segment's decisions, kept as a byte a row, still hold from the newly carried state, which a few
   matrix products over running sums tell, it stands; else it is folded again.

When no decision has changed in a round, each segment was folded from the very sums that the
decisions before it make: that is the fold itself. The first segment that was wrong is
right after each round, so it ends; mostly after two or three.

Scale. A task holds one segment; per segment a state of at most ``max_modes`` sums moves between
rounds, written to the shared folder, and is carried on along the key in one streaming pass.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import staged
from .distill import SEED, Leaders, ranked_labels
from .ordered import Row, ordered_fold

SEGMENT_ROWS = 20_000
SKIPPED = 255  # decision for a vector of another length

_STATE = "sums array<array<double>>, counts array<bigint>"
_FOLDED = "gained array<array<double>>, gained_counts array<bigint>, decisions binary, labels array<struct<mode:int,label:string,n:bigint>>, changed boolean"


def _holds(x: np.ndarray, decisions: np.ndarray, sums: np.ndarray, theta: float, max_modes: int) -> bool:
    """Whether each row, given those before it, would decide as noted; rows of one length, new leaders among them."""
    n, leaders = len(x), max(int(decisions.max(initial=-1)) + 1, len(sums))
    if leaders > max_modes:
        return False
    known = np.zeros((leaders, x.shape[1]))
    if len(sums):
        known[: len(sums)] = sums
    sizes = np.sqrt(np.einsum("ij,ij->i", x, x))
    near, born = np.full((n, leaders), -np.inf), np.full(leaders, -1)
    for k in range(leaders):
        mine = decisions == k
        if k >= len(sums):
            if not mine.any():
                return False
            born[k] = int(mine.argmax())
        run = np.cumsum(np.where(mine[:, None], x, 0.0), axis=0)
        before = known[k] + np.vstack([np.zeros(x.shape[1]), run[:-1]])
        both = np.sqrt(np.einsum("ij,ij->i", before, before)) * sizes
        near[:, k] = np.divide(np.einsum("ij,ij->i", before, x), both, out=np.zeros(n), where=both > 0)
        if born[k] >= 0:
            near[: born[k] + 1, k] = -np.inf
    led = np.zeros(n, bool)
    led[born[born >= 0]] = True
    there = len(sums) + np.cumsum(np.r_[0, led[:-1]])  # leaders before each row
    best = near.argmax(axis=1)
    top = near[np.arange(n), best]
    leads = (there == 0) | ((top < theta) & (there < max_modes))
    return bool((leads == led).all() and (best[~led] == decisions[~led]).all() and (decisions[led] == there[led]).all())


def _fold(keys: Sequence[str], theta: float, max_modes: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def run(key: tuple, rows: pa.Table, state: pa.Table) -> pa.Table:
        own = [k.as_py() for k in key]
        rows = rows.sort_by("seq")
        given = state.to_pylist()[0]
        sums, counts = np.array(given["sums"], float) if given["sums"] else np.zeros((0, 0)), list(given["counts"] or [])
        vectors = [np.asarray(v, float) if v is not None else np.zeros(0) for v in rows.column("embedding").to_pylist()]
        labels = rows.column("label").to_pylist()
        width = sums.shape[1] if len(sums) else len(vectors[0])
        fits = np.array([len(v) == width for v in vectors])
        x = np.stack([v for v in vectors if len(v) == width]) if fits.any() else np.zeros((0, width))
        noted = None if given["decisions"] is None else np.frombuffer(given["decisions"], np.uint8)
        if noted is not None and _holds(x, noted[fits].astype(int), sums, theta, max_modes):
            decisions = noted
        else:
            leaders = Leaders(theta, max_modes)
            leaders.restore(sums, counts)
            decisions = np.array([leaders.add(v, None) for v in vectors], np.int64).astype(np.uint8)  # -1 is SKIPPED
        changed = noted is None or not np.array_equal(decisions, noted)
        n = max([len(sums), *(int(d) + 1 for d in np.unique(decisions[fits]))]) if fits.any() else len(sums)
        gained = np.zeros((n, width))
        np.add.at(gained, decisions[fits].astype(int), x)
        tally = Counter((int(d), label) for d, label in zip(decisions, labels, strict=True) if label and d != SKIPPED)
        out = {
            **dict(zip([*keys, "segment"], own, strict=True)), "gained": gained.tolist(), "gained_counts": np.bincount(decisions[fits], minlength=n).tolist(), "decisions": decisions.tobytes(),
            "labels": [{"mode": m, "label": label, "n": k} for (m, label), k in tally.items()], "changed": changed,
        }
        return pa.Table.from_pylist([out], schema=run.schema)

    return run


def _carried(folded: DataFrame, keys: Sequence[str], kinds: dict[str, str]) -> DataFrame:
    """(keys, segment, sums, counts, decisions): the state before each segment, by what those before it gained."""

    def fold(key: tuple, own: Iterator[Row]) -> Iterator[Row]:
        sums: list[np.ndarray] = []
        counts: list[int] = []
        for r in own:
            yield dict(zip(keys, key, strict=True)) | {"segment": r["segment"], "sums": [s.tolist() for s in sums], "counts": list(counts), "decisions": r["decisions"]}
            for k, (gain, n) in enumerate(zip(r["gained"], r["gained_counts"], strict=True)):
                if k < len(sums):
                    if len(gain) == len(sums[k]):
                        sums[k], counts[k] = sums[k] + np.array(gain), counts[k] + n
                elif n:
                    sums.append(np.array(gain))
                    counts.append(n)

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + f", segment int, {_STATE}, decisions binary"
    return ordered_fold(folded.select(*keys, "segment", "gained", "gained_counts", "decisions"), keys, ["segment"], fold, schema)


def cluster_segments(rows: DataFrame, keys: Sequence[str], *, theta: float, max_modes: int, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """(keys, seeds) of the leader clustering of each key's rows by ``seq``, rows (keys, seq, embedding, label)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kinds, keys = dict(rows.dtypes), list(keys)
    total = rows.count()
    ranged = rows.repartitionByRange(max(1, -(-total // segment_rows)), *keys, "seq").withColumn("segment", F.spark_partition_id())
    cut = staged(ranged.select(*keys, "segment", "seq", "embedding", "label"), "segments")
    named = ", ".join(f"{k} {kinds[k]}" for k in keys)
    schema = f"{named}, segment int, {_FOLDED}"
    run = _fold(keys, theta, max_modes)
    run.schema = to_arrow_schema(_parse_datatype_string(schema))
    at = [*keys, "segment"]

    def folded(state: DataFrame, of: DataFrame) -> DataFrame:
        return staged(of.groupBy(*at).cogroup(state.groupBy(*at)).applyInArrow(run, schema), "folded")

    places = cut.select(*at).distinct()
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("segment")) == 1
    places = staged(places.withColumn("first", first), "places")
    empty = places.select(*at, F.lit(None).cast("array<array<double>>").alias("sums"), F.lit(None).cast("array<bigint>").alias("counts"), F.lit(None).cast("binary").alias("decisions"), "first")
    opening = folded(empty.where("first").drop("first"), cut.join(places.where("first").select(*at), at, "left_semi"))
    guess = opening.select(*keys, F.col("gained").alias("sums"), F.col("gained_counts").alias("counts"))
    later = empty.where(~F.col("first")).select(*at, "decisions").join(guess, keys).select(*at, "sums", "counts", "decisions")
    own = empty.where("first").select(*at, "decisions").join(opening.select(*at, F.col("decisions").alias("_d")), at)
    start = later.unionByName(own.select(*at, F.lit(None).cast("array<array<double>>").alias("sums"), F.lit(None).cast("array<bigint>").alias("counts"), F.col("_d").alias("decisions")))
    found = folded(start, cut)
    while not found.where("changed").isEmpty():
        found = folded(_carried(found, keys, kinds), cut)

    def seeds(key: tuple, own: Iterator[Row]) -> Iterator[Row]:
        sums: list[np.ndarray] = []
        counts: list[int] = []
        labels: list[Counter] = []
        for r in own:
            for k, (gain, n) in enumerate(zip(r["gained"], r["gained_counts"], strict=True)):
                if k == len(sums):
                    sums.append(np.zeros(len(gain)))
                    counts.append(0)
                    labels.append(Counter())
                sums[k], counts[k] = sums[k] + np.array(gain), counts[k] + n
            for t in r["labels"]:
                labels[t["mode"]][t["label"]] += t["n"]
        ranked = [ranked_labels(c) for c in labels]
        made = [{"mode": k, "centroid": (s / n).tolist(), "label": h[0]["label"] if h else "", "label_histogram": h, "absorbed": n} for k, (s, n, h) in enumerate(zip(sums, counts, ranked, strict=True))]
        yield dict(zip(keys, key, strict=True)) | {"seeds": made}

    return ordered_fold(found.select(*keys, "segment", "gained", "gained_counts", "labels"), keys, ["segment"], seeds, f"{named}, seeds array<{SEED}>")
