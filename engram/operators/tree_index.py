"""An index of vectors whose work for a query grows slower than the table.

Unit vectors hang in a tree of two levels: top cells, and under them leaves,
whose number grows with the square root of the rows. A leaf's rows are kept as codes, one
byte a place for what differs from the leaf's centroid. A search

1. walks from the nearest top cells to the nearest leaves (``probes`` of them),
2. scans the codes there, by matrix products of a leaf's codes and the queries that look at it,
3. ranks the best ``kept`` candidates of each query anew by their vectors.

Fitting. Top cells come from a sample of about ``TOP_SAMPLE`` vectors on the driver;
each top cell's leaves come from its share of a larger sample (``PER_LEAF`` rows a leaf),
in one task a cell. Every vector is indexed. ``probes`` is the least number of
leaves that reaches the wanted recall for ``ASKED`` vectors of the table, whose true neighbours
are found by brute force over the whole table; the recall of whole searches is then measured and kept as ``recall``;
copies of a true neighbour count as it does.

Scale. Leaf centroids are broadcast: at most ``LEAF_BYTES``, which a billion
vectors of 48 places use a quarter of. Parts are sorted by leaf, so that a lookup skips row groups. A leaf with
many copies of one vector is scanned in blocks, by several tasks. Queries are a table, never collected.

Changes. ``insert`` places new rows in the tree as it is and writes them as a part of
their own; a row takes the place of an earlier one of its id. ``refresh`` takes a
whole new version of the rows and writes only what differs. Parts are put together
when there are ``MAX_PARTS``, and the tree is fitted anew when the rows have grown fourfold.

Vectors that are null or of another length than most of the sample aren't indexed; queries of another
length find nothing. Zero vectors have cosine 0 to all. Ids are taken as unique.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, FloatType, IntegerType, StructField, StructType

from ..functions import physics, vectors
from ..sources.shared import remove_folder, shared_folder, staged
from .retrieval import living, nearest_exact, points, resonate, subjects_by_rank

# Fixed value of the memory model.
FLAT_LIMIT = 256

TOP_SAMPLE = 8192
PER_LEAF = 24
ASKED = 128
LEAF_BYTES = 64 << 20
BLOCK = 4096
SCANNED = 256  # queries whose products with a block are in memory at once
MAX_PARTS = 8
GROWTH = 4


def unit_rows(column: pa.Array) -> np.ndarray:
    """A matrix of unit vectors; all of one length and not null, zero vectors stay zero."""
    out = np.array(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, size, out=out, where=size > 0)


def spherical_means(x: np.ndarray, cells: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Unit centroids by cosine; fewer than ``cells`` if vectors repeat."""
    x = np.unique(x, axis=0)
    if len(x) <= cells:
        return x
    centroids = x[rng.choice(len(x), cells, replace=False)]
    for _ in range(rounds):
        own = (x @ centroids.T).argmax(axis=1)
        order = np.argsort(own, kind="stable")
        firsts = np.flatnonzero(np.r_[True, np.diff(own[order]) > 0])
        sums = np.add.reduceat(x[order], firsts)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids[own[order][firsts]] = np.where(size > 0, sums / np.where(size > 0, size, 1), sums)
    return centroids


class Tree:
    """Top centroids, leaf centroids, and the top cell of each leaf, leaves of a cell side by side."""

    def __init__(self, tops: np.ndarray, leaves: np.ndarray, parents: np.ndarray):
        order = np.argsort(parents, kind="stable")
        self.tops, self.leaves = tops, leaves[order]
        self.first = np.searchsorted(parents[order], np.arange(len(tops) + 1))

    def nearest(self, x: np.ndarray, leaves: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) pairs: up to ``leaves`` nearest leaves of each row, from its ``beam`` nearest top cells."""
        beam = min(beam, len(self.tops))
        near = x @ self.tops.T
        cells = np.argpartition(-near, beam - 1, axis=1)[:, :beam] if beam < len(self.tops) else np.tile(np.arange(len(self.tops)), (len(x), 1))
        rows, found, scores = [], [], []
        for cell in np.unique(cells):
            here = np.flatnonzero((cells == cell).any(axis=1))
            low, high = self.first[cell], self.first[cell + 1]
            if high > low:
                score = x[here] @ self.leaves[low:high].T
                if high - low > leaves:
                    best = np.argpartition(-score, leaves - 1, axis=1)[:, :leaves]
                    score = np.take_along_axis(score, best, axis=1)
                else:
                    best = np.tile(np.arange(high - low), (len(here), 1))
                rows.append(np.repeat(here, best.shape[1]))
                found.append((best + low).ravel())
                scores.append(score.ravel())
        if not rows:
            return np.empty(0, int), np.empty(0, int)
        row, leaf, score = np.concatenate(rows), np.concatenate(found), np.concatenate(scores)
        order = np.lexsort((leaf, -score, row))
        row, leaf = row[order], leaf[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        return row[place < leaves], leaf[place < leaves]


def _encode(x: np.ndarray, centroids: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Bytes of what differs from the centroid, and the step of each row's bytes."""
    rest = x - centroids
    step = np.abs(rest).max(axis=1, initial=0) / 127
    codes = np.rint(np.divide(rest, step[:, None], out=np.zeros_like(rest), where=step[:, None] > 0)).astype(np.int8)
    width = x.shape[1]
    ends = pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * np.int32(width))
    return pa.Array.from_buffers(pa.binary(), len(x), [None, ends, pa.py_buffer(codes.tobytes())]), pa.array(step.astype(np.float32))


def _place(tree: Tree, beam: int):
    """Rows (id, v) with their leaf, code and step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                part = batch.slice(low, BLOCK)
                x = unit_rows(part.column("v"))
                _, leaf = tree.nearest(x, 1, beam)
                codes, step = _encode(x, tree.leaves[leaf])
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("v"), pa.array(leaf, pa.int32()), codes, step], ["id", "v", "leaf", "code", "step"])

    return run


def _ask(tree: Tree, probes: int, beam: int):
    """Rows (query, q) once for each leaf to look at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, SCANNED):
                part = batch.slice(low, SCANNED)
                row, leaf = tree.nearest(unit_rows(part.column("q")), probes, beam)
                for at in range(0, len(row), BLOCK):
                    yield pa.RecordBatch.from_arrays([*part.take(pa.array(row[at : at + BLOCK])).columns, pa.array(leaf[at : at + BLOCK], pa.int32())], ["query", "q", "leaf"])

    return run


def _scan(leaves: np.ndarray, kept: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """The ``kept`` best items of a block of a leaf, for each query of a block that looks at the leaf, by their codes."""

    def run(key: tuple, items: pa.Table, queries: pa.Table) -> pa.Table:
        leaf = key[0].as_py()
        items = items.sort_by("id")
        ids, asked = items.column("id").combine_chunks(), queries.column("query").combine_chunks()
        if not len(ids) or not len(asked):
            return pa.table([asked.slice(0, 0), ids.slice(0, 0), pa.array([], pa.int32()), pa.array([], pa.float64())], ["query", "id", "leaf", "near"])
        codes = np.frombuffer(b"".join(items.column("code").to_pylist()), np.int8).reshape(len(ids), -1).T.astype(float)
        step, picked, scores = items.column("step").to_numpy(), [], []
        for low in range(0, len(asked), SCANNED):
            q = unit_rows(queries.column("q").slice(low, SCANNED).combine_chunks())
            near = np.round((q @ codes) * step + (q @ leaves[leaf])[:, None], 12)  # copies are equal, wherever they stand in the product
            best = np.argsort(-near, axis=1, kind="stable")[:, :kept]  # the smallest ids among copies
            picked.append(best)
            scores.append(np.take_along_axis(near, best, axis=1))
        best = np.concatenate(picked)
        rows = np.repeat(np.arange(len(asked)), best.shape[1])
        return pa.table([asked.take(pa.array(rows)), ids.take(pa.array(best.ravel())), pa.array(np.full(len(rows), leaf), pa.int32()), pa.array(np.concatenate(scores).ravel())], ["query", "id", "leaf", "near"])

    return run


class TreeIndex:
    """See the module. ``recall`` of ``k`` nearest is what ``probes`` are chosen for."""

    def __init__(self, rows: DataFrame, id_column: str, vector: str, *, recall: float = 0.95, k: int = 10, leaves_per_root: float = 2.0, seed: int = 17):
        self.spark, self.id_column, self.vector = rows.sparkSession, id_column, vector
        self.wanted, self.k, self.leaves_per_root, self.seed = recall, k, leaves_per_root, seed
        self.folder = f"{shared_folder(self.spark)}/tree-{uuid.uuid4().hex}"
        self.parts: list[str] = []
        self._fit(rows.select(F.col(id_column).alias("id"), vectors.as_double(F.col(vector)).alias("v")))

    # fitting ---------------------------------------------------------------

    def _sample(self, rows: DataFrame, size: float, salt: int) -> DataFrame:
        share = int(min(1.0, size / max(self.count, 1)) * (1 << 32))
        return rows.where(F.pmod(F.xxhash64("id", F.lit(self.seed + salt)), F.lit(1 << 32)) < F.lit(share))

    def _fit(self, rows: DataFrame) -> None:
        rows = rows.where(F.col("v").isNotNull())
        self.count = rows.count()
        found = self._sample(rows, TOP_SAMPLE, 0).select("v").toArrow().column("v").combine_chunks()
        lengths = Counter(found.value_lengths().to_pylist()) or Counter([0])
        self.width = max(lengths.items(), key=lambda x: (x[1], -x[0]))[0]
        rng = np.random.default_rng(self.seed)
        known = unit_rows(found.filter(pa.compute.equal(found.value_lengths(), self.width))) if self.width else np.zeros((1, 0))
        rows = rows.where(F.size("v") == self.width)
        many = int(min(max(1.0, self.leaves_per_root * self.count**0.5), max(1, LEAF_BYTES // (4 * max(self.width, 1)))))
        tops = spherical_means(known, max(1, round(many**0.5)), rng)
        self.tree = Tree(tops, tops, np.arange(len(tops)))
        if many > len(tops):
            self.tree = self._grown(rows, tops, many)
        self.beam = min(2, len(tops))
        self.probes, self.recall, self.fitted = len(self.tree.leaves), 1.0, self.count
        self.parts = [self._write(rows)]
        self._calibrate()

    def _grown(self, rows: DataFrame, tops: np.ndarray, many: int) -> Tree:
        """Leaves under each top cell, as many as is its share of the sample, by one task a cell."""
        cells, seed = Tree(tops, tops, np.arange(len(tops))), self.seed
        most = 4 * max(1, round(many**0.5))
        share = many / max(1.0, min(float(self.count), float(many * PER_LEAF)))

        def cell_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(low, BLOCK)
                    _, cell = cells.nearest(unit_rows(part.column("v")), 1, 1)
                    yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), part.column("v")], ["cell", "v"])

        def fit(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # Rows beyond what the most leaves of a cell can use only count.
            rng, held, size, seen = np.random.default_rng(seed), [], 0, 0
            for b in batches:
                seen += b.num_rows
                if size < most * PER_LEAF:
                    held.append(unit_rows(b.column("v")))
                    size += b.num_rows
            means = spherical_means(np.concatenate(held), max(1, min(most, round(seen * share))), rng)
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * len(means), pa.int32()), pa.array(list(means), pa.list_(pa.float64()))], ["cell", "v"])

        sampled = self._sample(rows, many * PER_LEAF, 1).select("v").mapInArrow(cell_of, "cell int, v array<double>")
        found = sampled.groupBy("cell").applyInArrow(fit, "cell int, v array<double>").toArrow()  # leaves: bounded by LEAF_BYTES
        parents = found.column("cell").to_numpy()
        bare = np.setdiff1d(np.arange(len(tops)), parents)  # cells that the second sample missed are their own leaf
        leaves = np.concatenate([np.array(found.column("v").combine_chunks().flatten()).reshape(len(found), -1), tops[bare]])
        return Tree(tops, leaves, np.concatenate([parents, bare]))

    def _write(self, rows: DataFrame) -> str:
        kind = StructType([rows.schema["id"], rows.schema["v"], StructField("leaf", IntegerType()), StructField("code", BinaryType()), StructField("step", FloatType())])
        placed = rows.select("id", "v").mapInArrow(_place(self.tree, self.beam), kind)
        path = f"{self.folder}/{uuid.uuid4().hex}"
        placed.repartitionByRange("leaf", F.xxhash64("id")).sortWithinPartitions("leaf").write.parquet(path)
        self.kind = kind
        return path

    def _calibrate(self) -> None:
        """The least ``probes`` for the wanted recall, by queries whose true neighbours are known."""
        items = self.items()
        asked = self._sample(items, ASKED, 2).select(F.col("id").alias("query"), F.col("v").alias("q"))
        asked = staged(asked, "asked")
        true = nearest_exact(items, "id", "v", asked, "query", "q", self.k).select("query", "id", "cosine").join(items.select("id", "leaf"), "id").join(asked, "query")
        found = true.toArrow()  # ASKED times k rows
        if not len(found):
            return
        x = unit_rows(found.column("q").combine_chunks())
        near = x @ self.tree.leaves.T
        own = near[np.arange(len(found)), found.column("leaf").to_numpy()]
        place = np.sort((near > own[:, None]).sum(axis=1))
        self.probes = int(place[min(len(place) - 1, int(np.ceil(self.wanted * len(place))) - 1)]) + 1
        # A copy of a true neighbour is as good as that one: what counts is its cosine.
        least: dict[str, list[float]] = {}
        for q, c in zip(map(str, found.column("query").to_pylist()), found.column("cosine").to_pylist(), strict=True):
            least.setdefault(q, []).append(c)
        while True:
            hits: Counter = Counter()
            for r in self.join(asked, "query", "q", self.k).select("query", "cosine").toArrow().to_pylist():
                q = str(r["query"])
                hits[q] += r["cosine"] >= min(least[q]) - 1e-9
            self.recall = sum(min(n, len(least[q])) for q, n in hits.items()) / len(found)
            if self.recall >= self.wanted - 0.03 or self.probes >= len(self.tree.leaves):
                return
            self.probes = min(2 * self.probes, len(self.tree.leaves))

    @property
    def _beam_of_queries(self) -> int:
        """Top cells in which the leaves to look at surely lie, three times over and four more."""
        return min(len(self.tree.tops), 3 * self.probes * len(self.tree.tops) // len(self.tree.leaves) + 4)

    # changes ---------------------------------------------------------------

    def items(self) -> DataFrame:
        """(id, v, leaf, code, step) of the rows that count: the newest of each id, unless it was removed."""
        read = lambda path: self.spark.read.schema(self.kind).parquet(path)
        out, later = None, None
        for path in reversed(self.parts):
            own = read(path)
            left = own if later is None else own.join(later, "id", "left_anti")
            out = left if out is None else left.unionByName(out)
            later = own.select("id") if later is None else later.unionByName(own.select("id"))
        return out.where(F.col("leaf").isNotNull()) if len(self.parts) > 1 else out

    def insert(self, rows: DataFrame, removed: DataFrame | None = None) -> None:
        """Add rows, in place of earlier ones of their ids; take out the ids of ``removed`` (id)."""
        own = rows.select(F.col(self.id_column).alias("id"), vectors.as_double(F.col(self.vector)).alias("v"))
        fit = F.col("v").isNotNull() & (F.size("v") == self.width)
        path = self._write(own.where(fit))
        gone = own.where(~F.coalesce(fit, F.lit(False))).select("id")
        gone = gone if removed is None else gone.unionByName(removed.select("id"))
        gone.select("id", *(F.lit(None).cast(f.dataType).alias(f.name) for f in self.kind.fields[1:])).write.mode("append").parquet(path)
        self.parts.append(path)
        self.count = self.items().count()
        if self.count > GROWTH * max(self.fitted, 1):
            self._rebuilt(fit=True)
        elif len(self.parts) >= MAX_PARTS:
            self._rebuilt(fit=False)

    def _rebuilt(self, fit: bool) -> None:
        old, items = self.parts, self.items().select("id", "v")
        if fit:
            self._fit(items)
        else:
            self.parts = [self._write(items)]
        for path in old:
            remove_folder(self.spark, path)

    def refresh(self, rows: DataFrame) -> int:
        """Make the index hold ``rows`` and nothing else, by writing what differs; the number of rows written or taken out."""
        new = rows.select(F.col(self.id_column).alias("id"), vectors.as_double(F.col(self.vector)).alias("v"))
        both = self.items().select("id", F.col("v").alias("old"), F.lit(True).alias("was")).join(new.withColumn("is", F.lit(True)), "id", "full_outer")
        path = f"{self.folder}/{uuid.uuid4().hex}-changes"
        both.where(~F.col("old").eqNullSafe(F.col("v")) | F.col("is").isNull()).select("id", "v", "is").write.parquet(path)
        changes = self.spark.read.parquet(path)
        n = changes.count()
        if n:
            changed = changes.where(F.col("is").isNotNull()).select(F.col("id").alias(self.id_column), F.col("v").alias(self.vector))
            self.insert(changed, changes.where(F.col("is").isNull()).select("id"))
        remove_folder(self.spark, path)
        return n

    def close(self) -> None:
        remove_folder(self.spark, self.folder)

    # searching -------------------------------------------------------------

    def nearest(self, query: list[float], k: int) -> DataFrame:
        """(id, cosine) of the k nearest candidates of one query; reads the leaves it looks at."""
        q = [float(x) for x in query]
        if len(q) != self.width:
            return self.items().limit(0).select("id", F.lit(0.0).alias("cosine"))
        _, leaves = self.tree.nearest(unit_rows(pa.array([q], pa.list_(pa.float64()))), self.probes, self._beam_of_queries)
        near = self.items().where(F.col("leaf").isin(leaves.tolist())).select("id", vectors.cosine(F.col("v"), F.lit(q)).alias("cosine"))
        return near.orderBy(F.desc("cosine"), "id").limit(k)

    def _asked(self, queries: DataFrame, id_column: str, vector: str) -> tuple[DataFrame, DataFrame]:
        own = queries.select(F.col(id_column).alias("query"), vectors.as_double(F.col(vector)).alias("q")).where(F.size("q") == self.width)
        return own, own.mapInArrow(_ask(self.tree, self.probes, self._beam_of_queries), StructType([*own.schema.fields, StructField("leaf", IntegerType())]))

    def join(self, queries: DataFrame, id_column: str, vector: str, k: int) -> DataFrame:
        """(query, id, cosine, rank) of the k nearest candidates of each query; fewer only where its leaves hold fewer."""
        own, asked = self._asked(queries, id_column, vector)
        items, kept = self.items(), 2 * k + 16
        blocks = items.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        halves = asked.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("halves"))
        sizes = F.broadcast(blocks.join(halves, "leaf"))  # a row per leaf
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = items.select("leaf", "id", "code", "step").join(sizes, "leaf").withColumns({"i": F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")}).withColumn("j", each("halves")).drop("blocks", "halves")
        right = asked.join(sizes, "leaf").withColumns({"j": F.pmod(F.xxhash64("query"), F.col("halves")).cast("int")}).withColumn("i", each("blocks")).drop("blocks", "halves")
        kind = StructType([StructField("query", own.schema["query"].dataType), StructField("id", items.schema["id"].dataType), *_parse("leaf int, near double")])
        found = left.groupBy("leaf", "i", "j").cogroup(right.groupBy("leaf", "i", "j")).applyInArrow(_scan(self.tree.leaves, kept), kind)
        by_code = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("near"), "id"))
        best = found.withColumn("place", by_code).where(F.col("place") <= kept).select("query", "id", "leaf")
        exact = best.join(items.select("leaf", "id", "v"), ["leaf", "id"]).join(own, "query").select("query", "id", vectors.cosine(F.col("v"), F.col("q")).alias("cosine"))
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "id"))
        return exact.withColumn("rank", rank).where(F.col("rank") <= k)

    def candidate_share(self, queries: DataFrame, id_column: str, vector: str) -> float:
        """Of all pairs of a query and a vector, those whose codes ``join`` compares."""
        own, asked = self._asked(queries, id_column, vector)
        sizes = lambda rows, name: rows.groupBy("leaf").agg(F.count("*").alias(name))
        pairs = sizes(self.items(), "a").join(sizes(asked, "b"), "leaf").agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0
        return pairs / max(1, own.count() * self.count)


def _parse(fields: str) -> list[StructField]:
    return StructType.fromDDL(fields).fields


class Retriever:
    """Flat scoring up to ``flat_limit`` archetypes, else the index: by raw cosine, then living subjects only."""

    def __init__(self, flat_limit: int = FLAT_LIMIT):
        self.flat_limit = flat_limit
        self._index: tuple[object, TreeIndex] | None = None

    def invalidate(self) -> None:
        if self._index is not None:
            self._index[1].close()
        self._index = None

    def resonate_subjects(self, archetypes: DataFrame, query: list[float], k: int, now: float, *, version: object = None, theta: float = physics.THETA_FADE) -> DataFrame:
        """(subject, rank); where ``version`` has changed, the index takes in the points that differ.

        The archetypes are read several times and so written first, once, whatever made them.
        """
        archetypes = staged(archetypes, "archetypes")
        if archetypes.limit(self.flat_limit + 1).count() <= self.flat_limit:
            rows = resonate(archetypes, query, k, now, theta)
            return rows.select("subject", F.row_number().over(Window.orderBy(F.desc("score"), "subject")).alias("rank"))
        if self._index is None or version is None or self._index[0] != version:
            marked = points(archetypes).withColumn("point", F.struct("subject", "mode"))
            index = TreeIndex(marked, "point", "vector") if self._index is None else self._index[1]
            if self._index is not None:
                index.refresh(marked)
            self._index = (version, index)
        near = self._index[1].nearest(query, 8 * k)
        ranked = near.select(F.col("id.subject").alias("subject"), F.row_number().over(Window.orderBy(F.desc("cosine"), "id")).alias("rank"))
        return subjects_by_rank(ranked.join(living(archetypes, now, theta).select("subject"), "subject", "left_semi"), k)
