"""Prefix trie of conversations: shared openings as nodes, with counts over subtrees.

A conversation is its turns ordered by turn (nulls first), then role, then digest
of the text. A node of depth d is a distinct sequence of the first d turns (role,
text); its members are the conversations that start with it. The root (depth 0)
holds all, those without turns too.

Method: a Patricia tree. Turns are compared by SHA-256 of role and text.

1. Conversations, as the joined digests of their turns, are dealt to ranges of their
   sorted order; ties split by conv_id, so copies of one conversation spread over ranges.
2. Within a range one pass over the sorted rows keeps the points on the path to the
   latest row: branches, ends and leaves only. A point that is left for good has its
   aggregates complete; its edge is expanded into the nodes with one child that the
   tree left out, whose sums are suffix sums over the edge.
3. Only points on the paths to a range's first and last row may go on in other ranges.
   These *spines* carry partial sums; one pass over all spines in order, by the same
   algorithm, completes them.

Scale. One shuffle by conversation (digests and lengths, no texts) and one by range.
A range's pass holds the current path, and the rows under points that aren't
complete, so memory follows the range. The pass over the spines is one task:
it reads two short paths a range, and for a conversation with copies in many ranges their
ids as text, a chunk at a time, because a SHA-256 over ids in ascending order can only be
computed in sequence. A single conversation's digests (32 bytes a turn) are one row.

Nulls and odd rows: null roles and texts are empty, null turns come first, repeated
rows are turns of their own. Rows without a conv_id belong to no conversation and are
left out. Very long texts count by their digest and length. An empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, stage_table
from .textbatch import release_memory

DIGEST = 32
CHUNK = 8192
FLUSH = 20_000
_NO_ENDS = hashlib.sha256(b"").hexdigest()

#: node rows: conv_id to ends_sha256, with (part, at), the spine point above, where the parent isn't complete;
#: spine rows: part, side (first or last row of the range), seq, the path on seq 0, a point's partial sums, ids that end there.
_BUILT = (
    "spine boolean, conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
    "part int, at int, side int, seq int, key binary, chars array<int>, ends string"
)
_MERGED = "conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, part int, at int"


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): per conversation its turns in order, as (digest in hex, code points of the text)."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    turn = F.struct(F.col("turn").alias("turn"), role.alias("role"), digest.alias("digest"), F.char_length(text).alias("chars"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return ordered.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["chars"].alias("chars"))).alias("turns"))


def share_openings(sequences: DataFrame, *, group: int = 100, most: int = 6) -> DataFrame:
    """Each conversation c with its first h turns replaced by those of conversation c - c % group, where h = crc32(c) % most."""
    own = stage_table(sequences, "turns")
    heads = own.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("head_id"), F.slice("turns", 1, max(1, most - 1)).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    joined = own.withColumns({"h": h, "head_id": F.col("conv_id") - F.col("conv_id") % group}).join(heads, "head_id", "left")
    none = F.slice("turns", 1, 0)
    opening = F.coalesce(F.slice("head", F.lit(1), F.col("h")), none)
    rest = F.when(F.size("turns") > F.col("h"), F.slice("turns", F.col("h") + 1, F.size("turns"))).otherwise(none)
    return joined.select("conv_id", F.concat(opening, rest).alias("turns"))


class _Point:
    """A branch, an end or a leaf, with sums over what hangs below it."""

    __slots__ = ("depth", "serial", "convs", "low", "children", "leaves", "saved", "ends", "waiting", "parts")

    def __init__(self, depth: int, serial: int):
        self.depth, self.serial = depth, serial
        self.convs = self.children = self.leaves = self.saved = 0
        self.low: int | None = None
        self.ends: object = None  # ids as a list within a range, a running SHA-256 over the spines
        self.waiting: list[tuple] = []
        self.parts: list[tuple[int, int]] = []

    def add(self, convs: int, low: int | None, children: int, leaves: int, saved: int) -> None:
        self.convs, self.children, self.leaves, self.saved = self.convs + convs, self.children + children, self.leaves + leaves, self.saved + saved
        if low is not None:
            self.low = low if self.low is None else min(self.low, low)

    def digest(self) -> str:
        if self.ends is None:
            return _NO_ENDS
        return hashlib.sha256(",".join(self.ends).encode()).hexdigest() if isinstance(self.ends, list) else self.ends.hexdigest()


def _common(a: bytes, b: bytes) -> int:
    """Turns that two keys share at their start."""
    if a == b:
        return len(a) // DIGEST
    d = 0
    while (own := a[d : d + DIGEST]) and own == b[d : d + DIGEST]:
        d += DIGEST
    return d // DIGEST


class _Path:
    """Points on the path to the latest key, keys coming in sorted order; ``rows`` takes complete nodes.

    ``kept`` says which points may go on elsewhere: they are set aside in ``left``.
    """

    def __init__(self, rows: list[tuple]):
        self.rows, self.key, self.chars = rows, b"", []
        self.serials = 0
        self.stack = [self._point(0)]
        self.left: list[_Point] = []
        self.kept = -1

    def _point(self, depth: int) -> _Point:
        self.serials += 1
        return _Point(depth, self.serials)

    def turn_to(self, key: bytes, chars: list[int]) -> int:
        """Make ``key`` the latest: points beyond what it shares with the last one are left."""
        shared = _common(self.key, key)
        while self.stack[-1].depth > shared:
            point = self.stack.pop()
            if self.stack[-1].depth < shared:
                self.stack.append(self._point(shared))
            if point.depth <= self.kept:
                self.left.append(point)
            else:
                self.close(point, self.stack[-1])
        self.key, self.chars = key, chars
        return shared

    def at(self, depth: int) -> _Point:
        """The point at a depth of the path, made if it isn't there."""
        k = len(self.stack)
        while self.stack[k - 1].depth > depth:
            k -= 1
        if self.stack[k - 1].depth < depth:
            self.stack.insert(k, self._point(depth))
            return self.stack[k]
        return self.stack[k - 1]

    def close(self, point: _Point, above: _Point) -> None:
        """Expand the edge to a complete point, deepest node first, and add it to the point above."""
        leaves = point.leaves if point.children else 1
        saved, children, ends = point.saved, point.children, point.digest()
        for depth in range(point.depth, above.depth, -1):
            saved += (point.convs - 1) * self.chars[depth - 1]
            node = (point.low, depth, point.low, point.convs, children, leaves, saved, ends)
            if depth == above.depth + 1:
                above.waiting.append(node)
            else:
                self.rows.append((*node, None, None))
            children, ends = 1, _NO_ENDS
        self.free(point)
        above.add(point.convs, point.low, 1, leaves, saved)

    def free(self, point: _Point, part: int | None = None) -> None:
        """Give out the nodes right below a point, with its smallest member, or its number where that isn't known here."""
        for conv, depth, _, *sums in point.waiting:
            self.rows.append((conv, depth, point.low if part is None else None, *sums, part, None if part is None else point.serial))
        point.waiting = []


def _nodes(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32()]
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "part", "at"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _built(rows: list[tuple]) -> pa.RecordBatch:
    nodes, n = _nodes(rows), len(rows)
    none = {"side": pa.int32(), "seq": pa.int32(), "key": pa.binary(), "chars": pa.list_(pa.int32()), "ends": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([False] * n), *nodes.columns, *(pa.nulls(n, k) for k in none.values())], ["spine", *nodes.schema.names, *none])


def _spine_rows(part: int, side: int, key: bytes, chars: list[int], points: list[_Point]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for p in points:
        ids, chunks, size = [], [], 0
        for i in p.ends or []:
            ids.append(i)
            size += len(i) + 1
            if size > CHUNK:
                chunks.append(",".join(ids))
                ids, size = [], 0
        chunks += [",".join(ids)] if ids else []
        rows.append((p.low, p.depth, p.convs, p.children, p.leaves, p.saved, p.serial, chunks[0] if chunks else None))
        rows += [(None, p.depth, 0, 0, 0, 0, p.serial, c) for c in chunks[1:]]
    for first in range(0, len(rows), FLUSH):
        low, depth, convs, children, leaves, saved, serial, ends = map(list, zip(*rows[first : first + FLUSH], strict=True))
        n = len(low)
        opens = first == 0
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([True] * n), pa.array(low, pa.int64()), pa.array(depth, pa.int32()), pa.nulls(n, pa.int64()), pa.array(convs, pa.int64()), pa.array(children, pa.int64()), pa.array(leaves, pa.int64()), pa.array(saved, pa.int64()), pa.nulls(n, pa.string()),
                pa.array([part] * n, pa.int32()), pa.array(serial, pa.int32()), pa.array([side] * n, pa.int32()), pa.array(range(first, first + n), pa.int32()),
                pa.array([key if opens and not k else None for k in range(n)], pa.binary()), pa.array([chars if opens and not k else None for k in range(n)], pa.list_(pa.int32())), pa.array(ends, pa.string()),
            ],
            ["spine", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "part", "at", "side", "seq", "key", "chars", "ends"],
        )


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of one range that are complete, and its two spines."""
    rows: list[tuple] = []
    path, first, part = _Path(rows), None, 0
    for batch in batches:
        for conv, key, chars in zip(batch.column("conv_id").to_pylist(), batch.column("key").to_pylist(), batch.column("chars").to_pylist(), strict=True):
            if first is None:
                first, part = (key, chars), batch.column("part")[0].as_py()
                path.kept = len(key) // DIGEST
                path.turn_to(key, chars)
            else:
                path.kept = min(path.kept, path.turn_to(key, chars))
            point = path.at(len(key) // DIGEST)
            if point.ends is None:
                point.ends = []
            point.ends.append(str(conv))
            point.add(1, conv, 0, 0, 0)
            path.free(path.stack[0], part)  # the root goes on in every range
            if len(rows) >= FLUSH:
                yield _built(rows)
                rows.clear()
    if first is not None:
        for point in (*path.left, *path.stack):
            path.free(point, part)
        if rows:
            yield _built(rows)
        yield from _spine_rows(part, 0, *first, path.left)
        yield from _spine_rows(part, 1, path.key, path.chars, path.stack)
    release_memory()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes along the spines, and (part, at, conv_id) of each spine point (with a null depth)."""
    rows: list[tuple] = []
    path = _Path(rows)

    def done(point: _Point) -> None:
        rows.extend((point.low, None, None, None, None, None, None, None, part, at) for part, at in point.parts)

    closing = path.close
    path.close = lambda point, above: (closing(point, above), done(point))
    any_row = False
    for batch in batches:
        for r in batch.to_pylist():
            any_row = True
            if r["seq"] == 0:
                path.turn_to(r["key"], r["chars"])
            point = path.at(r["depth"])
            point.add(r["n_convs"], r["conv_id"], r["n_children"], r["n_leaves"], r["saved_tokens"])
            if r["conv_id"] is not None or r["depth"] == 0:
                point.parts.append((r["part"], r["at"]))
            if r["ends"] is not None:
                if point.ends is None:
                    point.ends = hashlib.sha256(r["ends"].encode())
                else:
                    point.ends.update(b"," + r["ends"].encode())
            if len(rows) >= FLUSH:
                yield _nodes(rows)
                rows.clear()
    if any_row:
        path.turn_to(b"", [])
        root = path.stack[0]
        path.free(root)
        rows.append((root.low, 0, None, root.convs, root.children, root.leaves if root.children else 1, root.saved, root.digest(), None, None))
        done(root)
        yield _nodes(rows)


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """One row per node of the trie over (conv_id, turns), as :func:`turn_sequences` gives them."""
    keys = sequences.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("key"), F.transform("turns", lambda t: t["chars"]).alias("chars"))
    ranges = shuffle_partitions(sequences.sparkSession)
    dealt = stage_table(keys, "keys").repartitionByRange(ranges, "key", "conv_id").sortWithinPartitions("key", "conv_id").withColumn("part", F.spark_partition_id())
    built = stage_table(dealt.mapInArrow(_build, _BUILT), "trie")
    spines = built.where("spine").drop("spine", "parent_conv_id", "ends_sha256").repartition(1).sortWithinPartitions("part", "side", "seq")
    merged = stage_table(spines.mapInArrow(_merge, _MERGED), "spines")
    above = merged.where("depth is null").select("part", "at", F.col("conv_id").alias("above"))
    columns: list[Column | str] = ["conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inner = built.where("not spine").join(above, ["part", "at"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    return inner.select(*columns).unionByName(merged.where("depth is not null").select(*columns))
