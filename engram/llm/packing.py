"""Best-fit packing of token sequences by exact-complement hashing.

A document's ids are those of a byte-level BPE vocabulary, then ``end_id``.
Documents of more than ``capacity`` ids are cut into pieces of ``capacity``;
only the first piece may be shorter.

Method. Only lengths matter for packing, so the plan is made on the counts per
length. From the longest length down, the gap that a piece leaves is looked up in
an index of the sums of one, two and three available lengths, each used only as
often as pieces are left; such sequences are full. What stays is placed best-fit, longest
first, into the open sequence with the smallest gap that holds it. The plan is a
list of patterns (lengths side by side) with a number of copies. It decides
nothing about single documents: the piece of rank r among those of its length
takes the r-th place that the plan has for that length.

Scale. Texts are encoded once, in a map; the narrow result (no texts, no ids)
is written to the shared folder, with a rank of each piece within its task and
length. Ranks over all tasks are prefix sums of the (task, length) counts, so no
task sees all pieces of a frequent length. The driver and the broadcast hold the
plan only: at most ``capacity`` counts and the patterns made from them, whatever
the number of documents.

Nulls and odd rows: a null text is empty, one piece with ``end_id`` alone.
Repeated rows are packed each. Very long texts are encoded whole, then cut. An empty table gives no rows. Extra columns are
ignored. Bytes that aren't UTF-8 are encoded as replacement characters.

The vocabulary comes as the JSON file of the tokenizers library. Ids are made by
tiktoken from that same vocabulary, which is several times as fast; tests hold
them against the tokenizers library. As that library does, special tokens
written out in a text become their ids.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage_table
from .textbatch import release_memory, texts_of

BROADCAST_COUNTS = 1_000_000
CAPACITY = 2048
HELD_TOKENS = 1 << 18
END_ID = 0
ROW_GROUP_BYTES = 4 << 20
VOCABULARY_BYTES = 64 << 20

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, task_rank long"


class SumIndex:
    """Sums of one, two and three lengths that are still available, hashed by sum.

    For each sum the index holds the largest member with which a pair, or a triple,
    may still make it. Lengths only run out, so an entry is moved on past members
    that can't make the sum any more and never back; each is passed once in all.
    """

    def __init__(self, left: list[int]):
        self.left = left
        self.pairs: dict[int, int] = {}
        self.triples: dict[int, int] = {}

    def single(self, total: int, used: Sequence[int]) -> tuple[int, ...] | None:
        return (total,) if self.left[total] > used.count(total) else None

    def pair(self, total: int, used: Sequence[int]) -> tuple[int, ...] | None:
        """The pair of that sum with the longest member, besides the lengths in ``used``."""
        left, a, at_head = self.left, self.pairs.get(total, total - 1), True
        while 2 * a >= total:
            b = total - a
            if left[a] > (a == b) and left[b] > 0:
                at_head = False
                if left[a] > used.count(a) + (a == b) and left[b] > used.count(b):
                    return a, b
            a -= 1
            if at_head:
                self.pairs[total] = a
        return None

    def triple(self, total: int, used: Sequence[int]) -> tuple[int, ...] | None:
        left, a, at_head = self.left, self.triples.get(total, total - 2), True
        while 3 * a >= total:
            if left[a] > 0:
                at_head = at_head and self.pair(total - a, ()) is None
                if left[a] > used.count(a) and (found := self.pair(total - a, (*used, a))):
                    return a, *found
            a -= 1
            if at_head:
                self.triples[total] = a
        return None


class Plan:
    """Patterns of lengths with copies, from the number of pieces of each length."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity = capacity
        self.left = [counts.get(n, 0) for n in range(capacity + 1)]
        self.patterns: list[tuple[tuple[int, ...], int]] = []
        self._exact()
        self._best_fit()

    def _complement(self, length: int, index: SumIndex) -> tuple[int, ...] | None:
        """One, two or three lengths that fill the gap beside ``length`` exactly."""
        gap, used = self.capacity - length, (length,)
        return () if gap == 0 else index.single(gap, used) or index.pair(gap, used) or index.triple(gap, used)

    def _exact(self) -> None:
        index = SumIndex(self.left)
        for length in range(self.capacity, 0, -1):
            while self.left[length] > 0:
                rest = self._complement(length, index)
                if rest is None:
                    break
                need = Counter((length, *rest))
                copies = min(self.left[x] // n for x, n in need.items())
                for x, n in need.items():
                    self.left[x] -= n * copies
                self.patterns.append(((length, *rest), copies))

    def _best_fit(self) -> None:
        open_: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
        for length in range(self.capacity, 0, -1):
            n = self.left[length]
            while n:
                gap = min((g for g, x in open_.items() if g >= length and x), default=None)
                if gap is None:
                    each = self.capacity // length
                    full, over = divmod(n, each)
                    for size, copies in ((each, full), (over, 1)):
                        if size and copies:
                            open_[self.capacity - size * length][(length,) * size] += copies
                    n = 0
                    continue
                pattern = next(iter(open_[gap]))
                take = min(n, open_[gap][pattern])
                open_[gap][pattern] -= take
                if not open_[gap][pattern]:
                    del open_[gap][pattern]
                open_[gap - length][(*pattern, length)] += take
                n -= take
            self.left[length] = 0
        for found in open_.values():
            self.patterns += list(found.items())

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.patterns)

    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted (length, first rank) keys, and for each the sequence of that rank and the offset."""
        used: dict[int, int] = defaultdict(int)
        rows, base = [], 0
        for pattern, copies in self.patterns:
            offset = 0
            for length in pattern:
                rows.append(((length << 48) + used[length], base, offset))
                used[length] += copies
                offset += length
            base += copies
        table = np.array(sorted(rows), np.int64).reshape(-1, 3)
        return table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy()


def _encoder(spec: bytes):
    """tiktoken's encoder for a byte-level BPE vocabulary in the JSON format of the tokenizers library."""
    import public_tokenizers
    import tiktoken

    found = json.loads(spec)
    model, before = found["model"], found["pre_tokenizer"]
    if model["type"] != "BPE" or found.get("normalizer") or before["type"] != "ByteLevel" or before["add_prefix_space"]:
        raise ValueError("not a byte-level BPE vocabulary")
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves
    moved = [b for b in range(256) if b not in set(kept)]
    byte = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(moved)}
    special = {x["content"]: x["id"] for x in found.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    merged = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    if merged != sorted(merged):
        raise ValueError("ids do not follow the order of merges")
    return tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


_ENCODERS: dict[int, object] = {}


def encoder(spec: bytes):
    key = hash(spec)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = _encoder(spec)
    return _ENCODERS[key]


def forget_encoder() -> None:
    """A worker that goes on to other work needs the vocabulary's memory no more."""
    if _ENCODERS:
        _ENCODERS.clear()
        release_memory()


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    if total <= capacity:
        return [(0, total)]
    first = total % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, total, capacity))]


def _piece_map(shared, capacity: int, end_id: int, with_ids: bool):
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "task_rank"]

    def written(rows: list[tuple], ids: list[np.ndarray]) -> pa.RecordBatch:
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        if not with_ids:
            return pa.RecordBatch.from_arrays(columns, names)
        ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32)))], [*names, "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value).encode_to_numpy
        task, ranks = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], np.uint32)
        rows: list[tuple] = []
        held: list[np.ndarray] = []
        tokens = 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), strict=True):
                ids = np.concatenate([encode(text, allowed_special="all"), end]) if text is not None else end
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    own = ids[start : start + length].astype("<u4")
                    rows.append((doc_id, piece, start, length, zlib.crc32(own.tobytes()), task, ranks[length]))
                    ranks[length] += 1
                    if with_ids:
                        held.append(own)
                tokens += len(ids)
                if tokens >= HELD_TOKENS:
                    yield written(rows, held)
                    rows, held, tokens = [], [], 0
        if rows:
            yield written(rows, held)
        release_memory()

    return run


def _placing(shared):
    """(length, rank) to the sequence and offset. Only these two columns go to Python, so that ids stay where they are."""

    @F.arrow_udf("struct<sequence_id:long,offset:long>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        forget_encoder()
        keys, bases, offsets = shared.value
        length, rank = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        at = np.searchsorted(keys, (length << 48) + rank, "right") - 1
        sequence = bases[at] + rank - (keys[at] - (length << 48)) if len(at) else rank
        return pa.StructArray.from_arrays([pa.array(sequence, pa.int64()), pa.array(offsets[at], pa.int64())], ["sequence_id", "offset"])

    return place


def pack(documents: DataFrame, vocabulary: bytes, *, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece with its sequence and offset; with its ids too if ``with_ids``."""
    if len(vocabulary) > VOCABULARY_BYTES:
        raise ValueError("the vocabulary is too large to broadcast")
    encoder(vocabulary)
    context = documents.sparkSession.sparkContext
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    more = ", ids array<int>" if with_ids else ""
    # A column of a row group is read in one go, outside the heap: small groups keep that small where ids are long.
    pieces = stage_table(docs.mapInArrow(_piece_map(context.broadcast(vocabulary), capacity, end_id, with_ids), _PIECES + more), "pieces", **{"parquet.block.size": ROW_GROUP_BYTES})
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    lengths = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = context.broadcast(Plan(lengths, capacity).places())
    if with_ids and counts.count() <= BROADCAST_COUNTS:  # so that ids stay where they are
        before = F.broadcast(before)
    placed = pieces.join(before, ["task", "length"]).withColumn("place", _placing(places)("length", F.col("task_rank") + F.col("before")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "place.sequence_id", "place.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from ``pack(..., with_ids=True)``; at most ``capacity`` ids each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
