"""N-gram Jaccard join: near-duplicate classes by prefix filters under several token orders.

A document's set holds its distinct 5-word shingles (words ``[^\\x20\\x09-\\x0D]+``
of the text with A-Z lower-cased; fewer words are one shingle). Two documents
link when ``100 * |A and B| >= 75 * |A or B|``; classes are connected components.

Method. Every global order of the tokens gives a necessary filter: linked sets
share a token among the first ``n - ceil(0.75 n) + 1`` of each. Three orders
are used, by document frequency, and by two coarser frequency steps with other
hashes inside a step. A pair must pass all of them (and a length and a position
bound) before its intersection is counted. Frequencies come from all tokens of
all documents. Tokens of one set only come first in every order and can't link,
so a set is dropped as soon as they fill its prefix, which most sets' do.

Equal sets are one node. To keep large groups of near copies from being paired
with each other, links are sought in steps: first each node is held against one
centre (the node with the fewest tokens of its own among those that share its
prefix tokens, by most shared); links contract nodes to components. Then every
remaining candidate pair of different components is verified, so no link between
components is lost, and pairs inside one can't change the result. Pairs of tokens that up to
``HOT_ROWS`` nodes share are joined as rows. Nodes of more frequent tokens are
gathered by cluster (nodes connected by such tokens), cut into blocks of alike
sizes and tokens, and a task holds two blocks against each other by posting
lists; it gives back links that connect components only, so no rows of pairs are
made. Blocks meet only if they share a frequent token and their sizes allow it.

Scale. Texts are read once. Tokens move once, 10 bytes each before compression,
packed by chunk and bucket: the map packs chunks of documents, a reducer per
bucket finds tokens of two sets or more, and replies to the chunks. Of a token
that more than ``CHUNK_OWNERS`` sets of a chunk hold, only the number moves, so
the most frequent token costs a bucket 12 bytes a chunk of up to ``CHUNK_SETS``
sets; its owners stay with the chunk. All later tables hold only sets that can
have a partner. Joins are by shuffle, on keys whose large groups adaptive
execution may split; links and components stay in tables in the shared folder.
The pairs of blocks are the one part that can grow faster than the input, where
very many sets of about one size share a frequent token but aren't linked.
Tokens are 64-bit hashes, set ids 128-bit hashes of sets.

The documents should be a table or another source that deals rows alike each
time it is read.

Nulls and odd rows: a null text, or one without words, has an empty set and is
its own class. Repeated rows are in one class. Very long texts have all their
shingles; one text is the least that a task holds. An empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, stage_table
from .textbatch import U64, Words, lower_ascii, mix, release_memory, shingle_hashes, slices, white_space_separates

WORDS = 5
PERCENT = 75
CHUNK_TOKENS = 700_000
CHUNK_SETS = 30_000
CHUNK_DOCUMENTS = 60_000
CHUNK_OWNERS = 64
CHUNK_BITS, SET_BITS = 24, 16  # a node's number: task, chunk of the task, set of the chunk
STAR_ROUNDS = 1
HOT_ROWS = 64
BLOCK_ROWS = 1024
BLOCK_TOKENS = 2_000_000

_WORD, _FOLD = white_space_separates(), lower_ascii()


def prefix_length(n: np.ndarray | int, percent: int = PERCENT):
    return n - -(-percent * n // 100) + 1


def document_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    words = Words(data, offsets, _WORD)
    h = words.hashes(_FOLD)
    all_ = shingle_hashes(h, k)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(all_[a : b - k + 1]))
        else:
            out.append(shingle_hashes(h[a:b], b - a) if b > a else h[:0])
    return out


def set_id(tokens: np.ndarray) -> bytes:
    """128-bit hash of a set; equal sets have equal ids."""
    a, b = mix(tokens ^ U64(0xA0761D6478BD642F)).sum(dtype=U64), mix(tokens * U64(0xE7037ED1A0B428DB) + U64(1)).sum(dtype=U64)
    return np.array([a, b ^ U64(len(tokens))], "<u8").tobytes()


_PARTS = "bucket int, chunk long, tokens binary, owners binary, freqs binary, held binary, numbers binary, sizes binary, sids binary, doc_ids array<bigint>, doc_sets array<int>"
_KINDS = {"bucket": pa.int32(), "chunk": pa.int64()} | {c: pa.binary() for c in ("tokens", "owners", "freqs", "held", "numbers", "sizes", "sids")} | {"doc_ids": pa.list_(pa.int64()), "doc_sets": pa.list_(pa.int32())}


def _batch(rows: list[dict]) -> pa.Table:
    return pa.table([pa.array([r.get(c) for r in rows], t) for c, t in _KINDS.items()], names=list(_KINDS))


def _packed(tokens: np.ndarray) -> bytes:
    """Tokens as planes of their bytes: the high bytes of sorted tokens repeat, which the shuffle's compression uses."""
    return np.ascontiguousarray(tokens.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpacked(parts: list[bytes | None]) -> np.ndarray:
    found = [np.ascontiguousarray(np.frombuffer(p, np.uint8).reshape(8, -1).T).view(U64).ravel() for p in parts if p]
    return np.concatenate(found) if found else np.empty(0, U64)


def _numbers(parts: list[bytes | None], kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(p for p in parts if p), kind).astype(np.int64)


def _runs(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return np.flatnonzero(new)


def _chunk_map(k: int, buckets: int, chunk_tokens: int, chunk_owners: int):
    """Rows per chunk of documents and bucket of tokens, and a home row per chunk.

    A part row has the chunk's tokens of a bucket with the sets that own them, and
    tokens of more than ``chunk_owners`` sets (``held``) with their number only: a
    bucket gets a bounded number of bytes for a token from each chunk. The home row
    has the owners of these, and the documents.
    """

    def flush(chunk: int, sets: dict[bytes, np.ndarray], ids: list[int | None], places: list[int]) -> Iterator[pa.RecordBatch]:
        tokens = np.concatenate(list(sets.values())) if sets else np.empty(0, U64)
        sizes = np.array([len(s) for s in sets.values()], np.int32)
        order = np.argsort(tokens, kind="stable")
        tokens, owners = tokens[order], np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)[order]
        starts = _runs(tokens)
        count = np.diff(np.append(starts, len(tokens)))
        many = count > chunk_owners
        held, number, apart = tokens[starts[many]], count[many].astype(np.uint32), np.repeat(many, count)
        home = {"bucket": chunk % buckets, "chunk": chunk, "owners": owners[apart].tobytes(), "held": _packed(held), "numbers": number.tobytes(), "sizes": sizes.tobytes(), "sids": b"".join(sets), "doc_ids": ids, "doc_sets": places}
        tokens, owners = tokens[~apart], owners[~apart]
        # Buckets are ranges of tokens, which are hashes.
        limits = (np.arange(1, buckets, dtype=object) * (1 << 64) // buckets).astype(U64)
        edges, held_edges = (np.concatenate([[0], np.searchsorted(t, limits), [len(t)]]).tolist() for t in (tokens, held))
        full = [i for i in range(buckets) if edges[i + 1] > edges[i] or held_edges[i + 1] > held_edges[i]]
        for part in range(0, len(full), 64):
            rows = []
            for i in full[part : part + 64]:
                own, kept = slice(edges[i], edges[i + 1]), slice(held_edges[i], held_edges[i + 1])
                rows.append({"bucket": i, "chunk": chunk, "tokens": _packed(tokens[own]), "owners": owners[own].tobytes(), "held": _packed(held[kept]), "numbers": number[kept].tobytes()})
            yield from _batch(rows).to_batches()
        yield from _batch([home]).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << CHUNK_BITS
        sets: dict[bytes, np.ndarray] = {}
        ids: list[int | None] = []
        places: list[int] = []
        index: dict[bytes, int] = {}
        tokens = 0
        for batch in batches:
            for low, high, data, offsets in slices(batch.column("text")):
                for doc_id, s in zip(batch.column("doc_id").slice(low, high - low).to_pylist(), document_sets(data, offsets, k), strict=True):
                    ids.append(doc_id)
                    if not len(s):
                        places.append(-1)
                        continue
                    sid = set_id(s)
                    if sid not in index:
                        index[sid], sets[sid] = len(sets), s
                        tokens += len(s)
                    places.append(index[sid])
                    if tokens >= chunk_tokens or len(sets) >= CHUNK_SETS or len(ids) >= CHUNK_DOCUMENTS:
                        yield from flush(chunk, sets, ids, places)
                        chunk, sets, ids, places, index, tokens = chunk + 1, {}, [], [], {}, 0
        if ids:
            yield from flush(chunk, sets, ids, places)
        del sets
        release_memory()

    return run


_REPLY_NAMES = ["chunk", "tokens", "owners", "freqs", "held", "numbers", "sizes", "sids", "doc_ids", "doc_sets"]
_REPLIES = _PARTS.removeprefix("bucket int, ")


def _share_tokens(table: pa.Table) -> pa.Table:
    """Of one bucket: tokens that two sets or more hold, with that number, back to their chunks; home rows pass."""
    is_part = table.column("sids").is_null()
    rows = table.filter(is_part).select(["chunk", "tokens", "owners", "held", "numbers"]).to_pylist()
    out = []
    if rows:
        tokens, held = _unpacked([r["tokens"] for r in rows]), _unpacked([r["held"] for r in rows])
        owners, number = np.frombuffer(b"".join(r["owners"] for r in rows), np.uint16), _numbers([r["numbers"] for r in rows], np.uint32)
        every = np.concatenate([tokens, held])
        order = np.argsort(every, kind="stable")
        starts = _runs(every[order])
        weight = np.concatenate([np.ones(len(tokens), np.int64), number])[order]
        freq = np.empty(len(every), np.int64)
        freq[order] = np.repeat(np.add.reduceat(weight, starts), np.diff(np.append(starts, len(every))))
        freq, held_freq = np.split(freq.astype(np.uint32), [len(tokens)])
        keep = freq >= 2
        kept = np.concatenate([[0], np.cumsum(keep)])
        ends = np.cumsum([len(r["owners"]) // 2 for r in rows])
        at, held_at = np.concatenate([[0], kept[ends]]).tolist(), np.concatenate([[0], np.cumsum([len(r["held"]) // 8 for r in rows])]).tolist()
        tokens, owners, freq = tokens[keep], owners[keep], freq[keep]
        for i, r in enumerate(rows):
            own, its = slice(at[i], at[i + 1]), slice(held_at[i], held_at[i + 1])
            if own.stop > own.start or its.stop > its.start:
                out.append({"chunk": r["chunk"], "tokens": _packed(tokens[own]), "owners": owners[own].tobytes(), "freqs": freq[own].tobytes(), "held": _packed(held[its]), "numbers": held_freq[its].tobytes()})
    tokens = held = owners = every = order = weight = freq = held_freq = keep = kept = rows = None
    release_memory()
    return pa.concat_tables([_batch(out).select(_REPLY_NAMES), table.filter(pc.invert(is_part)).select(_REPLY_NAMES).cast(_batch([]).select(_REPLY_NAMES).schema)])


_SETS = "sid binary, node long, n int, own int, tokens array<long>, prefix_1 array<long>, prefix_2 array<long>, prefix_3 array<long>, doc_ids array<bigint>, doc_sizes array<int>, doc_sids array<binary>"


def _alive_sets(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Of one chunk: the sets whose prefix holds shared tokens, and a row with the documents."""
        rows = table.to_pylist()
        home = next(r for r in rows if r["sids"] is not None)
        sizes = np.frombuffer(home["sizes"], np.int32).astype(np.int64)
        rows = [r for r in rows if r["sids"] is None]
        out: list[tuple] = []
        if rows:
            held, number = _unpacked([home["held"]]), _numbers([home["numbers"]], np.uint32)
            told, told_freq = _unpacked([r["held"] for r in rows]), np.frombuffer(b"".join(r["numbers"] or b"" for r in rows), np.uint32)
            held_freq = told_freq[np.argsort(told)][np.searchsorted(np.sort(told), held)]
            tokens = np.concatenate([_unpacked([r["tokens"] for r in rows]), np.repeat(held, number)])
            owners = np.frombuffer(b"".join([*(r["owners"] or b"" for r in rows), home["owners"]]), np.uint16)
            freqs = np.concatenate([np.frombuffer(b"".join(r["freqs"] or b"" for r in rows), np.uint32), np.repeat(held_freq, number)])
            rows = None
            edges = np.zeros(len(sizes) + 1, np.int64)
            np.cumsum(np.bincount(owners, minlength=len(sizes)), out=edges[1:])
            shared = np.diff(edges)
            left = prefix_length(sizes, percent) - (sizes - shared)
            alive = np.flatnonzero((shared > 0) & (left > 0)).tolist()
            step = np.log2(freqs).astype(np.uint8)
            prefixes = []
            for salt, key in ((3, freqs), (5, step), (7, step // 2)):
                order = np.lexsort((mix(tokens * U64(salt)), key, owners))
                prefixes.append([tokens[order[edges[i] : min(edges[i + 1], edges[i] + left[i])]].view(np.int64) for i in alive])
            order = np.lexsort((tokens, owners))
            for k, i in enumerate(alive):
                own = tokens[order[edges[i] : edges[i + 1]]].view(np.int64)
                out.append((home["sids"][16 * i : 16 * i + 16], (home["chunk"] << SET_BITS) + i, int(sizes[i]), int(sizes[i] - shared[i]), own, *(p[k] for p in prefixes), None, None, None))
        tokens = owners = freqs = step = order = None
        release_memory()
        sids = [home["sids"][16 * i : 16 * i + 16] if i >= 0 else None for i in home["doc_sets"]]
        out.append((*[None] * 8, home["doc_ids"], [int(sizes[i]) if i >= 0 else 0 for i in home["doc_sets"]], sids))
        kinds = [pa.binary(), pa.int64(), pa.int32(), pa.int32(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.int32()), pa.list_(pa.binary())]
        names = [f.split()[0] for f in _SETS.split(", ")]
        return pa.table([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run


def _verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) that pass the filters of all orders and link; tokens are fetched for those that pass only."""

    def joined(rows: DataFrame, *columns: str) -> DataFrame:
        for side in ("x", "y"):
            rows = rows.join(nodes.select(F.col("node").alias(f"{side}_node"), *(F.col(c).alias(f"{side}_{c}") for c in columns)), F.col(side) == F.col(f"{side}_node"))
        return rows

    passed = joined(pairs, "prefix_2", "prefix_3").where(F.arrays_overlap("x_prefix_2", "y_prefix_2") & F.arrays_overlap("x_prefix_3", "y_prefix_3")).select("x", "y")
    shared = F.size(F.array_intersect("x_tokens", "y_tokens")).cast("long")
    counted = joined(passed, "n", "tokens").select("x", "y", "x_n", "y_n", shared.alias("shared"))
    return counted.where(100 * F.col("shared") >= percent * (F.col("x_n") + F.col("y_n") - F.col("shared"))).select("x", "y")


def _long_enough(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b).cast("long") >= percent * F.greatest(a, b).cast("long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each node's connected component, by min labels and pointer jumps."""
    both = stage_table(edges.select("x", "y").union(edges.select("y", "x")).distinct(), "edges")
    labels = stage_table(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, both.y == labels.node).groupBy("x").agg(F.min("label").alias("m"))
        step = labels.join(near, labels.node == near.x).select("node", F.least("label", "m").alias("label"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("above"))
        found = stage_table(step.join(jump, F.col("label") == F.col("at"), "left").select("node", F.least("label", "above").alias("label"), "was"), "labels")
        labels = found.select("node", "label")
        if found.where("label <> was").isEmpty():
            return labels


def _with_components(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("comp", F.col("node"))
    return rows.join(labels, "node", "left").withColumn("comp", F.coalesce("label", "node")).drop("label")


def _star_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """One pair per node: the centre that most of its prefix tokens name."""
    centres = entries.groupBy("token").agg(F.min(F.struct("own_share", "node", "comp", "n")).alias("c"), F.max("comp").alias("top"), F.min("comp").alias("low")).where("top > low").select("token", "c")
    votes = entries.join(centres, "token").where((F.col("comp") != F.col("c.comp")) & _long_enough(F.col("n"), F.col("c.n"), percent)).groupBy(F.col("node").alias("x"), F.col("c.node").alias("y")).agg(F.count("*").alias("votes"))
    return votes.groupBy("x").agg(F.max_by("y", F.struct("votes", F.negative("y"))).alias("y")).select("x", "y")


def _mixed_tokens(entries: DataFrame) -> DataFrame:
    """(token, main, rows): tokens of several components, the largest of these, and the nodes that share the token."""
    sizes = entries.groupBy("token", "comp").agg(F.count("*").alias("rows"))
    return sizes.groupBy("token").agg(F.max_by("comp", F.struct("rows", "comp")).alias("main"), F.sum("rows").alias("rows"), F.count("*").alias("comps")).where("comps > 1").select("token", "main", "rows")


def _remaining_pairs(entries: DataFrame, mixed: DataFrame, percent: int) -> DataFrame:
    """All candidate pairs of different components under the first order, of the tokens in ``mixed``.

    Of each token the rows of its largest component are held against the other
    rows only, so the join grows with those others.
    """
    held = entries.join(mixed, "token").select("token", "node", "comp", "n", "place", "main")
    few = held.where("comp <> main").select("token", *(F.col(c).alias(f"x_{c}") for c in ("node", "comp", "n", "place")))
    all_ = held.select("token", "main", *(F.col(c).alias(f"y_{c}") for c in ("node", "comp", "n", "place")))
    total = F.col("x_n").cast("long") + F.col("y_n")
    room = 1 + F.least(F.col("x_n") - F.col("x_place"), F.col("y_n") - F.col("y_place")).cast("long") - 1 + F.least("x_place", "y_place")
    once = (F.col("y_comp") == F.col("main")) | (F.col("x_node") < F.col("y_node"))
    fits = _long_enough(F.col("x_n"), F.col("y_n"), percent) & ((100 + percent) * room >= percent * total)
    return few.join(all_, "token").where((F.col("x_comp") != F.col("y_comp")) & once & fits).select(F.col("x_node").alias("x"), F.col("y_node").alias("y")).distinct()


class _Postings:
    """Rows that hold each token, among the rows of a task."""

    def __init__(self, lists: list[np.ndarray]):
        tokens = np.concatenate(lists)
        rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        self.tokens, at = np.unique(tokens, return_inverse=True)
        order = np.argsort(at, kind="stable")
        self.rows = rows[order]
        self.first = np.searchsorted(at[order], np.arange(len(self.tokens) + 1))
        self.own = np.split(at, np.cumsum([len(x) for x in lists])[:-1])
        self.n = len(lists)

    def shared(self, i: int) -> np.ndarray:
        """For each row, the tokens that it shares with row i."""
        parts = [self.rows[self.first[t] : self.first[t + 1]] for t in self.own[i].tolist()]
        return np.bincount(np.concatenate(parts), minlength=self.n) if parts else np.zeros(self.n, np.int64)


def _block_links(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Of two blocks of a cluster (or one and itself): links that connect components."""
        table = table.combine_chunks()
        node, n, comp = (table.column(c).to_numpy() for c in ("node", "n", "comp"))
        is_low, is_high = (np.asarray(table.column(c)) for c in ("is_low", "is_high"))
        lists = lambda c: [np.asarray(v.values) for v in table.column(c)]
        sets = _Postings(lists("tokens"))
        prefixes = [_Postings(lists(f"prefix_{k}")) for k in (1, 2, 3)]
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while parent.get(c, c) != c:
                parent[c] = c = parent.get(parent[c], parent[c])
            return c

        out = []
        for i in np.flatnonzero(is_low).tolist():
            fits = is_high & (comp != comp[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
            if is_high[i]:  # a block and itself
                fits[: i + 1] = False
            for p in prefixes:
                if not fits.any():
                    break
                fits &= p.shared(i) > 0
            if not fits.any():
                continue
            both = sets.shared(i)
            for j in np.flatnonzero(fits & (100 * both >= percent * (n + n[i] - both))).tolist():
                a, b = root(int(comp[i])), root(int(comp[j]))
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    out.append((int(node[i]), int(node[j])))
        return pa.table([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["x", "y"])

    return run


def _blocks(held: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(node, comp, cluster, block) of the nodes of frequent tokens, and the pairs of blocks (cluster, low, high) to compare.

    A cluster is connected by tokens: each node joins its first frequent token with
    its others, and components are sought among tokens only. In large clusters a
    block holds nodes of about one size and alike first tokens. Two blocks are
    compared if they share a token, of which one of them holds a node outside the
    token's largest component, and if their sizes are within the length bound.
    """
    members = stage_table(held.groupBy("node").agg(F.first("comp").alias("comp"), F.first("n").alias("n"), F.min(F.struct("place", "token")).alias("f")).select("node", "comp", "n", F.col("f.token").alias("first")), "members")
    others = held.join(members.select("node", "first"), "node").where("token <> first").select(F.col("first").alias("x"), F.col("token").alias("y")).distinct()
    chained = components(others).select(F.col("node").alias("first"), "label")
    step = F.floor(F.log("n") / F.lit(math.log(100 / percent))).cast("int")  # nodes that can link are at most one step apart
    base = stage_table(members.join(chained, "first", "left").select("node", "comp", "n", "first", F.coalesce("label", "first").alias("cluster"), step.alias("step")), "clusters")
    sizes = base.groupBy("cluster", "step", "first").agg(F.count("*").alias("rows"), F.sum("n").alias("tokens"))

    def wanted(*keys: str) -> Column:
        own = Window.partitionBy(*keys)
        return F.ceil(F.greatest(F.sum("rows").over(own) / BLOCK_ROWS, F.sum("tokens").over(own) / BLOCK_TOKENS)).cast("int")

    cut = stage_table(sizes.select("cluster", "step", "first", wanted("cluster").alias("parts"), wanted("cluster", "step").alias("heaps"), wanted("cluster", "step", "first").alias("salts")), "cuts")
    salt = F.pmod(F.xxhash64("node"), F.col("salts"))
    block = F.struct(F.when(F.col("parts") > 1, F.col("step")).otherwise(0).alias("step"), F.when(F.col("parts") > 1, F.pmod(F.xxhash64("first", salt), F.col("heaps")).cast("int")).otherwise(0).alias("heap"))
    placed = stage_table(base.join(cut, ["cluster", "step", "first"]).select("node", "comp", "n", "cluster", block.alias("block")), "blocks")

    held = held.select("token", "node", (F.col("comp") != F.col("main")).alias("other"))
    seen = held.join(placed.select("node", "n", "cluster", "block"), "node").groupBy("cluster", "token", "block").agg(F.max("other").alias("other"), F.min("n").alias("least"), F.max("n").alias("most"))
    a = seen.select("cluster", "token", *(F.col(c).alias(f"x_{c}") for c in ("block", "other", "least", "most")))
    b = seen.select("cluster", "token", *(F.col(c).alias(f"y_{c}") for c in ("block", "other", "least", "most")))
    near = (100 * F.col("x_most").cast("long") >= percent * F.col("y_least").cast("long")) & (100 * F.col("y_most").cast("long") >= percent * F.col("x_least").cast("long"))
    pairs = a.join(b, ["cluster", "token"]).where((F.col("x_block") <= F.col("y_block")) & (F.col("x_other") | F.col("y_other")) & near)
    return placed.drop("n"), pairs.select("cluster", F.col("x_block").alias("low"), F.col("y_block").alias("high")).distinct()


def _links_in_clusters(entries: DataFrame, hot: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Links (x, y) between components among the nodes of frequent tokens."""
    held = stage_table(entries.join(hot.select("token", "main"), "token").select("token", "node", "comp", "n", "place", "main"), "hot-entries")
    placed, pairs = _blocks(held, percent)
    pairs = stage_table(pairs, "block-pairs")
    ends = pairs.select("cluster", "low", "high", F.explode(F.array_distinct(F.array("low", "high"))).alias("block"))
    sent = placed.join(ends, ["cluster", "block"])
    rows = sent.join(nodes.select("node", "n", "tokens", "prefix_1", "prefix_2", "prefix_3"), "node")
    wide = rows.select("node", "n", "comp", "tokens", "prefix_1", "prefix_2", "prefix_3", "cluster", "low", "high", (F.col("block") == F.col("low")).alias("is_low"), (F.col("block") == F.col("high")).alias("is_high"))
    return wide.groupBy("cluster", "low", "high").applyInArrow(_block_links(percent), "x long, y long")


def near_duplicates(documents: DataFrame, *, words: int = WORDS, percent: int = PERCENT, star_rounds: int = STAR_ROUNDS) -> DataFrame:
    """One row per document: the size of its set, and the smallest doc_id of its class."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    buckets = 4 * max(shuffle_partitions(spark), docs.rdd.getNumPartitions())
    replies = docs.mapInArrow(_chunk_map(words, buckets, CHUNK_TOKENS, CHUNK_OWNERS), _PARTS).groupBy("bucket").applyInArrow(_share_tokens, _REPLIES)
    told = stage_table(replies.groupBy("chunk").applyInArrow(_alive_sets(percent), _SETS), "alive")
    listed = told.where("doc_ids is not null").select(F.inline(F.arrays_zip("doc_ids", "doc_sizes", "doc_sids"))).toDF("doc_id", "n_shingles", "sid").withColumn("n_shingles", F.col("n_shingles").cast("long"))
    classes = stage_table(listed.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("first_id")), "classes")
    alive = told.where("node is not null").drop("doc_ids", "doc_sizes", "doc_sids")
    # Equal sets of several chunks: the first stands for all.
    nodes = stage_table(alive.groupBy("sid").agg(F.min("node").alias("node")), "nodes")

    share = (F.col("own") / F.col("n")).alias("own_share")
    firsts = alive.select("node", "n", "own", "prefix_1").join(nodes.select("node"), "node", "left_semi")
    entries = stage_table(firsts.select("node", "n", share, "own", F.posexplode("prefix_1").alias("p", "token")).select("node", "n", "own_share", (F.col("own") + F.col("p")).alias("place"), "token"), "entries")
    links, labels = None, None
    for _ in range(star_rounds):
        pairs = _star_pairs(_with_components(entries, labels), percent)
        found = stage_table(_verified(pairs, alive, percent), "links")
        if found.isEmpty():
            break
        links = found if links is None else links.union(found)
        labels = components(links)
    current = stage_table(_with_components(entries, labels), "current")
    mixed = stage_table(_mixed_tokens(current), "mixed")
    more = [_verified(_remaining_pairs(current, mixed.where(F.col("rows") <= HOT_ROWS), percent), alive, percent)]
    hot = mixed.where(F.col("rows") > HOT_ROWS)
    if not hot.isEmpty():
        more.append(_links_in_clusters(current, hot, alive, percent))
    for rows in more:
        found = stage_table(rows, "links")
        if not found.isEmpty():
            links = found if links is None else links.union(found)
            labels = None
    if labels is None and links is not None:
        labels = components(links)

    if labels is None:
        named = classes.select("sid", F.col("first_id").alias("component_id"))
    else:
        linked = stage_table(nodes.select("sid", "node").join(labels, "node").join(classes, "sid").select("sid", "label", "first_id"), "linked")
        least = linked.groupBy("label").agg(F.min("first_id").alias("least_id"))
        named = classes.join(linked.join(least, "label").select("sid", "least_id"), "sid", "left").select("sid", F.coalesce("least_id", "first_id").alias("component_id"))
    # Both sides are tables, so that adaptive execution can split the rows of a large group of equal sets.
    told = listed.where("sid is not null").join(stage_table(named, "named"), "sid").select("doc_id", "n_shingles", "component_id")
    empty = listed.where("sid is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return told.unionByName(empty)
