"""Benchmark decontamination: a prefix-filtered set join with exact windows.

Words are the runs ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text after
A-Z is lower-cased. A window is 13 consecutive words of an item; an item of
fewer words is one window. A document holds a window if the words stand in it
side by side.

Method. A window is the set of its shingles (runs of three words; a window of
fewer is its own shingle). Containment needs every shingle, so with shingles
ordered by rarity the necessary prefix is one token: the rarest. A first pass
counts all benchmark shingles over the whole corpus; a second looks up prefix
tokens only, applies the length bound (the document has as many words) and the
positional bound (the window that the token's place implies lies in the
document), and compares all words. Windows with a shingle that the corpus
lacks are dropped after the first pass.

Scale. The documents are read twice, whatever the size of the benchmark. Up to
``block_bytes`` of item texts are indexed on the driver and broadcast, and both
passes are maps: no document moves. A larger benchmark stays distributed: its
windows are a table; a bit table of their tokens (a false hit costs work only) lets
the first pass send counts of possible tokens, and one of the prefixes lets the
second send places of possible prefixes with the words around them, which are
joined to the windows by token and compared. Keys of that join are the rarest
tokens of windows; adaptive execution may split one that is frequent nevertheless.

Nulls and odd rows: a null or empty text has no words, ``n_hit`` 0 and is not
contaminated. Repeated document rows give repeated results. Repeated items
count once by id; an item with a null id marks words but is in no item list.
An empty benchmark leaves all documents clean. Very long texts are read whole, one at
a time. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage_table
from .textbatch import U64, Words, alphanumeric_words, inside, lower_ascii, release_memory, shingle_hashes, slices

WINDOW = 13
SHINGLE = 3
BLOCK_BYTES = 2 << 20
SHARE = 20  # contaminated if at least one word in so many is hit

_WORD, _FOLD = alphanumeric_words(), lower_ascii()
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class BenchmarkIndex:
    """The windows of a benchmark of bounded size, by word hashes."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        texts = pa.array([t for _, t in items], pa.large_string())
        ids = [None if i is None else str(i) for i, _ in items]
        seen: dict[bytes, int] = {}
        found: list[np.ndarray] = []
        owners: list[set[str]] = []
        for low, high, data, offsets in slices(texts):
            words = Words(data, offsets, _WORD)
            h = words.hashes(_FOLD)
            for row in range(high - low):
                own = h[words.first[row] : words.first[row + 1]]
                for at in range(max(1, len(own) - window + 1) if len(own) else 0):
                    w = own[at : at + window]
                    k = seen.setdefault(w.tobytes(), len(found))
                    if k == len(found):
                        found.append(w)
                        owners.append(set())
                    if ids[low + row] is not None:
                        owners[k].add(ids[low + row])
        self.lengths = np.array([len(w) for w in found], np.int64)
        self.words = np.zeros((len(found), window), U64)
        for k, w in enumerate(found):
            self.words[k, : len(w)] = w
        self.owners = owners
        self.sizes = sorted({int(min(SHINGLE, n)) for n in self.lengths})
        owner, offset, token = [], [], []
        for k, w in enumerate(found):
            own = shingle_hashes(w, min(SHINGLE, len(w)))
            owner.append(np.full(len(own), k))
            offset.append(np.arange(len(own)))
            token.append(own)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        self._owner, self._offset, self._token = join(owner, np.int64), join(offset, np.int64), join(token, U64)
        self.tokens = np.unique(self._token)

    def choose_prefixes(self, counts: np.ndarray) -> None:
        """Keep for each window the token that is rarest by ``counts`` (ties: by hash); none where a count is 0."""
        freq = counts[np.searchsorted(self.tokens, self._token)]
        order = np.lexsort((self._offset, self._token, freq, self._owner))
        head = np.ones(len(order), bool)
        head[1:] = self._owner[order][1:] != self._owner[order][:-1]
        pick = order[head]
        pick = pick[freq[pick] > 0]
        pick = pick[np.argsort(self._token[pick], kind="stable")]
        self.prefix_token, self.prefix_window, self.prefix_offset = self._token[pick], self._owner[pick], self._offset[pick]
        self.prefixes, self.prefix_first, self.prefix_count = np.unique(self.prefix_token, return_index=True, return_counts=True)
        self._owner = self._offset = self._token = None
        self.filter = _bits(self.prefixes)


def _bits(tokens: np.ndarray) -> np.ndarray:
    """A one-hash table that turns most absent tokens away."""
    size = 1 << max(16, int(len(tokens) * 16).bit_length())
    out = np.zeros(size, bool)
    out[(tokens & U64(size - 1)).astype(np.int64)] = True
    return out


def _lookup(tokens: np.ndarray, bits: np.ndarray, probe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``probe`` that hold a token, and which."""
    at = np.flatnonzero(bits[(probe & U64(len(bits) - 1)).astype(np.int64)])
    if not len(at) or not len(tokens):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    k = np.minimum(np.searchsorted(tokens, probe[at]), len(tokens) - 1)
    same = tokens[k] == probe[at]
    return at[same], k[same]


def _count_map(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        bits = _bits(index.tokens)
        total = np.zeros(len(index.tokens), np.int64)
        for batch in batches:
            for _, _, data, offsets in slices(batch.column("text")):
                words = Words(data, offsets, _WORD)
                h = words.hashes(_FOLD)
                for k in index.sizes:
                    _, which = _lookup(index.tokens, bits, shingle_hashes(h, k)[inside(words.first, k)] if len(h) >= k else h[:0])
                    total += np.bincount(which, minlength=len(total))
        release_memory()
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["token", "n"])

    return run


def _hits(index: BenchmarkIndex, words: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start word, window) of every occurrence of a window, by the prefix filter and its bounds, then verified."""
    rows = words.rows
    starts, windows = [], []
    for k in index.sizes:
        if len(h) < k:
            continue
        spots = inside(words.first, k)
        at, which = _lookup(index.prefixes, index.filter, shingle_hashes(h, k)[spots])
        if not len(at):
            continue
        many = index.prefix_count[which]
        flat = np.repeat(index.prefix_first[which], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        window, pos = index.prefix_window[flat], np.repeat(spots[at], many)
        row, start = rows[pos], pos - index.prefix_offset[flat]
        fits = (start >= words.first[row]) & (start + index.lengths[window] <= words.first[row + 1])
        start, window = start[fits], window[fits]
        same = np.ones(len(start), bool)
        for j in range(index.words.shape[1]):
            live = index.lengths[window] > j
            same &= ~live | (h[np.minimum(start + j, len(h) - 1)] == index.words[window, j])
        starts.append(start[same])
        windows.append(window[same])
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(starts), np.concatenate(windows)


def _digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _covered(n: int, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    edge = np.bincount(start, minlength=n + 1) - np.bincount(start + length, minlength=n + 1)
    return np.cumsum(edge)[:n] > 0


def _judge_map(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        clean = _digest(set())
        for batch in batches:
            ids = batch.column("doc_id")
            for low, high, data, offsets in slices(batch.column("text")):
                words = Words(data, offsets, _WORD)
                h, n = words.hashes(_FOLD), high - low
                start, window = _hits(index, words, h)
                hit, n_items, digest = np.zeros(n, np.int64), np.zeros(n, np.int64), [clean] * n
                if len(start):
                    hit = np.bincount(words.rows[_covered(len(h), start, index.lengths[window])], minlength=n)
                    pairs = np.unique(words.rows[start] * len(index.lengths) + window)
                    items: dict[int, set[str]] = {}
                    for p in pairs.tolist():
                        items.setdefault(p // len(index.lengths), set()).update(index.owners[p % len(index.lengths)])
                    for row, own in items.items():
                        n_items[row], digest[row] = len(own), _digest(own)
                count = words.counts
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(low, n), pa.array(count, pa.int64()), pa.array(hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digest, pa.string()), pa.array((hit > 0) & (SHARE * hit >= count))],
                    ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
                )
        release_memory()

    return run


def _window_map(window: int):
    """Items to rows (item, words, tokens), one per window: the hashes of its words and of its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in slices(batch.column("text")):
                words = Words(data, offsets, _WORD)
                h = words.hashes(_FOLD)
                ids = batch.column("item_id").slice(low, high - low).to_pylist()
                for row in range(high - low):
                    own = h[words.first[row] : words.first[row + 1]]
                    cut = [own[at : at + window] for at in range(max(1, len(own) - window + 1) if len(own) else 0)]
                    tokens = [shingle_hashes(w, min(SHINGLE, len(w))).view(np.int64) for w in cut]
                    columns = [pa.array([ids[row]] * len(cut), pa.string()), pa.array([w.tobytes() for w in cut], pa.binary()), pa.array(tokens, pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(columns, ["item", "words", "tokens"])

    return run


def _bit_table(tokens: DataFrame):
    """A broadcast bit table of the tokens, sixteen bits for each, 128 MB at most."""
    size = 1 << min(30, max(16, int(tokens.count() * 16).bit_length()))
    bits = np.zeros(size // 64, np.int64)
    at = F.col("token").bitwiseAND(F.lit(size - 1))
    words = tokens.groupBy(F.floor(at / 64).alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, cast((token & {size - 1}) % 64 as int)))").alias("v"))
    for w, v in words.toLocalIterator():
        bits[w] = v
    return tokens.sparkSession.sparkContext.broadcast(bits.view(np.uint8))


def _possible(bits: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    at = (tokens & U64(8 * len(bits) - 1)).astype(np.int64)
    return np.flatnonzero(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)


def _possible_counts(shared, sizes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in slices(batch.column("text")):
                words = Words(data, offsets, _WORD)
                h = words.hashes(_FOLD)
                for k in sizes:
                    if len(h) >= k:
                        tokens = shingle_hashes(h, k)[inside(words.first, k)]
                        token, n = np.unique(tokens[_possible(shared.value, tokens)], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n, pa.int64())], ["token", "n"])

    return run


def _possible_places(shared, sizes: list[int], window: int):
    """A row per document, and one per place of a possible prefix: its token, place, and the words around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, row = ["row", "doc_id", "n_words", "token", "place", "before", "around"], TaskContext.get().partitionId() << 40
        for batch in batches:
            for low, high, data, offsets in slices(batch.column("text")):
                n, words = high - low, Words(data, offsets, _WORD)
                h, rows = words.hashes(_FOLD), words.rows
                none = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(n)), batch.column("doc_id").slice(low, n), pa.array(words.counts, pa.int64()), none, none, none, pa.nulls(n, pa.binary())], names)
                for k in sizes:
                    spots = inside(words.first, k)
                    tokens = shingle_hashes(h, k)[spots] if len(h) >= k else h[:0]
                    at = _possible(shared.value, tokens)
                    for part in np.array_split(at, max(1, len(at) // 4096)):
                        pos = spots[part]
                        own = rows[pos]
                        begin, end = np.maximum(words.first[own], pos - window + 1), np.minimum(words.first[own + 1], pos + window)
                        around = [h[a:b].tobytes() for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
                        columns = [row + own, words.counts[own], tokens[part].view(np.int64), pos - words.first[own], pos - begin]
                        r, c, t, p, b = (pa.array(x, pa.int64()) for x in columns)
                        yield pa.RecordBatch.from_arrays([r, pa.nulls(len(pos), pa.int64()), c, t, p, b, pa.array(around, pa.binary())], names)
                row += n

    return run


def _by_shuffle(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """The same result with the windows as a distributed table."""
    texts = items.select(F.col("item_id").cast("string").alias("item_id"), "text")
    listed = stage_table(texts.mapInArrow(_window_map(window), "item string, words binary, tokens array<long>").distinct(), "windows")
    tokens = stage_table(listed.select("words", "tokens").distinct().select("words", F.posexplode("tokens").alias("offset", "token")), "tokens")
    sizes = [r[0] for r in listed.select(F.least(F.lit(SHINGLE), F.length("words") / 8).cast("int")).distinct().collect()]
    counts = docs.select("text").mapInArrow(_possible_counts(_bit_table(tokens.select("token").distinct()), sizes), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rarest = tokens.join(counts, "token", "left").groupBy("words").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset")).alias("p"))
    prefixes = stage_table(rarest.where("p.n > 0").select("words", "p.token", "p.offset"), "prefixes")
    found = stage_table(docs.mapInArrow(_possible_places(_bit_table(prefixes.select("token").distinct()), sizes, window), "row long, doc_id long, n_words long, token long, place long, before long, around binary"), "places")

    start, length = F.col("place") - F.col("offset"), (F.length("words") / 8).cast("long")
    same = F.substring("around", (8 * (F.col("before") - F.col("offset")) + 1).cast("int"), F.length("words")) == F.col("words")
    pairs = found.where("token is not null").join(prefixes, "token").where((start >= 0) & (start + length <= F.col("n_words")) & same)
    hits = stage_table(pairs.select("row", start.alias("start"), length.alias("length"), "words"), "hits")
    end = lambda x: x["start"] + x["length"]
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    join = lambda acc, x: F.struct(F.greatest(acc["end"], end(x)).alias("end"), (acc["n"] + F.greatest(F.lit(0), end(x) - F.greatest(acc["end"], x["start"]))).alias("n"))
    spans = hits.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "length"))).alias("spans"))
    covered = spans.select("row", F.aggregate("spans", zero, join)["n"].alias("n_hit"))
    owners = hits.select("row", "words").distinct().join(listed.select("words", "item"), "words").groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    told = found.where("token is null").select("row", "doc_id", "n_words").join(covered, "row", "left").join(owners, "row", "left")
    n_hit, ids = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return told.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), ((n_hit > 0) & (SHARE * n_hit >= F.col("n_words"))).alias("contaminated"))


def _shared_index(documents: DataFrame, items: list, window: int):
    """Build the index, count its shingles over the corpus, choose the prefixes and broadcast the result."""
    context = documents.sparkSession.sparkContext
    index = BenchmarkIndex(items, window)
    counted = context.broadcast(index)
    counts = np.zeros(len(index.tokens), np.int64)
    if len(counts):
        for token, n in documents.select("text").mapInArrow(_count_map(counted), "token long, n long").groupBy("token").agg(F.sum("n")).collect():
            counts[token] = n
    index.choose_prefixes(counts)
    return context.broadcast(index)


def find_contamination(documents: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: words, words inside benchmark windows, and the items these come from."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    if total > block_bytes:
        return _by_shuffle(docs, items, window)
    return docs.mapInArrow(_judge_map(_shared_index(docs, [tuple(r) for r in items.collect()], window)), SCHEMA)
