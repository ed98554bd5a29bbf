"""Quality rules: counts of each text, and lines that many documents of a host share.

Base counts, over words ``[^\\x20\\x09-\\x0D]+`` of the whole text: words, their
code points, characters of ``[#*$%&|<>]``, lines (split at ``\\n``, with a word)
equal to an earlier line, and words inside 3-word windows that occur twice or
more. A document fails the base rules with fewer than ``min_words`` words, or
if more than half of its words lie in repeated windows.

Method. Each line is normalised (A-Z lower-cased, white space runs as one) and
hashed. Distinct documents are counted for each host and line; exact copies of
one text count as one document (removing copies is the work of another operator),
near copies count each. Lines in more than ``line_documents`` documents
are removed, whatever the size of the host, and a document that keeps less than
``keep_share`` of its words is rejected. ``clean_texts`` returns the texts
without the removed lines; all other lines, empty ones too, stay as they are.

Scale. One map makes a narrow row per document (counts, line hashes, line
words), written to the shared folder. The count shuffles 24-byte rows, first
reduced to one per (host, line, text hash) and then counted with map-side sums, so
a line that a third of all documents hold is summed before it moves. The lines
above the limits are few (each needs many documents); they are broadcast only
up to ``broadcast_lines`` of them and joined by shuffle beyond. Verdicts are
summed per document before the last shuffle. Removal is a second map over the
texts; beyond ``broadcast_lines`` each text is joined to its own removed lines.
``measure`` makes the tables that both share, to be made once.

Nulls and odd rows: a null text has no words and fails the base rules; a null
host is a host of its own. Repeated rows get the same result each. Very long texts
are read whole. Extra columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage_table
from .textbatch import U64, Words, inside, lower_ascii, mix, release_memory, shingle_hashes, slices, span_hashes, white_space_separates

MIN_WORDS = 50
LINE_DOCUMENTS = 30
KEEP_SHARE = 0.25
BROADCAST_LINES = 200_000

_WORD, _FOLD = white_space_separates(), lower_ascii()
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_NAMES = ["doc_id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "line_words"]
_SCHEMA = "doc_id long, host string, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, line_words array<int>"


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags: the value occurs twice or more in its row; it occurred before in its row."""
    key = mix(h + rows.astype(U64) * U64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice, later = np.zeros(len(h), bool), np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    later[order[1:][same]] = True
    return twice, later


def _lines(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Spans between line feeds, as :class:`Words` whose words are the lines that are not empty."""
    line = np.ones(256, bool)
    line[10] = False
    return Words(data, offsets, line)


def _line_hashes(data: np.ndarray, offsets: np.ndarray, words: Words) -> tuple[np.ndarray, ...]:
    """Start, end, row, words and hash of the normalised words of each line with a word."""
    spans = _lines(data, offsets)
    first = np.searchsorted(words.start, spans.start)
    size = np.searchsorted(words.start, spans.end) - first
    full = size > 0
    first, size = first[full], size[full]
    folded = words.hashes(_FOLD)
    order = np.arange(len(folded)) - np.repeat(first, size) if len(first) else np.empty(0, np.int64)
    sums = np.zeros(len(folded) + 1, U64)
    np.cumsum(mix(folded + order.astype(U64)), out=sums[1:])
    return spans.start[full], spans.end[full], spans.rows[full], size, mix(sums[first + size] - sums[first] + size.astype(U64)).view(np.int64)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in slices(batch.column("text")):
            n = high - low
            words = Words(data, offsets, _WORD)
            counts, rows = words.counts, words.rows
            in_word = _WORD[data] & ((data & 0xC0) != 0x80)
            exact = words.hashes()
            spots = inside(words.first, 3)
            repeated = np.zeros(n, np.int64)
            if len(spots):
                twice, _ = _repeats(shingle_hashes(exact, 3)[spots], rows[spots])
                at = spots[twice]
                edge = np.bincount(at, minlength=len(exact) + 1) - np.bincount(at + 3, minlength=len(exact) + 4)[: len(exact) + 1]
                repeated = _sums(np.cumsum(edge)[: len(exact)] > 0, words.first)
            start, end, line_rows, size, hashes = _line_hashes(data, offsets, words)
            _, later = _repeats(span_hashes(data, start, end), line_rows)
            dup = np.bincount(line_rows[later], minlength=n)
            edges = np.searchsorted(line_rows, np.arange(n + 1))
            edges = pa.array(edges, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(low, n), batch.column("host").slice(low, n), batch.column("text_hash").slice(low, n), pa.array(counts, pa.int64()), pa.array(_sums(in_word, offsets)), pa.array(_sums(_SYMBOL[data], offsets)),
                    pa.array(dup, pa.int64()), pa.array(repeated, pa.int64()), pa.ListArray.from_arrays(edges, pa.array(hashes)), pa.ListArray.from_arrays(edges, pa.array(size, pa.int32())),
                ],
                _NAMES,
            )
    release_memory()


def line_limits(features: DataFrame, *, line_documents: int) -> DataFrame:
    """(host, line) of the lines in more documents of the host than the limit allows."""
    lines = features.select("host", "text_hash", F.explode(F.array_distinct("lines")).alias("line")).distinct().groupBy("host", "line").agg(F.count("*").alias("n"))
    return lines.where(F.col("n") > line_documents).select("host", "line")


def _text_hash(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def measure(documents: DataFrame, *, host: str = "source", line_documents: int = LINE_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """The features of each document, and (host, line) of the lines above the limits, as tables."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(host).cast("string").alias("host"), _text_hash(F.col("text")).alias("text_hash"))
    features = stage_table(docs.mapInArrow(_features, _SCHEMA).withColumn("row", F.monotonically_increasing_id()), "quality")
    return features, stage_table(line_limits(features, line_documents=line_documents), "lines")


def _in_common(features: DataFrame, common: DataFrame, few: bool) -> DataFrame:
    """The lines of each document that are above the limits."""
    lines = features.select("row", "host", "text_hash", F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select("row", "host", "text_hash", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))
    right = common.select(F.col("host").alias("common_host"), F.col("line").alias("common_line"))
    match = (F.col("line") == F.col("common_line")) & F.col("host").eqNullSafe(F.col("common_host"))
    return lines.join(F.broadcast(right) if few else right, match)


def judge_quality(
    documents: DataFrame, *, host: str = "source", min_words: int = MIN_WORDS, line_documents: int = LINE_DOCUMENTS, keep_share: float = KEEP_SHARE, broadcast_lines: int = BROADCAST_LINES, measured: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """One row per document: the base counts, words in lines above the limits, and the verdict."""
    features, common = measured or measure(documents, host=host, line_documents=line_documents)
    few = common.limit(broadcast_lines + 1).count() <= broadcast_lines
    removed = _in_common(features, common, few).groupBy("row").agg(F.sum("words").alias("removed_words"))
    joined = features.drop("lines", "line_words", "text_hash").join(removed, "row", "left")
    n, gone = F.col("n_words"), F.coalesce("removed_words", F.lit(0))
    failed = (n < min_words) | (100 * F.col("n_repeat_words") > 50 * n)
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), gone.alias("removed_words"), (~failed & ((n - gone) >= F.lit(keep_share) * n)).alias("kept")
    )


def _clean_map(shared, host: str):
    """Texts without the lines whose hashes are shared for their host, or stand in their row's column ``gone``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for low, high, data, offsets in slices(batch.column(at)):
                part = batch.slice(low, high - low)
                start, _, rows, _, hashes = _line_hashes(data, offsets, Words(data, offsets, _WORD))
                hit = np.zeros(len(rows), bool)
                if shared is not None:
                    hosts = part.column(host).dictionary_encode(null_encoding="encode")
                    code = hosts.indices.to_numpy()[rows]
                    for k, name in enumerate(hosts.dictionary.to_pylist()):
                        if name in shared.value:
                            own = code == k
                            hit[own] = np.isin(hashes[own], shared.value[name])
                else:
                    gone = part.column("gone")
                    owners = np.repeat(np.arange(len(gone)), gone.value_lengths().fill_null(0).to_numpy())
                    salted = lambda h, r: mix(h.view(U64) + r.astype(U64) * U64(0x9E3779B97F4A7C15))
                    hit = np.isin(salted(hashes, rows), salted(gone.flatten().to_numpy(), owners))
                    part = part.drop_columns(["gone"])
                if hit.any():
                    feeds = np.zeros(len(data) + 1, np.int64)
                    np.cumsum(data == 10, out=feeds[1:])
                    place = feeds[start] - feeds[offsets[rows]]
                    texts = part.column(at)
                    cut = [data[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                    cut = [None if null else t for t, null in zip(cut, texts.is_null().to_pylist(), strict=True)]
                    drop: dict[int, set[int]] = {}
                    for row, k in zip(rows[hit].tolist(), place[hit].tolist(), strict=True):
                        drop.setdefault(row, set()).add(k)
                    for row, places in drop.items():
                        cut[row] = b"\n".join(x for k, x in enumerate(cut[row].split(b"\n")) if k not in places)
                    part = part.set_column(at, batch.schema.field(at), pa.array(cut, pa.binary()).cast(texts.type, safe=False))
                yield part
        release_memory()

    return run


def clean_texts(
    documents: DataFrame, *, host: str = "source", line_documents: int = LINE_DOCUMENTS, broadcast_lines: int = BROADCAST_LINES, measured: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """The documents, all columns kept, with the lines above the limits removed from ``text``."""
    features, common = measured or measure(documents, host=host, line_documents=line_documents)
    docs = documents.withColumns({"text": F.col("text").cast("string"), host: F.col(host).cast("string")})
    lines = common.limit(broadcast_lines + 1).collect() if broadcast_lines else None
    if lines is not None and len(lines) <= broadcast_lines:
        found: dict[str | None, list[int]] = {}
        for r in lines:
            found.setdefault(r["host"], []).append(r["line"])
        if not found:
            return docs
        shared = documents.sparkSession.sparkContext.broadcast({h: np.array(x, np.int64) for h, x in found.items()})
        return docs.mapInArrow(_clean_map(shared, host), docs.schema)
    gone = _in_common(features, common, False).groupBy(F.col("host").alias("gone_host"), F.col("text_hash").alias("gone_text")).agg(F.collect_set("line").alias("gone"))
    joined = docs.join(gone, (_text_hash(F.col("text")) == F.col("gone_text")) & F.col(host).eqNullSafe(F.col("gone_host")), "left").select(*docs.columns, "gone")
    return joined.mapInArrow(_clean_map(None, host), docs.schema)
