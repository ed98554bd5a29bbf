"""Exact token counts at every prefix of a text, by dynamic programming.

The model is a sentencepiece BPE model with byte fallback, no normalisation and
a dummy first space (all checked when it is loaded). Spaces become ``U+2581``.

Method. For greedy BPE, the tokens of a prefix ``s[:i]`` are the tokens of
``s[:i - len(t)]`` and one last token ``t``, where ``t`` is the only vocabulary
entry ending at ``i`` that merging keeps apart from the last token before it
(a pair is kept apart if encoding the two strings together gives these two
tokens). So a table over prefixes, last token and count, gives the exact count
at every prefix from the counts before it; no prefix is encoded again. Merging
never joins over a border "other character, then space", because no vocabulary
entry has a space after another character (checked too), so the table of a
text is the running sum of the tables of its segments, and equal segments share
a table.

``PrefixCounter.prefix_counts`` gives the table of a text;
``tokens_before`` and ``longest_prefix`` answer budget and truncation questions
from it. ``count_tokens`` maps a whole table.

Scale: a narrow map, nothing moves; the model is read on the driver and
broadcast (its size is checked against ``model_bytes``). Tables of segments are
kept in a cache of bounded size in each Python worker. Segments longer than
``long_segment`` characters are handled alike but not kept.

Nulls and odd rows: a null text counts as empty, 0 tokens. Rows are judged one
by one, so repeated rows give repeated results. Bytes that aren't UTF-8 count as
replacement characters. Extra columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import texts_of

LIMIT = 4096
MODEL_BYTES = 64 << 20
CACHE_SEGMENTS = 1_000_000
LONG_SEGMENT = 64
SPACE = "▁"

# A segment: a run of spaces with the run of other characters after it.
_SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class PrefixCounter:
    """Prefix tables under one BPE vocabulary: piece -> score, higher merged first."""

    def __init__(self, scores: dict[str, float], cache_segments: int = CACHE_SEGMENTS):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.cache_segments = cache_segments
        self.totals: dict[str, int] = {}
        self.apart: dict[tuple[str, str], bool] = {}

    @classmethod
    def from_model(cls, model: bytes) -> PrefixCounter:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        probe = "  Ａ a  　b "
        if sp.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError("the model normalises texts")
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        pieces = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        if sum(sp.is_byte(i) for i in range(n)) != 256:
            raise ValueError("the model has no byte fallback")
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("pieces of the model span word borders")
        return cls(pieces)

    def _merged(self, text: str) -> list[str]:
        """Greedy BPE: the best pair merges, the leftmost of equals."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _keeps_apart(self, a: str, b: str) -> bool:
        found = self.apart.get((a, b))
        if found is None:
            if len(self.apart) > self.cache_segments:
                self.apart.clear()
            known = len(b) == 1 or b in self.scores
            found = self.apart[a, b] = known and self._merged(a + b) == ([a, b] if a else [b])
        return found

    def table(self, segment: str) -> list[int]:
        """Token counts of ``segment[:0]`` to the whole segment."""
        scores, longest, apart = self.scores, self.longest, self.apart
        last, counts = [""], [0]
        for i in range(1, len(segment) + 1):
            for k in range(i - 1, max(-1, i - longest - 1), -1):  # one k fits, most often a near one
                piece = segment[k:i]
                kept = apart.get((last[k], piece))
                if kept is None:
                    kept = self._keeps_apart(last[k], piece)
                if kept:
                    last.append(piece)
                    counts.append(counts[k] + (1 if piece in scores else len(piece.encode())))
                    break
        return counts

    def total(self, segment: str) -> int:
        found = self.totals.get(segment)
        if found is None:
            found = self.table(segment)[-1]
            if len(segment) <= LONG_SEGMENT:
                if len(self.totals) >= self.cache_segments:
                    self.totals.clear()
                self.totals[segment] = found
        return found

    def segments(self, text: str) -> list[str]:
        return _SEGMENT.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def count(self, text: str) -> int:
        known = self.totals.get
        counts = list(map(known, found := self.segments(text)))
        if None in counts:
            counts = [self.total(s) if c is None else c for s, c in zip(found, counts, strict=True)]
        return sum(counts)

    def prefix_counts(self, text: str) -> list[int]:
        """Tokens of ``text[:i]`` at place i. The empty prefix has none."""
        out, base = [], 0
        for s in self.segments(text):
            own = self.table(s)
            out += [base + c for c in own[1:]]
            base += own[-1]
        return [0, *out[1:]] if text else [0]

    def tokens_before(self, text: str, characters: int) -> int:
        return self.prefix_counts(text)[min(characters, len(text))]

    def longest_prefix(self, text: str, budget: int) -> int:
        """Characters of the longest prefix within ``budget`` tokens."""
        return max(i for i, c in enumerate(self.prefix_counts(text)) if c <= budget)


_COUNTERS: dict[int, PrefixCounter] = {}


def _count_map(shared, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = shared.value
        counter = _COUNTERS.get(hash(frozenset(scores)))
        if counter is None:
            _COUNTERS.clear()
            counter = _COUNTERS[hash(frozenset(scores))] = PrefixCounter(scores)
        for batch in batches:
            counts = [0 if t is None else counter.count(t) for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def count_tokens(documents: DataFrame, model: bytes, *, limit: int = LIMIT) -> DataFrame:
    """One row per document: UTF-8 bytes, tokens of the whole text, and whether these exceed ``limit``."""
    if len(model) > MODEL_BYTES:
        raise ValueError("the model is too large to broadcast")
    shared = documents.sparkSession.sparkContext.broadcast(PrefixCounter.from_model(model).scores)
    text = F.col("text").cast("string")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"))
    return docs.mapInArrow(_count_map(shared, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def read_tokenizer(name: str) -> bytes:
    """Bytes of a public tokenizer's file, by the path that its package gives."""
    import public_tokenizers

    with open(os.fspath(public_tokenizers.path(name)), "rb") as f:
        return f.read()


__all__ = ["PrefixCounter", "count_tokens", "read_tokenizer"]
