"""Text and trait functions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

# FNV-1a, 64 bits.
FNV_OFFSET = 0xCBF29CE484222325
FNV_PRIME = 0x100000001B3

# Seconds per duration unit (case-sensitive).
UNIT_SECONDS = {"m": 60.0, "min": 60.0, "h": 3600.0, "hour": 3600.0, "d": 86400.0, "day": 86400.0, "w": 604800.0, "week": 604800.0, "month": 2592000.0, "y": 31536000.0, "year": 31536000.0}

# Words that are no content, and prefixes of trait keys.
STOP_WORDS = frozenset(
    "this that with from have your just they them their what when which would could about there here into than then some more most very really much many like good great best well also even still "
    "movie movies film films review reviewed stars star watch watched story dont didnt isnt thing things make made show shows text phrase".split()
)
LABEL_PREFIXES = ("text ", "phrase ", "act ")


def fnv1a(text: str) -> int:
    h = FNV_OFFSET
    for b in text.encode():
        h = ((h ^ b) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return h


def fnv1a_batch(texts: list[str]) -> np.ndarray:
    """FNV-1a of many texts, one byte place at a time."""
    raw = [t.encode() for t in texts]
    out = np.full(len(raw), FNV_OFFSET, np.uint64)
    longest = max(map(len, raw), default=0)
    if not longest:
        return out
    sizes = np.array([len(r) for r in raw])
    order = np.argsort(-sizes, kind="stable")
    for j in range(longest):
        live = order[: int(np.searchsorted(-sizes[order], -j, "left"))]
        out[live] = (out[live] ^ np.array([raw[i][j] for i in live], np.uint64)) * np.uint64(FNV_PRIME)
    return out


def _fnv1a_batches(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        hashes = fnv1a_batch([t or "" for t in s])
        yield pd.Series([None if t is None else Decimal(int(h)) for t, h in zip(s, hashes, strict=True)], dtype=object)


def fnv1a_column(text: Column) -> Column:
    """FNV-1a 64 as an unsigned decimal."""
    return F.pandas_udf(_fnv1a_batches, DecimalType(20, 0))(text)


def snapshot_filename(subject: str) -> str:
    """A readable prefix of at most 48 characters and the hash of the subject."""
    safe = "".join(c if c.isascii() and c.isalnum() else "_" for c in subject)[:48]
    return f"{safe}-{fnv1a(subject):016x}.json"


def word_count(text: Column) -> Column:
    """Words between white space; the approximate token count."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("long")


def heuristic_tokens(text: Column) -> Column:
    """``max(words * 1.333, characters / 4)``, rounded half to even, at least 1; 0 for the empty text."""
    guess = F.greatest(word_count(text) * F.lit(1.333), F.char_length(text) / F.lit(4.0))
    return F.when(text == "", F.lit(0)).otherwise(F.greatest(F.lit(1), F.rint(guess).cast("long"))).cast("long")


def seconds(amount: float, unit: str) -> float:
    if unit not in UNIT_SECONDS:
        raise ValueError(f"unknown unit of time: {unit}")
    return amount * UNIT_SECONDS[unit]


def trait_values(traits: Column) -> Column:
    """Trait values in key order, joined by spaces: the text that stands for a perception."""
    return F.array_join(F.transform(F.array_sort(F.map_keys(traits)), lambda k: traits[k]), " ")


def trait_pairs(traits: Column) -> Column:
    """``key value`` pairs in key order, joined by spaces: the text that is embedded."""
    return F.array_join(F.transform(F.array_sort(F.map_keys(traits)), lambda k: F.concat_ws(" ", k, traits[k])), " ")


def with_trait(traits: Column, key: str, value: str | Column) -> Column:
    """The traits with one added or replaced."""
    kept = F.map_filter(traits, lambda k, _: k != key)
    return F.map_concat(kept, F.create_map(F.lit(key), F.lit(value)))


def compression_ratio(represented: Column, vectors: Column) -> Column:
    return F.when(vectors == 0, F.lit(0.0)).otherwise(represented / vectors)


def clean_label_column(label: Column) -> Column:
    s = F.trim(F.replace(label, F.lit("_"), F.lit(" ")))
    for prefix in LABEL_PREFIXES:
        s = F.when(F.startswith(s, F.lit(prefix)), F.substr(s, F.lit(len(prefix) + 1))).otherwise(s)
    return F.trim(s)


_TERM = "[a-zA-Záéíóúñ]+"


def common_terms(labels: DataFrame, keys: list[str], label: str, count: str, k: int = 4) -> DataFrame:
    """The k most frequent content words of each key's labels, weighted by count."""
    from pyspark.sql import Window

    words = labels.select(*keys, F.col(count).alias("_n"), F.explode(terms_column(F.col(label))).alias("term"))
    kept = words.groupBy(*keys, "term").agg(F.sum("_n").cast("long").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "term"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= k)


def terms_column(text: Column) -> Column:
    """The content words of a text, in order."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(f"({_TERM})"), F.lit(1)), lambda t: (F.char_length(t) >= 4) & ~t.isin(*STOP_WORDS))
