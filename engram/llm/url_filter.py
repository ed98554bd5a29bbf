"""URL verdicts: longest matching rule, else exact membership by a Bloom filter cascade.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased. Path: from there up to ``?``, ``#`` or the end. A rule (host, path)
fits its host and all subdomains, if the path starts with the rule's; the
longest rule wins. A url that no rule fits is blocked if its host, or a domain
above it, is on the list.

Method. The key universe is every host of the corpus with every domain above
it. Level 0 is a Bloom filter of the listed keys; level 1 of the other keys of
the universe that level 0 lets pass; level 2 of the listed keys that level 1
lets pass; and so on, until a level lets nothing pass wrongly. The first level
that turns a key away decides it, without error for every key of the universe,
so urls are judged by bit tests on literals, with no join.

Scale. The universe is a distinct over hosts (pre-aggregated, so a hot host is
one row per task). The first level has the false positive rate that makes the
whole cascade smallest, the others one half. Only listed keys that the corpus
has are encoded, in some ten to twelve bits each (a million in about 1.5 MB,
whatever the number of other keys), so the bits go with the tasks as one binary
literal a level. More than ``max_bits`` in all (128 MB, some 90 million listed keys of the corpus)
are an error, never another method.

Nulls and odd rows: a null url, or one without ``://``, has empty host and path,
fits no rule and isn't listed: allowed. Repeated rows are judged each. With an
empty list only rules block. Very long urls are judged whole. Extra columns are ignored.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage_table

#: (host, path, verdict)
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Domains of junk sites, each under three domains; the second half are on the list though the test pages have none of them.
LISTED = tuple(
    f"{name}.example.{top}"
    for name in ("ads-track", "spam-farm", "casino-win", "adult-x", "cheap-pills", "free-bets", "ad-track", "spam-farms", "casino-wins", "adult-xx", "cheap-pill", "free-bet")
    for top in ("com", "net", "org")
)
MAX_LEVELS = 80
MAX_BITS = 1 << 30

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, says in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the last to be tested wins
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        rule, verdict = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def domains_of(host: Column) -> Column:
    """The host and every domain above it; none for an empty host."""
    labels = F.split(host, r"\.")
    every = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(every)


class Level:
    """One Bloom filter: ``bits`` positions, ``hashes`` per key, the bits as one binary literal."""

    def __init__(self, number: int, keys: DataFrame, n: int, rate: float):
        self.number = number
        self.hashes = max(1, round(-math.log2(rate)))
        self.bits = 64 * max(1, math.ceil(1.4427 * n * -math.log2(rate) / 64))
        at = keys.select(F.explode(F.array(*self._places(F.col("key")))).alias("p"))
        words = at.groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("v"))
        data = bytearray(self.bits // 8)
        for w, v in words.toLocalIterator():
            struct.pack_into("<q", data, 8 * w, v)
        self.data = F.lit(bytes(data))

    def _places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(self.number), F.lit(j), key), F.lit(self.bits)).cast("long") for j in range(self.hashes)]

    def passes(self, key: Column) -> Column:
        found = None
        for p in self._places(key):
            byte = F.ascii(F.decode(F.substring(self.data, F.floor(p / 8).cast("int") + 1, 1), "ISO-8859-1"))
            one = F.getbit(byte, (p % 8).cast("int")) == 1
            found = one if found is None else found & one
        return found


class Cascade:
    """Levels that decide exactly, for every key of ``universe``, whether it is listed."""

    def __init__(self, universe: DataFrame, listed: DataFrame, max_bits: int = MAX_BITS):
        listed = listed.select("key").distinct()
        inside = stage_table(universe.join(listed, "key", "left_semi"), "listed")
        outside = stage_table(universe.join(listed, "key", "left_anti"), "unlisted")
        self.levels: list[Level] = []
        self.bits = 0
        encoded, other = inside, outside
        n, m = inside.count(), outside.count()
        rate = min(0.5, math.sqrt(0.5) * n / m) if n and m else 0.5
        while n:
            self.bits += math.ceil(1.4427 * n * -math.log2(rate))
            if len(self.levels) > MAX_LEVELS:
                raise ValueError("two keys, one listed and one not, agree at every level")
            if self.bits > max_bits:
                raise ValueError(f"the list needs more than {max_bits} bits for the keys that the corpus has")
            self.levels.append(level := Level(len(self.levels), encoded, n, rate))
            encoded, other = stage_table(other.where(level.passes(F.col("key"))), "passed"), encoded
            n, rate = encoded.count(), 0.5

    def holds(self, key: Column) -> Column:
        """Whether a key of the universe is listed: even levels that turn it away say no, odd ones yes."""
        found = F.lit(len(self.levels) % 2 == 1)
        for k in range(len(self.levels) - 1, -1, -1):
            found = F.when(~self.levels[k].passes(key), F.lit(k % 2 == 1)).otherwise(found)
        return found


def judge_urls(pages: DataFrame, listed: DataFrame, *, rules: Sequence[tuple[str, str, str]] = RULES, max_bits: int = MAX_BITS) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every url; ``listed`` has the blocked domains in column ``key``."""
    url = F.col("url").cast("string")
    parsed = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = parsed.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"))
    universe = parsed.select("host").distinct().select(F.explode(domains_of(F.col("host"))).alias("key")).distinct()
    judged = ruled.withColumn("is_listed", F.exists(domains_of(F.col("host")), Cascade(universe, listed, max_bits).holds))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("is_listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))
