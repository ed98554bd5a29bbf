"""Source divergence audit: how the words of a source differ from its language and from its other sources.

Terms are runs of letters, ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+``, with A-Z lower-cased.
A language keeps the V terms that stand in at least ``least`` of its documents. A
group (language, source), or a language as a whole, gives a kept term of ``count``
places the weight p = 1 + floor(10^9 (count + 2) / (N + 2 V)), N being its places of
kept terms. Two weights diverge by floor((p - q)^2 / (p + q)). The result tells

* ``pair``: for each group the divergence from each other source of its language, summed over kept terms;
* ``term``: for each group the ``top`` terms that it has more of than its language has, by divergence.

Methods.

* *Sparse pairs, corrected by a baseline.* A term that a group lacks has the group's
  baseline weight, so V baselines are summed at once, and only terms that a group
  has correct the sum: those of one group as a histogram of counts (few are
  distinct) against the baselines of the others, those that two groups share term by term.
  The latter are pairs of sources within a term; they are summed inside tasks, for
  blocks of ``BLOCK`` sources against each other, and never become rows.
* *Radix select.* ``radix_top`` finds each group's k-th value by histograms over ten bits
  at a time, highest first, counting only rows that agree with the threshold so far. Rows above the threshold
  are in; ties refine by the item's UTF-8 bytes in the same way, two bytes first and twice as many each round.

Arithmetic is exact: weights are whole numbers up to 10^9 + 1, made in decimals; squares
of differences fit 64 bits; sums are of 64 bits.

Scale. One shuffle of terms, summed per task first: a word goes once per (language,
source, task), whatever its frequency. Everything after works on the counts table: its
rows are distinct (language, source, term), so no key is hot beyond the number of terms (of a
source) or sources (of a term). The result has a row for each pair of sources of a language.

Nulls and odd rows: null text, language and source are empty strings. A group without terms
has the baseline everywhere; a language without kept terms has pairs of value 0 and no
terms. Repeated rows count each. Very long texts are read whole. Bytes that aren't UTF-8
read as replacement characters, which are letters here. An empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, stage_table
from .textbatch import Words, letters_only, lower_ascii, release_memory, slices

LEAST_DOCUMENTS = 10
TOP = 10
UNIT = 1_000_000_000
BLOCK = 256
DIGIT_BITS = 10
VALUE_BITS = 30
HELD = 1 << 20
_CHUNK = 1 << 18
_SLICE = 1 << 20
_BATCH = 1 << 14
_COUNTED = ["lang", "source", "term", "n", "docs"]
_FOLD, _TERM = lower_ascii(), letters_only()


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of a task's documents, each key once per HELD rows or so."""
    held: list[pa.Table] = []

    def combined() -> pa.Table:
        sums = pa.concat_tables(held).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
        return sums.rename_columns({"n_sum": "n", "docs_sum": "docs"}).select(_COUNTED)

    for batch in batches:
        for low, high, data, offsets in slices(batch.column("text"), _SLICE):
            rows = pa.table({c: batch.column(c).slice(low, high - low) for c in ("lang", "source")})
            # Group numbers in the slice's rows, by (lang, source).
            names = rows.group_by(["lang", "source"]).aggregate([])
            where = {(r["lang"], r["source"]): k for k, r in enumerate(names.to_pylist())}
            group = np.array([where[x] for x in zip(rows["lang"].to_pylist(), rows["source"].to_pylist(), strict=True)], np.int64)
            words = Words(data, offsets, _TERM)
            size = words.end - words.start
            ends = np.zeros(len(size) + 1, np.int32)
            np.cumsum(size, out=ends[1:])
            letters = _FOLD[data[_TERM[data]]]
            coded = pa.StringArray.from_buffers(len(size), pa.py_buffer(ends), pa.py_buffer(letters)).dictionary_encode()
            kinds = max(1, len(coded.dictionary))
            in_row, n = np.unique(words.rows * kinds + coded.indices.to_numpy(), return_counts=True)
            keys, at = np.unique(group[in_row // kinds] * kinds + in_row % kinds, return_inverse=True)
            places, docs = np.zeros(len(keys), np.int64), np.bincount(at, minlength=len(keys)).astype(np.int64)
            np.add.at(places, at, n)
            pick = lambda c, k: names[c].combine_chunks().take(pa.array(k))
            held.append(pa.table([pick("lang", keys // kinds), pick("source", keys // kinds), coded.dictionary.take(pa.array(keys % kinds)), pa.array(places), pa.array(docs)], _COUNTED))
            # The document itself: the empty term.
            every = np.bincount(group, minlength=len(names))
            held.append(pa.table([names["lang"], names["source"], pa.array([""] * len(names)), pa.array(every), pa.array(every)], _COUNTED))
        if sum(map(len, held)) > HELD:
            held = [combined()]
            if len(held[0]) > HELD // 2:
                yield from held[0].combine_chunks().to_batches(_BATCH)
                held = []
    if held:
        yield from combined().combine_chunks().to_batches(_BATCH)
    release_memory()


def term_counts(documents: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): places and documents of each term; '' stands for the document itself. Dealt by (lang, term)."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    counted = documents.select(name("lang"), name("source"), name("text")).mapInArrow(_count_terms, "lang string, source string, term string, n long, docs long")
    dealt = counted.repartition(shuffle_partitions(documents.sparkSession), "lang", "term")
    return dealt.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def weight(count: Column, places: Column, kept: Column) -> Column:
    """1 + floor(UNIT (count + 2) / (places + 2 kept)), exact for counts beyond 64 bits of the product too."""
    over = (count + 2).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return (F.call_function("div", over, (places + 2 * kept).cast("decimal(20,0)")) + 1).cast("long")


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def radix_top(rows: DataFrame, group: Sequence[str], value: str, item: str, k: int, *, bits: int = VALUE_BITS) -> DataFrame:
    """The ``k`` first rows of each group by value (descending, from 0 to below 2^bits), then item by its bytes; items of a group differ."""
    group = list(group)
    found = stage_table(rows.withColumn("bound", F.lit(0).cast("long")), "radix")
    keys, size = [F.col(g) for g in group], F.lit(k)

    def narrowed(digit: Column, falling: bool, inside: Column, need: Column) -> DataFrame:
        """(group, digit_at, need_in): the digit at which counts of rows ``inside`` reach ``need``, and what is still wanted there."""
        tally = found.where(inside).groupBy(*group, digit.alias("digit_at")).agg(F.count("*").alias("n"), F.first(need).alias("need_in"))
        order = F.desc("digit_at") if falling else F.asc("digit_at")
        upto = tally.withColumn("upto", F.sum("n").over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
        reached = upto.where((F.col("upto") >= F.col("need_in")) & (F.col("upto") - F.col("n") < F.col("need_in")))
        return reached.select(*group, "digit_at", (F.col("need_in") - F.col("upto") + F.col("n")).alias("need_in"), (F.col("n") > F.col("need_in") - F.col("upto") + F.col("n")).alias("split"))

    found = found.withColumn("need", size)
    top = -(-bits // DIGIT_BITS) * DIGIT_BITS
    for shift in range(top - DIGIT_BITS, -1, -DIGIT_BITS):
        digit = F.shiftright(F.col(value), shift)
        within = (F.shiftright(F.col(value), shift + DIGIT_BITS) == F.col("bound")) & (F.col("need") > 0)
        at = stage_table(narrowed(digit, True, within, F.col("need")).drop("split"), "digits")
        joined = found.join(at, group, "left")
        # Without a digit the group has no more than k rows: all stay, the bound stays below them.
        bound = F.coalesce("digit_at", F.lit(0).cast("long"))
        found = stage_table(joined.where(digit >= bound).select(*rows.columns, bound.alias("bound"), F.coalesce("need_in", F.lit(0)).cast("long").alias("need")), "radix")
    # Rows at the bound are ties for the last ``need`` places of their group.
    tied = (F.col(value) == F.col("bound")) & (F.col("need") > 0)
    found = found.select(*rows.columns, F.when(tied, F.col("need")).otherwise(0).alias("need"))
    at_byte, width = 1, 2
    while True:
        piece = F.hex(F.substring(F.encode(F.col(item), "UTF-8"), at_byte, width))
        at = stage_table(narrowed(piece, False, F.col("need") > 0, F.col("need")), "pieces")
        joined = found.join(at, group, "left")
        piece_is = F.col("digit_at")
        stays = (F.col("need") == 0) | piece_is.isNull() | (piece <= piece_is)
        need = F.when((F.col("need") > 0) & (piece == piece_is) & F.col("split"), F.col("need_in")).otherwise(0)
        found = stage_table(joined.where(stays).select(*rows.columns, need.alias("need")), "radix")
        if at.where("split").isEmpty():
            return found.select(*keys, *[c for c in rows.columns if c not in group])
        at_byte, width = at_byte + width, 2 * width


def _shared_sums(width: int):
    """Sums over shared terms of what two groups' own weights change, per pair of sources.

    Rows come sorted by (lang, block, other, term); a term's sources of ``block``, ``width`` of them at
    most, meet those of ``other``. Sums of a block pair stay in a square of numbers.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        state: dict = {"at": None}

        def flush() -> Iterator[pa.RecordBatch]:
            if state["at"] is not None:
                lang, block, other = state["at"]
                a, b = np.nonzero(state["sums"])
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a)), pa.array((a + block * width).astype(np.int32)), pa.array((b + other * width).astype(np.int32)), pa.array(state["sums"][a, b])], ["lang", "a", "b", "total"])
            state["at"] = None

        def run(part: pa.Table) -> None:
            """Whole terms of one block pair, expanded at most _CHUNK pairs at a time (or one row against its term)."""
            term = part.column("term").to_numpy()
            mine = part.column("mine").to_numpy(zero_copy_only=False)
            source, p, base = (part.column(c).to_numpy() for c in ("number", "p", "base"))
            # A term's sources of ``other`` are a run of rows; each of its sources of ``block`` meets the run.
            starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
            ends = np.r_[starts[1:], len(term)]
            right = part.column("theirs").to_numpy(zero_copy_only=False)
            order = np.flatnonzero(right)
            low, high = np.searchsorted(order, starts), np.searchsorted(order, ends)
            left = np.flatnonzero(mine)
            of = np.searchsorted(starts, left, "right") - 1
            many = high[of] - low[of]
            cut = np.r_[0, np.flatnonzero(np.diff(np.cumsum(many) // _CHUNK)) + 1, len(left)]
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                n = many[lo:hi]
                x = np.repeat(left[lo:hi], n)
                y = order[np.repeat(low[of[lo:hi]] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(len(x))] if len(x) else x
                keep = source[x] < source[y]
                x, y = x[keep], y[keep]
                f = lambda u, v: (u - v) * (u - v) // (u + v)
                change = f(p[x], p[y]) - f(p[x], base[y]) - f(base[x], p[y]) + f(base[x], base[y])
                np.add.at(state["sums"], (source[x] % width, source[y] % width), change)

        def take(table: pa.Table) -> Iterator[pa.RecordBatch]:
            keys = list(zip(table.column("lang").to_pylist(), table.column("block").to_pylist(), table.column("other").to_pylist(), strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if keys[lo] != state["at"]:
                    yield from flush()
                    state.update(at=keys[lo], sums=np.zeros((width, width), np.int64))
                run(table.slice(lo, hi - lo).combine_chunks())

        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            # The last term may go on in the next batch.
            last = table.slice(table.num_rows - 1).to_pylist()[0]
            back = table.num_rows - 1
            term, lang = table.column("term"), table.column("lang")
            while back and term[back - 1].as_py() == last["term"] and lang[back - 1].as_py() == last["lang"] and table.column("block")[back - 1].as_py() == last["block"] and table.column("other")[back - 1].as_py() == last["other"]:
                back -= 1
            if back:
                yield from take(table.slice(0, back))
                held = table.slice(back).combine_chunks().to_batches()
        if held:
            yield from take(pa.Table.from_batches(held))
        yield from flush()
        release_memory()

    return sums


def _shared(counts: DataFrame, groups: DataFrame, width: int) -> DataFrame:
    """(lang, a, b, total) for numbers a < b of sources of a language."""
    blocks = groups.groupBy("lang").agg((F.floor((F.count("*") - 1) / width)).cast("int").alias("last_block"))
    named = counts.join(F.broadcast(blocks) if blocks.count() <= 100_000 else blocks, "lang")
    own = F.floor(F.col("number") / width).cast("int")
    pairs = named.withColumn("own", own).select("lang", "term", "number", "p", "base", "own", F.explode(F.sequence(F.lit(0), F.col("last_block"))).alias("partner"))
    rows = pairs.select("lang", "term", "number", "p", "base", F.least("own", "partner").alias("block"), F.greatest("own", "partner").alias("other"), "own")
    sides = rows.select("lang", "block", "other", "term", "number", "p", "base", (F.col("own") == F.col("block")).alias("mine"), (F.col("own") == F.col("other")).alias("theirs"))
    dealt = sides.repartition(shuffle_partitions(counts.sparkSession), "lang", "term").sortWithinPartitions("lang", "block", "other", "term", "number")
    return dealt.mapInArrow(_shared_sums(width), "lang string, a int, b int, total long").groupBy("lang", "a", "b").agg(F.sum("total").alias("total"))


def audit_sources(documents: DataFrame, *, least: int = LEAST_DOCUMENTS, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank) of both parts."""
    # One shuffle by (lang, term) serves the sums per source and those over the language's sources.
    over_lang = Window.partitionBy("lang", "term")
    counts = term_counts(documents).withColumns({"lang_n": F.sum("n").over(over_lang), "lang_docs": F.sum("docs").over(over_lang)})
    counts = stage_table(counts.where((F.col("lang_docs") >= least) | (F.col("term") == "")).select("lang", "source", "term", "n", "lang_n"), "terms")
    kept = counts.where("term <> ''")
    # Each term counts once for its language: at the share of its sources that a row stands for.
    langs = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_places"))
    places = kept.groupBy("lang", "source").agg(F.sum("n").alias("places"))
    numbered = counts.where("term = ''").select("lang", "source").withColumn("number", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    zero = F.lit(0).cast("long")
    groups = numbered.join(places, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", "number", F.coalesce("places", zero).alias("places"), F.coalesce("v", zero).alias("v"), F.coalesce("lang_places", zero).alias("lang_places"))
    base = F.when(F.col("v") > 0, weight(zero, F.col("places"), F.col("v"))).otherwise(zero)
    groups = stage_table(groups.withColumn("base", base), "groups")
    weighed = stage_table(kept.join(groups, ["lang", "source"]).withColumn("p", weight(F.col("n"), F.col("places"), F.col("v"))), "weights")

    over = weighed.withColumn("q", weight(F.col("lang_n"), F.col("lang_places"), F.col("v"))).where("p > q")
    best = radix_top(over.select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value")), ["lang", "source"], "value", "item", top)

    # Pairs with the smaller number first: baselines, then terms of one side, then shared terms.
    mine, theirs = groups.select("lang", F.col("number").alias("a"), F.col("base").alias("base_a"), "v"), groups.select("lang", F.col("number").alias("b"), F.col("base").alias("base_b"))
    between = mine.join(theirs, "lang").where("a <> b")
    flat = between.where("a < b").select("lang", "a", "b", F.when(F.col("v") > 0, F.col("v") * divergence(F.col("base_a"), F.col("base_b"))).otherwise(0).alias("total"))
    histogram = weighed.groupBy("lang", F.col("number").alias("a"), "p").agg(F.count("*").alias("m"))
    alone = histogram.join(between, ["lang", "a"]).select(
        "lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("m") * (divergence(F.col("p"), F.col("base_b")) - divergence(F.col("base_a"), F.col("base_b")))).alias("total")
    )
    shared = _shared(weighed.select("lang", "term", "number", "p", "base"), groups, block)
    sums = stage_table(flat.unionByName(alone).unionByName(shared).groupBy("lang", "a", "b").agg(F.sum("total").alias("value")), "sums")
    both = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    names = groups.select("lang", "number", "source")
    pairs = both.join(names.withColumnRenamed("number", "a"), ["lang", "a"]).join(names.select("lang", F.col("number").alias("b"), F.col("source").alias("item")), ["lang", "b"])

    parts = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").unionByName(best.select("lang", "source", F.lit("term").alias("part"), "item", "value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return parts.withColumn("rank", rank.cast("int"))
