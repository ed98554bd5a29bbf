"""License scans: notices found by the rarest words of known templates, Spark expressions only.

Texts are lower-cased (A-Z) and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.
A :class:`Template` is a notice as words, with key phrases that an occurrence must hold.
A template that consists of one key phrase alone is a *phrase*: it is found at
every place where its words stand consecutively, and nowhere else.

Method: a positional index of rare tokens.

1. Over all documents, count how many hold each word of the templates. The
   ``rare`` words of a template with the highest inverse document frequency are
   its index entries, each with its place in the template.
2. In each document, look up the words that are index entries. A word at place w
   with an entry at place p of a template proposes that the template starts at
   w - p. A start that at least half of the template's entries propose is a candidate.
3. A candidate holds if all key phrases stand between its first and last word, give or
   take ``SLACK`` words (a phrase: exactly there). Its score is the share of the
   template's words that stand at their places, weighted by inverse document frequency.

An exact occurrence is proposed by every entry, so no phrase is missed whatever
the counts are.

Scale: two passes over the texts, no shuffle of text. The first ends in one sum
per template word (their number is that of the vocabulary of the templates, which
bounds what the driver collects and what the second pass holds as literals). The
second is a map. Work is linear in the words of a text plus the sort of its proposals.
A document is handled by one row's expressions, so memory follows the longest text.

Nulls and odd rows: a null or empty text has no words, no labels and score 0. A null
doc_id is kept. Repeated rows get the same result each, and each counts as a
document. Bytes that aren't UTF-8 read as replacement characters, which are word
characters. Of equal words within a template the first place is its entry. An empty table
gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RARE = 4
SLACK = 8
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Template(NamedTuple):
    """A notice: its label, its words, the phrases that an occurrence must hold (all of the text if none)."""

    label: str
    text: str
    keys: tuple[str, ...] = ()
    base: bool = False

    @property
    def words(self) -> list[str]:
        return re.findall(r"[a-z0-9]+", self.text.lower())

    @property
    def phrases(self) -> list[str]:
        return [f" {k} " for k in self.keys] or [f" {' '.join(self.words)} "]

    @property
    def slack(self) -> int:
        return SLACK if self.keys else 0


#: The three base phrases, then notices of public licenses as their texts give them.
TEMPLATES = (
    Template("mit", "under the mit license", base=True),
    Template("apache-2", "apache license version 2", base=True),
    Template("cc-by-nc", "cc by nc", base=True),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge", "associated documentation files")),
    Template("apache-2", "you may not use this file except in compliance with the License", ("file except in compliance with the license",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "with or without modification")),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("distribute this software for any purpose", "is hereby granted")),
    Template("gpl-2", "gnu general public license version 2"),
    Template("gpl-3", "gnu general public license version 3"),
    Template("gpl", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("gnu general public license", "free software foundation")),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("mpl-2", "subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("cc-by", "cc by 4 0"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by-nd", "cc by nd"),
    Template("cc-by-nc-sa", "cc by nc sa"),
    Template("cc-by-nc-nd", "cc by nc nd"),
    Template("cc-by-nc", "Creative Commons Attribution-NonCommercial", ("creative commons attribution noncommercial",)),
    Template("cc0", "cc0 1 0 universal"),
    Template("boost", "boost software license version 1 0"),
    Template("epl-2", "eclipse public license version 2 0"),
)


def lower_ascii_letters(text: Column) -> Column:
    """A text, empty for null, with A-Z lower-cased."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    # Of ASCII alone, lower() changes A-Z only and is the faster of the two.
    return F.when(F.octet_length(whole) == F.char_length(whole), F.lower(whole)).otherwise(F.translate(whole, _UPPER, _UPPER.lower()))


def words_of(text: Column) -> Column:
    """The words of a text, lower-cased, as an array; empty for null."""
    return F.array_remove(F.split(lower_ascii_letters(text), _SEPARATORS, -1), "")


def document_frequencies(documents: DataFrame, vocabulary: Sequence[str]) -> tuple[int, dict[str, int]]:
    """The number of documents, and of those that hold each word of the vocabulary, over the whole table."""
    known = F.array_intersect(words_of(F.col("text")), F.array(*map(F.lit, vocabulary)))
    marked = documents.select(F.explode_outer(F.concat(F.array(F.lit("")), known)).alias("word"))  # '' stands for the document
    counts = {r["word"]: r["n"] for r in marked.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return counts.get("", 0), {w: counts.get(w, 0) for w in vocabulary}


def rarity(documents: int, holding: int) -> int:
    """Inverse document frequency as the binary digits of documents / holding, so that scores are ratios of whole numbers."""
    return ((documents + 1) // (holding + 1)).bit_length()


def rare_entries(template: Template, counts: dict[str, int], rare: int) -> list[tuple[str, int]]:
    """(word, place) of the words of a template that fewest documents hold."""
    first = {w: p for p, w in reversed(list(enumerate(template.words)))}
    return sorted(first.items(), key=lambda e: (counts[e[0]], e[1]))[:rare]


def _literal(rows: Sequence[Sequence[object]]) -> Column:
    return F.array(*(F.array(*map(F.lit, row)) for row in rows))


def scan_licenses(documents: DataFrame, *, templates: Sequence[Template] = TEMPLATES, rare: int = RARE) -> DataFrame:
    """(doc_id, n_words, found): what each text holds, as (label, base, start, length, score) in order of start."""
    vocabulary = sorted({w for t in templates for w in t.words})
    total, counts = document_frequencies(documents, vocabulary)
    entries = [rare_entries(t, counts, rare) for t in templates]
    postings: dict[str, list[Column]] = {}
    for k, own in enumerate(entries):
        for word, place in own:
            postings.setdefault(word, []).append(F.struct(F.lit(k).alias("t"), F.lit(place).alias("place")))
    index = F.create_map(*(c for w, found in sorted(postings.items()) for c in (F.lit(w), F.array(*found))))
    need = F.array(*(F.lit((len(e) + 1) // 2) for e in entries))
    length, slack = F.array(*(F.lit(len(t.words)) for t in templates)), F.array(*(F.lit(t.slack) for t in templates))
    label, base = F.array(*(F.lit(t.label) for t in templates)), F.array(*(F.lit(t.base) for t in templates))
    spelled, phrases = _literal([t.words for t in templates]), _literal([t.phrases for t in templates])
    weight = _literal([[rarity(total, counts[w]) for w in t.words] for t in templates])
    weights = F.array(*(F.lit(sum(rarity(total, counts[w]) for w in t.words)) for t in templates))

    # Each step is a column of its own and used more than once, so that no step is computed again within the next.
    texts = documents.select("doc_id", words_of(F.col("text")).alias("words"))
    looked_up = F.filter(F.transform("words", lambda w, i: F.when(w.isin(*postings), F.struct(i.alias("at"), w.alias("word")))), lambda h: h.isNotNull())
    hits = texts.select("doc_id", "words", looked_up.alias("hits"))
    proposals = F.flatten(F.transform("hits", lambda h: F.transform(F.element_at(index, h["word"]), lambda p: F.struct(p["t"].alias("t"), (h["at"] - p["place"]).alias("start")))))
    proposed = hits.select("doc_id", "words", F.array_sort(proposals).alias("starts"))

    def agreed(s: Column, i: Column) -> Column:
        """The first of a run of equal proposals that is long enough."""
        return F.get("starts", i + F.get(need, s["t"]) - 1).eqNullSafe(s) & ~F.coalesce(F.get("starts", i - 1).eqNullSafe(s) & (i > 0), F.lit(False))

    candidates = proposed.select("doc_id", "words", F.filter("starts", agreed).alias("candidates"))

    def holds(c: Column) -> Column:
        around = F.slice("words", F.greatest(c["start"] - F.get(slack, c["t"]), F.lit(0)) + 1, F.get(length, c["t"]) + 2 * F.get(slack, c["t"]))
        read = F.concat(F.lit(" "), F.array_join(around, " "), F.lit(" "))
        return ((c["start"] >= 0) | (F.get(slack, c["t"]) > 0)) & F.forall(F.get(phrases, c["t"]), lambda k: F.contains(read, k))

    def described(c: Column) -> Column:
        there = F.zip_with(F.transform(F.get(spelled, c["t"]), lambda w, j: F.get("words", c["start"] + j).eqNullSafe(w)), F.get(weight, c["t"]), lambda same, x: F.when(same, x).otherwise(0))
        score = F.aggregate(there, F.lit(0), lambda a, x: a + x).cast("double") / F.get(weights, c["t"])
        return F.struct(c["start"].cast("long").alias("start"), F.get(length, c["t"]).cast("long").alias("length"), F.get(label, c["t"]).alias("label"), F.get(base, c["t"]).alias("base"), score.alias("score"))

    return candidates.select("doc_id", F.size("words").cast("long").alias("n_words"), F.array_sort(F.transform(F.filter("candidates", holds), described)).alias("found"))


def license_digests(scanned: DataFrame) -> DataFrame:
    """Per document: how often and where base phrases stand, base labels, all labels, and the highest score."""
    labels = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda f: f["label"]))), ",")
    base = scanned.select("*", F.filter("found", lambda f: f["base"]).alias("of_base"))
    starts = F.transform("of_base", lambda f: f["start"])
    return base.select(
        "doc_id",
        "n_words",
        F.size("of_base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels("of_base").alias("base_labels"),
        labels("found").alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda f: f["score"])), F.lit(0.0)).alias("score"),
    )
