"""License scans, the prefix trie and the divergence audit against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from engram.llm.divergence import audit_sources, radix_top
from engram.llm.licenses import Template, license_digests, scan_licenses
from engram.llm.prefix_trie import prefix_trie, share_openings, turn_sequences

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def base_of(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    found = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def test_licenses(spark):
    texts = [
        None, "", " .,; ", "under the MIT License", "UNDER\nthe--mit... license under the mit license", "ünder the mit license", "under the mit licensee", "x" * 10**6 + " CC BY-NC 4.0", "cc by nc " * 3000, "cc by cc by nc by nc",
        "Licensed under the Apache License, Version 2.0; and CC BY-NC-SA 4.0", "under the KMIT license", "Apache License, Version 2", "apache license version",
    ]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_words", "'x' as words", "'y' as found")
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_digests(scan_licenses(docs)).collect())
    assert got == Counter((i, *base_of(t)) for i, t in rows)
    assert license_digests(scan_licenses(docs.limit(0))).count() == 0


def test_texts_that_are_not_utf8(spark):
    docs = spark.sql("select 1L as doc_id, cast(X'756E64657220746865206D6974FF' as string) || ' under the mit license' as text")
    row = license_digests(scan_licenses(docs)).first()
    assert (row.n_words, row.n_base, row.first_word) == (7, 1, 3)


def test_notices_with_other_words_between(spark):
    full = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    rows = [(1, full), (2, full.replace("any person", "any one person")), (3, full.replace("free of charge", "for a fee")), (4, "associated documentation files. " + "y " * 40 + full[:60]), (5, "so: " + full[len("Permission ") :]), (6, "x " * 50 + full)]
    got = {r.doc_id: (r.labels, r.n_base, r.score) for r in license_digests(scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[1] == got[6] == ("mit", 0, 1.0)
    assert got[2][0] == "mit" and 0 < got[2][2] < 1
    assert [got[k] for k in (3, 4, 5)] == [("", 0, 0.0)] * 3


def test_own_templates_and_spans(spark):
    docs = spark.createDataFrame([(1, "a b c a b"), (2, "b c")], "doc_id long, text string")
    got = {r.doc_id: [(f.start, f.length, f.label, f.base) for f in r.found] for r in scan_licenses(docs, templates=(Template("ab", "a b", base=True), Template("bc", "b c"))).collect()}
    assert got == {1: [(0, 2, "ab", True), (1, 2, "bc", False), (3, 2, "ab", True)], 2: [(0, 2, "bc", False)]}


def trie_of(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0), role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), text))
    own = {c: [(t[1], t[3]) for t in sorted(x)] for c, x in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:])
    members, kids = defaultdict(list), defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    out = {}
    for path in sorted(members, key=len, reverse=True):
        leaves = sum(out[k][5] for k in kids[path]) or 1
        saved = sum(out[k][6] for k in kids[path]) + ((len(members[path]) - 1) * len(path[-1][1]) if path else 0)
        ends = ",".join(str(c) for c in sorted(members[path]) if len(rebuilt[c]) == len(path))
        out[path] = (min(members[path]), len(path), min(members[path[:-1]]) if path else None, len(members[path]), len(kids[path]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return Counter(out.values())


def trie(spark, rows, partitions):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as depth", "1 as part", "2 as turns", "3 as head_id")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        return Counter(map(tuple, prefix_trie(share_openings(turn_sequences(table))).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("seed", range(4))
def test_tries(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for c in range(-130, 330, rnd.choice([1, 2, 7])):
        for t in range(rnd.choice([0, 1, 2, 3, 8, 12])):
            rows.append((c, rnd.choice([t, None]) if seed == 2 else t, rnd.choice(["u", "a", None]) if seed else "u", rnd.choice(["x", "yy", "😀é", None]) if seed < 3 else "same"))
    rows += [(None, 0, "u", "left out"), rows[0]]
    assert trie(spark, rows, 4) == trie_of(rows)


def test_copies_over_many_ranges(spark):
    rows = [(c, t, "u", "same" * (t + 1)) for c in range(3000) for t in range(8)] + [(5000 + c, 0, "u", f"own {c}") for c in range(40)] + [(9000, t, "a", "long" * t) for t in range(300)]
    assert trie(spark, rows, 23) == trie_of(rows)
    assert trie(spark, [], 3) == Counter()


def test_very_long_turns(spark):
    rows = [(7, 0, "u", "x" * 10**6), (7, 1, "a", "y" * 10**6), (8, 0, "u", "x" * 10**6)]
    assert trie(spark, rows, 3) == trie_of(rows)


def audit_of(rows, least=10, top=10):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang in {x for x, _ in groups}:
        kept = {t for t, n in docs[lang].items() if n >= least}
        sources = sorted(s for x, s in groups if x == lang)

        def weights(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p = {s: weights(counts[lang, s]) for s in sources}
        q = weights(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, x[2], -x[0], k) for part, found in (("pair", pairs), ("term", terms)) for k, x in enumerate(found, 1)]
    return Counter(out)


def test_divergence(spark):
    rnd = random.Random(1)
    words = ["aa", "b", "Ccc", "ééé", "Élan", "aaaaaaaab", "aaaaaaaac", "x1y", "q" * 70 + "a", "q" * 70 + "b"]
    rows = [(" ".join([*rnd.choices(words, k=rnd.randint(0, 30)), "z" + "q" * rnd.randint(0, 9)]) if rnd.random() < 0.9 else None, rnd.choice(["x", "y", None]), f"s{rnd.randint(0, 9)}") for _ in range(700)]
    rows += [(None, "lonely", "one"), ("one two", "none kept", "one"), ("one two", "none kept", None), ("w " * 10**6, "x", "s1"), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "1 as term", "2 as number", "'v' as value", "3 as rank")
    for block in (4, 256):
        got = Counter(map(tuple, audit_sources(docs, block=block).select("lang", "source", "part", "item", "value", "rank").collect()))
        assert got == audit_of(rows)
    assert audit_sources(docs.limit(0)).count() == 0


def test_radix_select_with_ties(spark):
    rnd = random.Random(3)
    rows = [(g, rnd.choice([0, 1, 5, 2**29, 2**30 - 1]) if g % 2 else rnd.randrange(2**30), f"{'p' * rnd.randint(0, 40)}é{i}") for g in range(7) for i in range(g * 40)]
    rows += [(99, 7, "same" * 30 + f"{i:05}") for i in range(500)] + [(98, 3, x) for x in ("a", "ab", "abc", "b", "")]
    table = spark.createDataFrame(rows, "g long, value long, item string")
    for k in (1, 3, 10):
        got = defaultdict(list)
        for r in radix_top(table, ["g"], "value", "item", k).collect():
            got[r.g].append((-r.value, r.item.encode()))
        want = defaultdict(list)
        for g, v, i in rows:
            want[g].append((-v, i.encode()))
        assert {g: sorted(x) for g, x in got.items()} == {g: sorted(x)[:k] for g, x in want.items()}
