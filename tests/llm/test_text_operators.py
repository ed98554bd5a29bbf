"""Text operators against brute force on small tables with odd rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from engram.llm.decontaminate import find_contamination
from engram.llm.packing import Plan, SumIndex, cut, pack, sequences
from engram.llm.quality import clean_texts, judge_quality
from engram.llm.sharding import shard
from engram.llm.token_counts import PrefixCounter, count_tokens, read_tokenizer

SF = "/root/testdata/sf0.001"


def lower(s):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), s or "")


ODD = [None, "", " \n\t", "one", "two  words", "#*$%&|<>", "a b c a b c a b c", "line one is here\nline one is here\n\n x", "é日本 😀 ﬁ Ａ\u00a0b ▁ <s> <|endoftext|> it's\r\n  12 34", "x" * 5000, "the cat sat " * 3000]


@pytest.fixture(scope="module")
def documents(spark):
    base = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = base + [(10_000 + i, t, "src0" if i % 2 else None) for i, t in enumerate(ODD)]
    rows += [base[3], base[3], (None, base[4][1], "src1")]
    rows += [(20_000 + i, "A line that many hosts share here\n" * 2 + f"own {i} words", "hot") for i in range(60)]
    rows += [(30_000 + i, "A LINE  that many hosts share here\n" + " ".join(f"w{i}x{j}" for j in range(60)), "hot") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.selectExpr("*", "1 as n_words", "'x' as host", "0 as shard", "doc_id as sequence_id").repartition(5).cache()


def test_decontamination(spark, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [(900, "A line"), (901, None), (902, ""), (None, "own 7"), (900, "A line"), (903, "x" * 5000)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for i, t in items:
        w = word.findall(lower(t))
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])] |= set() if i is None else {str(i)}
    sizes = {len(w) for w in windows}
    expected = []
    for d in documents.collect():
        w = word.findall(lower(d.text))
        hit, owners = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))) is not None:
                    owners |= own
                    hit |= set(range(k, k + n))
        expected.append((d.doc_id, len(w), len(hit), len(owners), hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    order = lambda rows: sorted(map(tuple, rows), key=str)
    assert order(find_contamination(documents, bench).collect()) == order(expected)
    assert order(find_contamination(documents, bench, block_bytes=1500).collect()) == order(expected)
    assert any(x[5] for x in expected) and not all(x[5] for x in expected)
    assert find_contamination(documents.limit(0), bench).count() == 0
    assert not any(r.contaminated for r in find_contamination(documents, bench.limit(0)).collect())


def test_quality_counts(documents):
    expected = []
    for d in documents.collect():
        t = d.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        repeated = {i + j for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        expected.append((d.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated), len(w) < 50 or 2 * len(repeated) > len(w)))
    got = [tuple(r)[:7] for r in judge_quality(documents).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_quality_verdict(documents):
    for few in (0, 1000):
        got = {r.doc_id: r for r in judge_quality(documents, min_words=3, line_documents=30, broadcast_lines=few).collect()}
        assert not got[20_000].kept and got[20_000].removed_words == 14  # nothing but shared lines
        assert got[30_000].kept and got[30_000].removed_words == 7  # the line goes, its own words stay
        assert not got[10_000].kept and got[10_000].base_failed
    assert judge_quality(documents.limit(0)).count() == 0


def test_copies_of_one_text_do_not_make_its_lines_common(spark):
    text = "\n".join(" ".join(f"w{i}x{j}" for j in range(12)) for i in range(8))
    rows = judge_quality(spark.range(500).selectExpr("id as doc_id", f"'{text}' as text", "'s' as source")).collect()
    assert len(rows) == 500 and all(r.kept for r in rows)


def test_documents_with_many_shared_lines_count_each(spark):
    shared = [f"shared line number {i} of this template" for i in range(20)]
    rows = [(i, "\n".join(shared[i % 3 :] + [f"own w{i}"]), "s") for i in range(200)]
    rows += [(1000 + i, "\n".join(shared[:2] + [" ".join(f"t{i}x{j}" for j in range(60))]), "s") for i in range(20)]
    rows += [(2000 + i, "one text\nin many copies", "s") for i in range(100)]
    holders = defaultdict(set)
    for _, text, _ in rows:
        for line in text.split("\n"):
            holders[line].add(text)
    expected = {i: sum(len(x.split()) for x in text.split("\n") if len(holders[x]) > 30) for i, text, _ in rows}
    got = judge_quality(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_words=3).collect()
    assert {r.doc_id: r.removed_words for r in got} == expected
    assert {r.doc_id for r in got if r.kept} == {i for i, _, _ in rows if i >= 1000}


def test_a_template_of_a_large_host_is_found(spark):
    own = spark.range(4000).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 60), j -> concat('w', id, 'x', j))) as text", "'hot' as source")
    template = spark.range(5000, 5040).selectExpr("id as doc_id", "concat('a line of the template ', repeat('and more of it ', 20), '\n', 'own w', id) as text", "'hot' as source")
    rows = judge_quality(own.unionByName(template), min_words=3).collect()
    assert {r.doc_id for r in rows if r.removed_words} == set(range(5000, 5040))


def test_clean_texts_lack_the_lines_above_the_limits(documents):
    norm = lambda x: tuple(re.findall(r"[^\x20\x09-\x0D]+", lower(x)))
    rows = documents.collect()
    holders = defaultdict(set)
    for d in rows:
        for line in (d.text or "").split("\n"):
            if norm(line):
                holders[d.source, norm(line)].add(d.text)
    kept_lines = lambda d: None if d.text is None else "\n".join(x for x in d.text.split("\n") if len(holders[d.source, norm(x)]) <= 30)
    expected = Counter((d.doc_id, d.source, kept_lines(d), d.shard) for d in rows)
    assert sum(d.text != kept_lines(d) for d in rows) == 100
    for few in (0, 1000):
        got = clean_texts(documents, broadcast_lines=few)
        assert got.columns == documents.columns
        assert Counter((d.doc_id, d.source, d.text, d.shard) for d in got.collect()) == expected
    assert clean_texts(documents.limit(0)).count() == 0


def test_token_counts(documents):
    import sentencepiece

    model = read_tokenizer("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    expected = sorted(((d.doc_id, len((d.text or "").encode()), n := len(sp.encode(d.text or "")), n > 4096) for d in documents.collect()), key=str)
    assert sorted(map(tuple, count_tokens(documents, model).collect()), key=str) == expected
    counter = PrefixCounter.from_model(model)
    for text in [t for t in ODD if t and len(t) < 200]:
        counts = counter.prefix_counts(text)
        assert counts == [len(sp.encode(text[:i])) for i in range(len(text) + 1)]
        cut_at = counter.longest_prefix(text, 5)
        assert counts[cut_at] <= 5 and counter.tokens_before(text, cut_at) == counts[cut_at]


def test_packing(documents):
    import tokenizers

    spec = read_tokenizer("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_str(spec.decode())
    packed = pack(documents, spec, with_ids=True).cache()
    got = defaultdict(list)
    for r in packed.collect():
        got[r.doc_id].append(r)
    for d in documents.dropDuplicates(["doc_id"]).collect():
        ids = library.encode(d.text or "", add_special_tokens=False).ids + [0]
        own = sorted(got[d.doc_id], key=lambda r: r.piece)
        times = sum(r.piece == 0 for r in own)
        assert sorted((r.start, r.length) for r in own) == sorted(cut(len(ids), 2048) * times)
        for r in own:
            part = ids[r.start : r.start + r.length]
            assert r.ids == part and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    fill = defaultdict(list)
    for rows in got.values():
        for r in rows:
            fill[r.sequence_id].append((r.offset, r.length))
    for spans in fill.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(n for spans in fill.values() for _, n in spans)
    assert len(fill) <= -(-total // 2048) * 1.02 + 1
    assert all(len(r.ids) <= 2048 for r in sequences(packed).collect())
    assert pack(documents.limit(0), spec).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_plan_places_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    counts = Counter(rng.integers(1, 65, rng.integers(0, 400)).tolist())
    plan = Plan(counts, 64)
    placed = Counter()
    for pattern, copies in plan.patterns:
        assert sum(pattern) <= 64 and copies > 0
        for n in pattern:
            placed[n] += copies
    assert placed == counts
    assert plan.sequences <= max(1.1 * -(-sum(k * n for k, n in counts.items()) // 64) + 3, 0)


@pytest.mark.parametrize("seed", range(6))
def test_sum_index_finds_what_is_there(seed):
    """As lengths run out: a pair or triple is found if and only if there is one, the longest member first."""
    rng = np.random.default_rng(seed)
    left = rng.integers(0, 3, 25).tolist()
    left[0] = 0
    index = SumIndex(left)
    while any(left):
        for total in range(2, 25):
            used = tuple(rng.choice(np.flatnonzero(left), rng.integers(0, 2)).tolist())
            fits = lambda c: all(left[x] >= (*used, *c).count(x) for x in c)  # noqa: E731, B023
            pairs = [(a, total - a) for a in range(total - 1, 0, -1) if 2 * a >= total and fits((a, total - a))]
            triples = [(a, b, total - a - b) for a in range(total - 2, 0, -1) for b in range(total - a - 1, 0, -1) if 2 * b >= total - a and fits((a, b, total - a - b))]
            assert index.pair(total, used) == (pairs[0] if pairs else None)
            found = index.triple(total, used)
            assert (found is None) == (not [t for t in triples if 3 * t[0] >= total]) and (found is None or fits(found) and sum(found) == total)
        left[int(rng.choice(np.flatnonzero(left)))] -= 1


def test_cut_leaves_the_short_piece_first():
    assert cut(5, 10) == [(0, 5)] and cut(25, 10) == [(0, 5), (5, 10), (15, 10)] and cut(20, 10) == [(0, 10), (10, 10)]


def test_sharding(documents):
    rows = shard(documents).collect()
    assert len(rows) == documents.count()
    expected = Counter((d.doc_id, len((d.text or "").encode()) + 8, zlib.crc32((d.text or "").encode())) for d in documents.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == expected
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    share = sum(r.size for r in rows) / 24
    largest = max(r.size for r in rows)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - share) <= largest
    key = lambda r: (r.doc_id is not None, r.doc_id or 0)
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert list(map(key, order)) == sorted(map(key, order))  # contiguous
    assert shard(documents.limit(0)).count() == 0
