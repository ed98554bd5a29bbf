"""Language ID, HTML extraction, the n-gram join and the pipeline."""

import re
import time
import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from engram.llm import ngram_join
from engram.llm.html_text import FEATURES, blocks_of, extract_main_text, features_of, labelled_blocks, main_text, train as train_tree
from engram.llm.language_id import FtrlRegression, _temperature, identify, train
from engram.llm.ngram_join import components, near_duplicates, prefix_length

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_classes(rows):
    """(n_shingles, component_id) by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    label = {i: i for i in ids}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * 100 >= 75 * max(len(a), len(b)) and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                label[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(seed, n=60, words=80):
    """Chains of copies, each a few words off the last, so that many pairs lie near the limit."""
    rng = np.random.default_rng(seed)
    rows, text = [], [f"w{x}" for x in rng.integers(0, 5000, words)]
    for i in range(n):
        if i % 15 == 0:
            text = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(5, words))]
        own = list(text)
        for _ in range(rng.integers(0, 3)):
            own[rng.integers(0, len(own))] = f"e{rng.integers(0, 10**6)}"
        if rng.random() < 0.5:
            text = own
        rows.append((i, " ".join(own)))
    return rows


@pytest.mark.parametrize(("seed", "chunk"), [(1, 2_000_000), (2, 300)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(ngram_join, "CHUNK_TOKENS", chunk)
    common = " ".join(f"c{i}" for i in range(60))
    odd = [None, "", " \n", "one", "ONE", "one two", "a b c d e", "A  b\nc d e", "x" * 4000, common + " tail one two three", common + " other tail words here now", "r " * 900]
    rows = near_copies(seed) + [(100 + i, t) for i, t in enumerate(odd)] + [(200 + i, common) for i in range(20)]
    df = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string").selectExpr("*", "1 as node", "'x' as sid").repartition(3)
    path_rows = near_duplicates(df).collect()
    expected = brute_classes(rows)
    assert len(path_rows) == len(rows) + 1
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in path_rows} == expected
    assert len({c for _, c in expected.values()}) < len(rows) - 20
    assert near_duplicates(df.limit(0)).count() == 0


def test_links_without_star_rounds(spark):
    rows = near_copies(5, 45)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, star_rounds=0).collect()} == brute_classes(rows)


def test_a_shingle_of_every_document_moves_as_a_number(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK_OWNERS", 3)
    rng = np.random.default_rng(4)
    rows = [(i, "a line that all have " + " ".join(f"w{x}" for x in rng.integers(0, 40, 4)) + " " + t) for i, t in near_copies(6, 200, 24)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df).collect()} == brute_classes(rows)
    parts = df.mapInArrow(ngram_join._chunk_map(5, 4, 10**6, 3), ngram_join._PARTS).where("sids is null").collect()
    assert sum(len(p.held) for p in parts) > 0
    for p in parts:
        own = ngram_join._unpacked([p.tokens])
        assert np.unique(own, return_counts=True)[1].max(initial=0) <= 3
        assert len(p.owners) == 2 * len(own)


def test_exactly_three_quarters_link(spark):
    shared = [f"s{i}" for i in range(19)]
    # 15 shingles are shared; with 5 of its own the other set has 20, the union 20: 75 %.
    rows = [(1, " ".join(shared)), (2, " ".join([*shared, *(f"t{i}" for i in range(5))])), (3, " ".join([*shared, *(f"u{i}" for i in range(6))]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df).collect()}
    assert found == brute_classes(rows) == {1: (15, 1), 2: (20, 1), 3: (21, 3)}


@pytest.mark.parametrize(("hot", "block"), [(2, 1024), (3, 4)])
def test_links_in_blocks(spark, monkeypatch, hot, block):
    monkeypatch.setattr(ngram_join, "HOT_ROWS", hot)
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block)
    rows = near_copies(9, 45)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for rounds in (0, 1):
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, star_rounds=rounds).collect()} == brute_classes(rows)


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (102, 103)]
    got = {r.node: r.label for r in components(spark.createDataFrame(path, "x long, y long")).collect()}
    assert got == dict.fromkeys(range(41), 0) | dict.fromkeys(range(100, 104), 100)


def test_prefix_length():
    assert [prefix_length(n) for n in (1, 4, 5, 8, 100)] == [1, 2, 2, 3, 26]


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = spark.createDataFrame([(5001, None, "en", "a"), (5002, "", "en", "a"), (5003, "12 34 !?", "fr", "a"), (5004, "straße und über den", None, None), (None, "le été", None, None)], docs.schema)
    every = docs.unionByName(odd)
    model = train(every, sample_rows=500)
    got = [r.asDict() for r in identify(every.selectExpr("*", "1 as score"), model).collect()]
    assert len(got) == docs.count() + 5
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held_out"] for r in got if r["doc_id"] is not None)
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.97 * len(held) > 100
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (5001, 5002, 5003)] == ["und"] * 3 and by[5001]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in got)
    changed = every.withColumns({"lang": F.lit("xx"), "source": F.lit("s"), "doc_id": F.col("doc_id") + 7})
    again = Counter((r.lang_pred, round(r.score, 9)) for r in identify(changed, model).collect())
    assert again == Counter((r["lang_pred"], round(r["score"], 9)) for r in got)
    assert {r.lang_pred for r in identify(every, train(every.where("lang is null"))).collect()} == {"und"}
    assert identify(every.limit(0), model).count() == 0


def test_rare_languages_are_learned(spark):
    words = {"en": "the house and tree with some water there", "fi": "järvi yö hyvä päivää metsä talo kyllä", "is": "það þetta ég ekki góðan daginn vatn"}
    rng = np.random.default_rng(3)
    say = lambda lang: " ".join(rng.choice(words[lang].split(), 30))
    rows = [(i, say(lang), lang) for i in range(4000) for lang in ["fi" if i % 400 == 3 else "is" if i == 1 else "en"]]
    assert zlib.crc32(b"1") % 4 != 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train(docs, sample_rows=300)
    assert model.languages == ["en", "fi", "is"]
    got = {r.doc_id: r.lang_pred for r in identify(docs, model).collect()}
    assert got == {i: lang for i, _, lang in rows}


def test_ftrl_drops_noise_and_learns():
    rng = np.random.default_rng(0)
    model = FtrlRegression(50, 2)
    for _ in range(200):
        y = rng.integers(0, 2, 16)
        keys = np.column_stack([y, rng.integers(2, 50, 16)]).ravel()
        model.step(keys, np.column_stack([np.ones(16), np.full(16, 1e-4)]).ravel(), np.repeat(np.arange(16), 2), y)
    w = model.weights()
    assert w[0, 0] > 1 and w[1, 1] > 1 and (w[2:] == 0).mean() > 0.9
    assert _temperature(np.array([[9.0, 0.0]] * 10), np.array([0] * 7 + [1] * 3)) > 3


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body><header class=top><h1>Site</h1></header>
<nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav><div class="cookie-notice">We use cookies to serve you</div>
<article><h1>Head &amp; line</h1><p>First&nbsp; <b>bold</b>
 text<br>more &#8211; x<p>Un<i>closed</i> &lt;p&gt; <script>var a="</p>";</script>end<!-- <p>gone</p> --><aside>Related things</aside>
<form><p>Your mail</p><input name=a><button>Send</button></form><p>Last &copy</p>
<section id="comments"><p>I think that this is a very long comment of a reader about it</p></section></article>
<div class='sidebar'><p>Side text here</p></div><footer>&copy; me</footer></body></html>"""


def test_html(spark):
    tree = train_tree()
    x, y = labelled_blocks()
    assert (tree.predict(x) == y).all() and len({FEATURES[n[0]] for n in tree.nodes if n[0] >= 0}) >= 5
    tags = (x[:, FEATURES.index("article")] == 1) & (x[:, FEATURES.index("boilerplate")] == 0)
    assert (tags != y).sum() > 40  # the places alone don't tell
    text = "Head & line\n\nFirst bold text more – x\n\nUnclosed <p> end\n\nLast ©"
    assert main_text(PAGE, tree) == text
    long = "<p>" + "word " * 50_000
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<nav>only menu</nav>"), (5, "u", "<article><p>a < b <3 &bogus; &amp"), (6, "u", "<article>" + long), (7, "u", "<!-- <article><p>x"), (1, "u", PAGE), (8, "u", "<article><p title='a>b'>ok \"x</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'t' as text")
    got = {r.page_id: r for r in extract_main_text(df).collect()}
    assert got[2].text == got[3].text == got[4].text == got[7].text == "" and got[2].n_chars == 0
    assert got[5].text == "a < b <3 &bogus; &" and got[6].n_chars == 5 * 50_000 - 1 and got[8].text == 'ok "x'
    assert extract_main_text(df).count() == len(rows) and extract_main_text(df.limit(0)).count() == 0
    assert [(b.words, b.linked) for b in blocks_of("<div>a <a href=x>b c</a></div>")] == [(3, 2)]
    assert [(b.text, b.linked) for b in blocks_of("<a href=x><div>teaser text</div></a><div>b <a>c</div><p>d</p>")] == [("teaser text", 2), ("b c", 1), ("d", 0)]


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<body class='has-sidebar'><div class='content-with-sidebar'><article class='post no-comments'><div class='entry-header'><h1>T</h1></div><p>body</p></article></div>", "T\n\nbody"),
        ("<article><p>a</p><article class='comment'><p>reader</p></article><div id='comment-list'><p>more</p></div></article>", "a"),
        ("<header><p>site</p></header><main role=main><p>a</p><div class='ad-slot'>buy</div><div class='site-footer'>c</div></main>", "a"),
        ("<article><h1>T</h1><h2 id='related-work'>Related work</h2><p>others did so.</p><h2 id='comments'>Comments</h2><section id='search-algorithms'><p>a search.</p></section></article>", "T\n\nRelated work\n\nothers did so.\n\nComments\n\na search."),
        ("<article><p>one<p>two<ul><li>x<li>y</ul><div class=related-posts><p>z</div></article>", "one\n\ntwo\n\nx\n\ny"),
    ],
)
def test_html_places(html, text):
    assert main_text(html, train_tree()) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<body><button>Menu<article><p>a</p></article><form><button>Send</button></form>", "a"),
        ("<head><meta charset=utf-8><title>T</title><style>p{}</style><article><p>a</p></article>", "a"),
        ("<head><title>T</title><noscript><link rel=x></noscript></head><article><p>a</p></article>", "a"),
        ("<div><select><option>x<option>y</div><article><p>a <canvas>b<p>c</article>", "a\n\nc"),
        ("<article><p>one.</p><button>ok<p>two.</p>", "one.\n\ntwo."),
        ("<article><p>a b.</p><script src=https://x.com/>var a=1</script><p>c d.</p><script src='x' /><p>e f.</p></article>", "a b.\n\nc d.\n\ne f."),
        ("<article><p title='open>a b.</p><p>c d.</p></article>", "a b.\n\nc d."),
        ("<article><p>area <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> end</p></article>", "area x=2 end"),
        ("<article><p>a <svg><svg/><text>t</text></svg>b<svg/> c</p><object>x<p>d</p></article>", "a b c\n\nd"),
        ("<article><button><div>Send</div></button><p>a</p><!-- <video> --><script>'<video>'</script><p>b</p><video></video><script>var x", "a\n\nb"),
    ],
)
def test_html_elements_left_out(html, text):
    assert main_text(html, train_tree()) == text


@pytest.mark.parametrize("html", ["<a" * 100_000, '<a "' * 50_000, "<a '\">" * 30_000, "<div>" * 30_000 + "</x>" * 30_000, "<script" * 30_000, "<!--" * 30_000, "< " * 100_000, "<p><a href=x>" * 20_000])
def test_html_takes_linear_time(html):
    began = time.perf_counter()
    main_text(html, train_tree())
    assert time.perf_counter() - began < 3


def test_html_of_pages_without_article_elements():
    para = "<p>" + "a sentence with several words in it " * 6 + "</p>"
    html = "<body><div><a href=/>home</a></div><div><a href=/x>x</a></div>" + para * 3 + "<div><a href=/y>more</a></div></body>"
    assert main_text(html, train_tree()).count("\n\n") == 2


def test_html_held_out_accuracy_without_article_tags(spark):
    tree, right, blocks = train_tree(), [0, 0], 0
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inside = set(main_text("<article>" + r.html.split("<article>")[1].split("</article>")[0] + "</article>", tree).split("\n\n"))
        bare = re.sub("<(/?)article>", r"<\1div>", r.html)
        for k, page in enumerate((bare, bare.replace(' class="ad"', ""))):
            found = blocks_of(page)
            right[k] += sum((b.text in inside) == keep for b, keep in zip(found, tree.predict(features_of(found)), strict=True))
        blocks += len(found)
    assert right[0] >= 0.99 * blocks and right[1] >= 0.93 * blocks


def test_html_matches_the_articles_of_the_pages(spark):
    from html import unescape

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in extract_main_text(spark.read.parquet(f"{SF}/pages.parquet")).collect():
        article = pages[r.page_id].split("<article>")[1].split("</article>")[0]
        parts = [" ".join(unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(p for p in parts if p)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, before = {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = stage(spark, before, SF).cache()
        assert before.columns == docs.columns
        kept[name] = {r.doc_id: r.text for r in before.select("doc_id", "text").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert [n.split("_")[0] for n in names] == ["language", "quality", "ngram", "benchmark", "best"]
    for a, b in pairwise(names[:-1]):
        assert kept[b].items() <= kept[a].items() and kept[b]
    classes = brute_classes(kept["quality_rules"].items())
    assert set(kept["ngram_jaccard_join"]) == {i for i, (_, c) in classes.items() if c == i}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda s: re.sub("[A-Z]+", lambda m: m[0].lower(), s)
    windows = {tuple(w[k : k + 13]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for w in [word.findall(low(r.text))] for k in range(max(1, len(w) - 12))}
    clean = set()
    for i, t in kept["ngram_jaccard_join"].items():
        w = word.findall(low(t))
        hit = {k + j for n in {len(x) for x in windows} for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for j in range(n)}
        if not hit or 20 * len(hit) < len(w):
            clean.add(i)
    assert set(kept["benchmark_decontamination"]) == clean
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == clean
    fill = defaultdict(int)
    for r in packed:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(fill.values()) // 2048) * 1.02 + 1


def test_pipeline_passes_on_texts_without_common_lines(spark):
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    rows = [(i, "Read more on our site\n" + own(i), "s", 0) for i in range(40)] + [(100, "A single line\n" + own(100), "s", 0), (101, None, "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.quality_rules(spark, docs, SF).collect()}
    texts = {i: own(i) for i in range(40)} | {100: rows[40][1]}
    assert got == {i: (t, len(t)) for i, t in texts.items()}


def test_rows_are_judged_by_their_own_text(spark):
    long = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    rows = [(None, "short", "a"), (None, long(1), "a"), (5, "short", None), (5, long(2), None), (5, long(3), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {(r.doc_id, r.text) for r in corpus_pipeline.quality_rules(spark, docs, SF).collect()}
    assert kept == {(None, long(1)), (5, long(2)), (5, long(3))}
    copies = [(None, long(1), "a"), (None, long(1), "a"), (None, long(1), "b"), (7, long(4), "a"), (None, long(4), "a"), (5, long(2), "a"), (5, long(3), "a")]
    thinned = corpus_pipeline.ngram_jaccard_join(spark, spark.createDataFrame(copies, docs.schema), SF)
    assert thinned.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in thinned.collect()), key=str) == sorted([(None, long(1)), (7, long(4)), (5, long(2)), (5, long(3))], key=str)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    mixed = spark.createDataFrame([(None, item, "a"), (None, long(1), "a"), (5, item, "a"), (5, long(2), "a")], docs.schema)
    clean = corpus_pipeline.benchmark_decontamination(spark, mixed, SF).collect()
    assert {(r.doc_id, r.text) for r in clean} == {(None, long(1)), (5, long(2))}


def test_repeated_rows_leave_one(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (3, "other " + text[50:]), (4, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.ngram_jaccard_join(spark, df, SF).collect()) == [1, 3, 4]
