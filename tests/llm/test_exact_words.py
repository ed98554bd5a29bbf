"""Words and lines with a rule (Thue-Morse) that hashes by powers of a base take for equal."""

import pytest

from engram.llm.decontaminate import find_contamination
from engram.llm.ngram_join import near_duplicates
from engram.llm.quality import judge_quality


@pytest.fixture(scope="module")
def twins():
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_differ(spark, twins):
    one, other = twins
    docs = spark.createDataFrame([(1, f"{one} b c d e"), (2, f"{other} b c d e"), (3, f"{one} b c d e")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 1}
    items = spark.createDataFrame([("i", one)], "item_id string, text string")
    assert {r.doc_id: (r.n_hit, r.contaminated) for r in find_contamination(docs, items).collect()} == {1: (1, True), 2: (0, False), 3: (1, True)}


def test_lines_differ(spark, twins):
    one, other = twins
    docs = spark.createDataFrame([(1, f"{one}\n{other}", "h"), (2, f"{one}\n{one}", "h"), (3, f"{one} x y {other} x y", "h")], "doc_id long, text string, source string")
    assert {r.doc_id: (r.n_dup_lines, r.n_repeat_words) for r in judge_quality(docs).collect()} == {1: (0, 0), 2: (1, 0), 3: (0, 0)}
