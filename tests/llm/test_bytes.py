"""Texts that aren't UTF-8, ties of escaped texts, the bits of the broadcast table."""

import numpy as np
from pyspark.sql import functions as F

from engram.llm.chat import chat_digests, format_chats
from engram.llm.decontaminate import _bit_table, _possible
from engram.llm.html_text import extract_main_text
from engram.llm.language_id import _grams
from engram.llm.packing import pack
from engram.llm.queries import BYTE_VOCABULARY, PIECE_MODEL
from engram.llm.textbatch import U64, mix
from engram.llm.token_counts import count_tokens, read_tokenizer

BROKEN = "cast(X'61FF6220C3' as string)"
READ = "a�b �"


def test_texts_that_are_not_utf8(spark):
    docs = spark.sql(f"select 1L as doc_id, {BROKEN} as text union all select 2L, '{READ}'")
    tokens = {r.doc_id: r.n_tokens for r in count_tokens(docs, read_tokenizer(PIECE_MODEL)).collect()}
    assert tokens[1] == tokens[2]
    packed = {r.doc_id: (r.length, r.ids_crc32) for r in pack(docs, read_tokenizer(BYTE_VOCABULARY)).collect()}
    assert packed[1] == packed[2]
    said = " and more words here to read." * 20
    pages = spark.sql(f"select 1L as page_id, 'u' as url, concat('<article><p>', {BROKEN}, '{said}</p></article>') as html union all select 2L, 'u', '<article><p>{READ}{said}</p></article>'")
    texts = {r.page_id: r.text for r in extract_main_text(pages).collect()}
    assert texts[1] == texts[2] != ""


def test_a_broken_text_leaves_its_neighbours_alone():
    def letters(texts):
        data = np.frombuffer(b"".join(texts), np.uint8)
        return _grams(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]))[1].tolist()

    for broken in (b"\x80" * 6, b"\xed\xa0\x80", b"abc\xe2\x82", b"\xff"):
        assert letters([broken, "12 34 é".encode(), b"", b"\xa9 ab"])[1:] == [1, 0, 2]


def test_ties_sort_by_the_text_as_it_is(spark):
    rows = [(1, 0, "user", "AB"), (1, 0, "user", "A<"), (1, 0, "user", "A\\")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert format_chats(table).first().formatted == "<turn user>\nA\\l<part>AB<part>A\\b</turn>\n"
    assert chat_digests(format_chats(table)).first().n_turns == 3


def test_bit_table(spark):
    own = mix(np.arange(3000, dtype=U64))
    tokens = spark.createDataFrame([(int(x),) for x in own.view(np.int64)], "token long")
    bits = _bit_table(tokens).value
    assert bits.dtype == np.uint8 and len(bits) == 1 << 13
    assert len(_possible(bits, own)) == 3000
    assert len(_possible(bits, mix(np.arange(10**6, 10**6 + 3000, dtype=U64)))) < 400


def test_pipeline_ends_in_ids(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(i, "one two three " * (i + 1)) for i in range(30)], "doc_id long, text string")
    packed = corpus_pipeline.best_fit_packing(spark, docs, "")
    assert packed.where(F.size("ids") != F.col("length")).isEmpty() and packed.where(F.element_at("ids", -1) == 0).count() == 30
