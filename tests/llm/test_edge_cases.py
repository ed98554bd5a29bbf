"""Odd rows and limits: quality verdicts, language scores, and the stages of the pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from engram.llm import language_id
from engram.llm.language_id import identify, train
from engram.llm.quality import judge_quality

SF = "/root/testdata/sf0.001"


def own(k, n=60):
    return " ".join(f"w{k}x{j}" for j in range(n))


@pytest.mark.parametrize("line", ["read more on our site", "a", "subscribe to the letter", "zz top", "Ein Satz."])
def test_line_limit_is_exact(spark, line):
    """Thirty documents of a host keep a line, thirty-one lose it, whatever its hash; copies of a text and other hosts don't count."""
    rows = [(i, f"{line}\n{own(i)}", "thirty") for i in range(30)] + [(900 + i, f"{line}\n{own(0)}", "thirty") for i in range(5)]
    rows += [(100 + i, f"{line}\n{own(100 + i)}", "more") for i in range(31)] + [(200 + i, f"{line}\n{own(200 + i)}", None) for i in range(31)]
    got = {r.doc_id: r.removed_words for r in judge_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {i: 0 if h == "thirty" else len(line.split()) for i, _, h in rows}


def test_a_quarter_is_enough(spark):
    shared = "\n".join(own(1000 + k, 10) for k in range(15))
    rows = [(i, f"{shared}\n{own(i, 50 if i else 49)}", "s") for i in range(40)]
    got = {r.doc_id: (r.n_words, r.removed_words, r.kept) for r in judge_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0] == (199, 150, False)
    assert {got[i] for i in range(1, 40)} == {(200, 150, True)}


def test_scores_equal_a_plain_computation(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = train(docs)
    odd = [(-1, "é" * 3, "x"), (-2, "The cat sat 12 on THE mat", "x"), (-2, "The cat sat 12 on THE mat", "x"), (-3, "a", None), (-4, "1 2 3", "x"), (-5, None, "x"), (-6, "Straße und İstanbul", "x"), (-7, "word " * 200_000, "x")]
    rows = docs.select("doc_id", "text", "lang").limit(40).unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string"))
    got = identify(rows, model).collect()
    texts = {r.doc_id: r.text for r in rows.collect()}
    assert len(got) == 48 and sum(r.doc_id == -2 for r in got) == 2

    def plain(text):
        """Weights of each n-gram looked up one by one, in float64."""
        low = [ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in text]
        codes = [k if c.isalpha() else 0 for k, c in zip(low, text, strict=True)]
        sums, n = np.zeros(len(model.languages)), 0
        for size in language_id.ORDERS:
            for at in range(len(codes) - size + 1):
                gram = codes[at : at + size]
                if any(gram):
                    key = 0
                    for k, c in enumerate(gram):
                        key = (key * 0x01000193 + c + k + 1) % 2**32
                    bucket = ((key ^ (key >> 15)) * 0x9E3779B1 % 2**32) >> (32 - language_id.BITS)
                    sums += model.weights[max(bucket, 1)].astype(float)
                    n += 1
        z = (sums / max(n, 1) + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        return model.languages[int(p.argmax())], p.max()

    for r in got:
        text = texts[r.doc_id]
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif len(text) < 20_000:
            name, score = plain(text)
            assert r.lang_pred == name and abs(r.score - score) < 1e-5


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _row0 string, _ROW1_at int, node int, row string, host string, sid string, gone int, token string, key string"


def stage_rows(spark, texts):
    english = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en' and n_chars between 600 and 2000").orderBy("doc_id").limit(60).collect()]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(english)] + texts
    return spark.createDataFrame([(*r, "a", 1, 2, "b", "c", "d", 3, "e", "f") for r in rows], COLUMNS), english


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, tmp_path, name, stage):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    long = " ".join(f"thing{i} and" for i in range(40_000))
    odd = [(None, None, None, None, None), (None, "", "en", None, 0), (7000, None, "en", "s", None), (7001, long, "en", "s", len(long)), (7001, item, "en", "s", 1), (None, long, "en", None, 1)]
    df, english = stage_rows(spark, odd)
    path = f"file://{tmp_path}/docs"
    df.repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    assert stage(spark, docs.limit(0), SF).count() == 0
    found = stage(spark, docs, SF)
    if name == "best_fit_packing":
        assert found.where("piece = 0").count() == docs.count() and found.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
        return
    assert found.columns == docs.columns
    kept = sorted(((r.doc_id, r.text) for r in found.collect()), key=str)
    assert all(r.node == 2 and r._row0 == "a" for r in found.select("node", "_row0").collect())
    assert {t for _, t in kept if t} <= {*english, long, item}
    by_stage = {
        "language_id": [(7001, long), (7001, item), (None, long)],
        "quality_rules": [(7001, long), (None, long)],
        "ngram_jaccard_join": [(None, None), (None, ""), (7000, None), (7001, long), (7001, item)],
        "benchmark_decontamination": [(None, None), (None, ""), (7000, None), (7001, long), (None, long)],
    }
    judged = [k for k in kept if k[0] is None or k[0] >= 7000]
    assert sorted(judged, key=str) == sorted(((i, t) for i, t in by_stage[name] if t != item or name != "quality_rules"), key=str)


def test_shared_and_null_ids_lose_no_text(spark, tmp_path):
    t, u = own(1), own(2)
    rows = [(1, t), (1, u), (None, t), (None, t), (2, u + " tail")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.repartition(4).write.parquet(f"file://{tmp_path}/docs")
    for docs in (df, spark.read.parquet(f"file://{tmp_path}/docs"), spark.read.parquet(f"file://{tmp_path}/docs").withColumn("x", F.explode(F.array(F.lit(1), F.lit(2))))):
        assert sorted(r.text for r in corpus_pipeline.ngram_jaccard_join(spark, docs, SF).collect()) == [t, u]
