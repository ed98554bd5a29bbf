"""From raw documents to packed sequences, a stage per operator.

``STAGES`` holds (name, function); each function takes (spark, docs, sf_dir) and
works on all that the stage before kept. Each row is judged by itself: a stage
numbers its rows by file and place in the file, gives operators that number for a
doc_id, and rows go by it, so null and shared doc_ids and repeated rows do no harm.
Documents that aren't a table of files are numbered in a copy in the shared folder.
``run`` writes each stage's result as a table in the shared folder and reads it
again for the next.

Nulls and odd rows: a null or empty text is rejected by language ID (no letter) and,
where a stage is used alone, by the base rules of the quality stage; the other two
filters keep it, and packing gives it one piece. Very long texts are handled whole.
Of repeated rows and near copies the n-gram stage keeps one, the smallest doc_id,
null ids last. Extra columns pass all filters, whatever their names. An empty
table gives an empty result.
"""

from __future__ import annotations

from itertools import count

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.common import stage_table, table
from engram.llm.decontaminate import find_contamination
from engram.llm.language_id import UNDETERMINED, identify, train
from engram.llm.ngram_join import near_duplicates
from engram.llm.packing import pack
from engram.llm.quality import clean_texts, judge_quality, measure
from engram.llm.queries import BYTE_VOCABULARY
from engram.llm.token_counts import read_tokenizer

MIN_SCORE = 0.5
BROADCAST_IDS = 1_000_000
ROW_BITS = 40  # rows of a file


def _is_of_files(docs: DataFrame) -> bool:
    """Whether each row is a row of a Parquet file: a scan, or columns or rows picked from one."""
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    try:
        return node.nodeName() == "LogicalRelation" and bool(docs.select(docs.metadataColumn("_metadata")["row_index"]).columns)
    except AnalysisException:
        return False


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a number of their own for each row, and the name of its column.

    Rows of files are numbered by file (these are as many as the driver lists to read the table, 16 bytes each
    here) and row of the file, so each plan over ``docs`` numbers them alike.
    """
    free = (name for k in count() if not {name := f"_row{k}", f"{name}_file", f"{name}_at", f"{name}_number"} & {c.lower() for c in docs.columns})
    key = next(free)
    file, at, number = f"{key}_file", f"{key}_at", f"{key}_number"
    if not _is_of_files(docs):
        return stage_table(docs.withColumn(key, F.monotonically_increasing_id()), "rows"), key
    where = docs.metadataColumn("_metadata")
    placed = docs.select(*docs.columns, F.xxhash64(where["file_path"]).alias(file), where["row_index"].alias(at))
    found = sorted(r[0] for r in placed.select(file).distinct().collect())
    numbers = docs.sparkSession.createDataFrame([(f, k) for k, f in enumerate(found)], f"{file} long, {number} long")
    return placed.join(F.broadcast(numbers), file).select(*docs.columns, (F.shiftleft(number, ROW_BITS) + F.col(at)).alias(key)), key


def _as_id(numbered: DataFrame, key: str) -> DataFrame:
    return numbered.withColumn("doc_id", F.col(key)).drop(key)


def _without(numbered: DataFrame, key: str, rejected: DataFrame, name: str) -> DataFrame:
    """The documents whose numbers aren't rejected; the numbers are broadcast if they are few, else joined by shuffle."""
    gone = stage_table(rejected.select(F.col("doc_id").alias(f"{key}_number")), name)
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return numbered.join(F.broadcast(gone) if few else gone, F.col(key) == F.col(f"{key}_number"), "left_anti").drop(key)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a learned language, told with some confidence."""
    rows, key = _numbered(docs)
    found = identify(_as_id(rows, key), train(docs))
    return _without(rows, key, found.where((F.col("lang_pred") == UNDETERMINED) | (F.col("score") < MIN_SCORE)), "not-told")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and aren't depleted of lines of their own, without the lines above the limits."""
    rows, key = _numbered(docs)
    measured = measure(_as_id(rows, key))
    kept = _without(rows, key, judge_quality(rows, measured=measured).where(~F.col("kept")), "low-quality")
    clean = clean_texts(kept, measured=measured)
    length = F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")) if "n_chars" in docs.columns else None
    return clean if length is None else clean.withColumn("n_chars", length)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest id, null ids last."""
    rows, key = _numbered(docs)
    found = stage_table(near_duplicates(_as_id(rows, key)).select("doc_id", "component_id"), "classes")
    ids = rows.select(F.col(key).alias("key"), F.col("doc_id").alias("id"))
    firsts = found.join(ids, F.col("doc_id") == F.col("key")).groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("first"))
    return _without(rows, key, found.join(firsts.select(F.col("first.key").alias("doc_id")), "doc_id", "left_anti"), "duplicates")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by benchmark items."""
    rows, key = _numbered(docs)
    found = find_contamination(_as_id(rows, key), table(spark, sf_dir, "benchmark"))
    return _without(rows, key, found.where("contaminated"), "contaminated")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents with their sequences and token ids."""
    return pack(docs, read_tokenizer(BYTE_VOCABULARY), with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Language ID, connected components and packing aren't expressible in SQL; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
