"""Adapters from the driver's tables to the data model.

``seq`` is the order of arrival, ``tick`` the logical clock in seconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import physics
from ..functions.text import word_count

# Fixed values of the fixtures.
EPOCH_START = 1_704_067_200  # 2024-01-01 UTC
HALFLIFE = {"error": 3_600.0, "click": 21_600.0, "view": 43_200.0, "signup": 604_800.0, "purchase": 2_592_000.0}
LABELS = ("click", "error", "purchase", "signup", "view")
CYCLES = 30
CYCLE_SECONDS = 86_400.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def perceptions_of(events: DataFrame) -> DataFrame:
    """One perception per event, with traits, label and expiry."""
    lives = F.create_map(*(x for k, v in HALFLIFE.items() for x in (F.lit(k), F.lit(v))))
    k = F.get_json_object("props", "$.k")
    rows = events.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("user:"), F.col("user_id")).alias("subject"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6) - EPOCH_START).alias("tick"),
        (F.lit(0.1) + F.lit(0.9) * F.col("value") / F.lit(600.0)).alias("salience"),
        lives[F.col("event_type")].alias("halflife"),
        F.col("event_type").alias("label"),
        k.cast("int").alias("k"),
        F.create_map(F.lit("act"), F.col("event_type"), F.lit("k"), k).alias("traits"),
    )
    rows = rows.withColumn("lambda", physics.lambda_from_halflife(F.col("halflife")))
    return rows.withColumn("expires_at", physics.expires_at(F.col("salience"), F.col("lambda"), F.col("tick")))


def perceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perceptions_of(read(spark, sf_dir, "events"))


def one_hot(label: str = "label") -> F.Column:
    """The label as a unit vector over ``LABELS``."""
    return F.array(*(F.when(F.col(label) == x, F.lit(1.0)).otherwise(F.lit(0.0)) for x in LABELS))


def perceptions_onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perceptions(spark, sf_dir).withColumn("embedding", one_hot())


def perceptions_graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-hot with a sixth component ``k / 100``."""
    return perceptions(spark, sf_dir).withColumn("embedding", F.concat(one_hot(), F.array(F.col("k") / F.lit(100.0))))


def alive_per_cycle(rows: DataFrame, cycles: int = CYCLES, span: float = CYCLE_SECONDS) -> DataFrame:
    """Each perception once per cycle at whose tick it is alive.

    An interval join in effect; cycles being evenly spaced, the matching ones are a
    range of integers, so rows are expanded where they are and nothing is shuffled.
    """
    first = F.greatest(F.lit(1), F.ceil(F.col("tick") / span)).cast("int")
    last = F.least(F.lit(cycles), F.floor(F.col("expires_at") / span)).cast("int")
    live = rows.where(last >= first)
    return live.withColumn("cycle", F.explode(F.sequence(first, last)))


def facts_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as facts; subject by label, an hour apart."""
    lam = physics.lambda_from_halflife(30 * physics.DAY)
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("seq"),
        F.concat(F.lit("label:"), F.col("label")).alias("subject"),
        F.concat(F.lit("vec "), F.col("vec_id")).alias("text"),
        "embedding",
        F.lit("table").alias("provenance"),
        (F.col("vec_id") * 3600.0).alias("created_at"),
        F.lit(1.0).alias("salience"),
        F.lit(lam).alias("lambda"),
        F.lit(0.0).alias("reinforcement"),
        (F.col("vec_id") * 3600.0).alias("last_touch"),
    )


def facts_onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fact per event, to be remembered in order of arrival."""
    return perceptions_onehot(spark, sf_dir).select("seq", "subject", F.concat_ws(" ", "label", "seq").alias("text"), "embedding", F.lit("event").alias("provenance"), "tick", F.lit(0.9).alias("salience"), F.lit(30 * physics.DAY).alias("halflife"))


def facts_graded(spark: SparkSession, sf_dir: str, hot: bool = False) -> DataFrame:
    """One fact per event as a point on the circle, at an angle that grows with ``k``; with ``hot`` every second one is of one subject."""
    rows = perceptions(spark, sf_dir)
    angle = F.lit(0.04) * F.col("k") + F.lit(0.0001) * F.col("k") * F.col("k")
    subject = F.when(F.col("seq") % 2 == 0, F.lit("hot")).otherwise(F.col("subject")) if hot else F.col("subject")
    return rows.select("seq", subject.alias("subject"), F.concat_ws(" ", F.lit("k"), "k", "seq").alias("text"), F.array(F.cos(angle), F.sin(angle)).alias("embedding"), F.lit("event").alias("provenance"), "tick", F.lit(0.9).alias("salience"), F.lit(30 * physics.DAY).alias("halflife"))


def facts_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as facts with a cost in words."""
    lam = physics.lambda_from_halflife(30 * physics.DAY)
    rows = read(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.concat(F.lit("conv:"), F.col("conv_id")).alias("subject"), "text", F.col("role").alias("provenance"), (F.col("turn") * 3600.0).alias("created_at"), F.lit(1.0).alias("salience"), F.lit(lam).alias("lambda")
    )
    return rows.withColumn("cost", word_count(F.col("text")))


def labelled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a known quality: a score (characters) and the truth."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    return docs.join(read(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("actual")), "doc_id")
