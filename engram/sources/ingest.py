"""Perceptions from texts or vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import physics
from ..functions.text import trait_pairs, trait_values
from .embedder import Embedder, embed

# Defaults of the statement language and of the plain calls.
SALIENCE, HALFLIFE = 0.5, 86_400.0

SCHEMA = "seq bigint, subject string, embedding array<double>, traits map<string,string>, label string, salience double, lambda double, tick double, expires_at double"


def perceptions(rows: DataFrame, *, embedder: Embedder | None = None, salience: float = SALIENCE, halflife: float = HALFLIFE) -> DataFrame:
    """Rows (seq, subject, tick, traits or text, and optionally embedding, salience, halflife) as perceptions.

    A text becomes the trait ``text``. Without an embedding column, trait pairs are embedded.
    """
    have = set(rows.columns)
    out = rows if "traits" in have else rows.withColumn("traits", F.create_map(F.lit("text"), F.col("text")))
    out = out.withColumn("salience", F.coalesce("salience", F.lit(salience)) if "salience" in have else F.lit(salience))
    out = out.withColumn("lambda", physics.lambda_from_halflife(F.coalesce("halflife", F.lit(halflife)) if "halflife" in have else F.lit(halflife)))
    out = out.withColumns({"label": trait_values(F.col("traits")), "expires_at": physics.expires_at(F.col("salience"), F.col("lambda"), F.col("tick"))})
    if "embedding" not in have:
        if embedder is None:
            raise ValueError("give an embedder, or rows with embeddings")
        out = embed(out.withColumn("_pairs", trait_pairs(F.col("traits"))), "_pairs", embedder)
    return out.select("seq", "subject", F.col("embedding").cast("array<double>").alias("embedding"), "traits", "label", "salience", "lambda", "tick", "expires_at")


def perceptions_of_texts(rows: DataFrame, embedder: Embedder, *, salience: float = 1.0, halflife: float = 64_800.0) -> DataFrame:
    """Rows (seq, subject, text, tick): the text is embedded itself and kept as a trait."""
    return perceptions(embed(rows, "text", embedder), salience=salience, halflife=halflife)
