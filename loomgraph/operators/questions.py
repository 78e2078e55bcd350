"""Batch classification of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as tx
from loomgraph.functions.plan import spread


def classify(questions: DataFrame, key: str, text: str) -> DataFrame:
    """Template, route and parameters of every question, by the first matching rule."""
    rows = spread(questions.select(key, text), key)
    return rows.select(key, tx.classify_question(F.col(text)).alias("c")).select(key, "c.*")


def profile(questions: DataFrame, key: str, text: str) -> DataFrame:
    """Intent, aggregate flag and traversal depth of every question."""
    col = F.col(text)
    return questions.select(
        key, tx.intent(col).alias("intent"), tx.is_aggregate(col).alias("is_aggregate"), tx.depth(col).alias("depth")
    )
