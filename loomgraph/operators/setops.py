"""Set operations on keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.strings import singular


def distinct(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns).distinct()


def minus(golden: DataFrame, generated: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct golden rows whose key is not generated."""
    return golden.distinct().join(generated.select(*keys).distinct(), list(keys), "left_anti")


def matched(golden: DataFrame, generated: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct golden rows whose key is generated."""
    return golden.distinct().join(generated.select(*keys).distinct(), list(keys), "left_semi")


def match_labels(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, label) pairs equal up to case and English plural.

    Each side is expanded to its normal forms, so the match is an equi-join.
    """
    lowered, plain = F.lower("text"), F.lower("label")
    wanted = texts.select(
        "text",
        F.explode(
            F.array(F.struct(F.lit("as is").alias("form"), lowered.alias("word")),
                    F.struct(F.lit("singular").alias("form"), singular(lowered).alias("word")))
        ).alias("n"),
    )
    offered = labels.select(
        "label",
        F.explode(
            F.array(F.struct(F.lit("as is").alias("form"), plain.alias("word")),
                    F.struct(F.lit("singular").alias("form"), plain.alias("word")),
                    F.struct(F.lit("singular").alias("form"), singular(plain).alias("word")))
        ).alias("n"),
    )
    return wanted.join(offered, "n").select("text", "label").distinct()
