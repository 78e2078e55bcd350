"""Input tables of the operators; ``tidy`` gives back what their tasks leave behind, ``sent_once`` what they need not hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.session import tidy as tidy


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def sent_once(df: DataFrame, keep: list[str], column: str, name: str) -> tuple[DataFrame, int]:
    """Columns ``keep`` of ``df``, and the place among them of the texts in ``column``.

    Only if they are not kept anyway, the texts come last as ``name``: a batch
    sent to a worker holds them once, not twice.
    """
    low = [c.lower() for c in keep]
    if column.lower() in low:
        return df.select(*keep), low.index(column.lower())
    return df.select(*keep, F.col(column).alias(name)), len(keep)
