"""Top-k, paging, ranks and latest-row picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """Global top-k; give a total order so that ties do not flap."""
    return df.orderBy(*order).limit(k)


def top_k_per(df: DataFrame, keys: Sequence[str], k: int, order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """Top-k per key.  The rank filter lets Spark cut each group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    best = df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
    return best.withColumn(rank, F.col(rank).cast("long"))


def page(df: DataFrame, limit: int, offset: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def ranked_top(df: DataFrame, k: int, order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """Top-k with its 1-based positions; only k rows reach the numbering window."""
    return top_k(df, k, *order).withColumn(
        rank, F.row_number().over(Window.orderBy(*order)).cast("long")
    )


def keep_newest_finished(
    jobs: DataFrame, keep: int, terminal: Sequence[str], status: str, finished_at: str, key: str
) -> DataFrame:
    """All running jobs and the ``keep`` most recently finished ones."""
    done = F.col(status).isin(list(terminal))
    newest = top_k(jobs.where(done), keep, F.col(finished_at).desc(), F.col(key).desc())
    return jobs.where(~done | F.col(status).isNull()).unionByName(newest)


def latest_where(df: DataFrame, keys: Sequence[str], version: str, condition: Column) -> DataFrame:
    """Per key, the row of the highest version that satisfies ``condition``."""
    rest = [c for c in df.columns if c not in keys]
    best = df.where(condition).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(version)).alias("_row"))
    return best.select(*keys, "_row.*")


def longest_match(candidates: DataFrame, key: str, label_order: Column) -> DataFrame:
    """Per ``key``: the first label with a hit, then its longest name.

    ``min_by`` folds candidates before the shuffle, so a key with many
    candidates stays one row per task.
    """
    order = F.struct(label_order, -F.length("name"), F.col("name"))
    best = candidates.groupBy(key).agg(F.min_by(F.struct("name", "label"), order).alias("_best"))
    return best.select(key, "_best.*")
