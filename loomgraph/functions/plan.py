"""Helpers that keep plans safe at scale: checked broadcasts, split prefix sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.session import cut_lineage, settle

MAX_BROADCAST_ROWS = 200_000
TASK_ROWS = 400_000


def estimated_bytes(df: DataFrame) -> int:
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes()))


def auto_broadcast_bytes(df: DataFrame) -> int:
    raw = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(raw)


def small_side(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when ``df`` is proven to have few rows.

    If the optimiser's own estimate is already below its threshold nothing has
    to be done.  Otherwise a filter may still leave few rows of a large table,
    which the estimate cannot know: count at most ``max_rows + 1`` of them.
    Above the bound the frame is returned unhinted and joins by shuffle.
    """
    if estimated_bytes(df) <= auto_broadcast_bytes(df):
        return df
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def counted_side(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when ``df`` has few rows, counted whatever the estimates say.

    For the folded side of a join whose other side shrinks well on disk: by its
    estimate that one may be broadcast instead, and the few rows of ``df``
    would then give all of the result in one task.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def sized(df: DataFrame) -> DataFrame:
    """``df`` with a size the planner can trust.

    After a join or two the optimiser's estimate says nothing.  If it is below
    the broadcast threshold it is good enough; otherwise the frame is stored,
    so the next join is planned on its true size and nothing is computed twice.
    """
    return df if estimated_bytes(df) <= auto_broadcast_bytes(df) else settle(df)


def bounded_rows(df: DataFrame, max_rows: int) -> list | None:
    """Rows of ``df`` on the driver, or None when there are more than ``max_rows``."""
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give every core a share of an input too small to fill one split per core.

    For work that is heavy per row (parsing, chunking, matching).  Larger
    inputs already have a split per core and are left alone, so the shuffle
    added here never moves more than one split per core.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    if estimated_bytes(df) >= cores * split:
        return df
    return df.repartition(cores, *keys)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over a task per ``TASK_ROWS`` of its ``rows``.

    Shuffled numbers shrink so well that tasks sized by bytes hold millions of
    rows.  Inputs that fit a few tasks are left alone.  Never fewer tasks than
    the session's shuffles have: a join would shuffle the rows once more to
    that number, and its tasks would again be sized by bytes.
    """
    tasks = -(-rows // TASK_ROWS)
    spark = df.sparkSession
    if tasks <= spark.sparkContext.defaultParallelism:
        return df
    return df.repartition(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: Column,
    out: str,
    block: int = 4096,
) -> DataFrame:
    """Exclusive running sum of ``value`` per key along integer ``order``.

    Two levels, so one long key is spread over many tasks: rows are grouped in
    blocks of the order column, block totals are accumulated per key, and only
    within a block are rows accumulated one by one.
    """
    staged = df.withColumn("_v", value).withColumn("_b", F.floor(F.col(order) / block))
    totals = staged.groupBy(*keys, "_b").agg(F.sum("_v").alias("_t"))
    over_blocks = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, "_b", F.coalesce(F.sum("_t").over(over_blocks), F.lit(0)).alias("_c"))
    within = (
        Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        staged.join(carried, [*keys, "_b"])
        .withColumn(out, F.col("_c") + F.coalesce(F.sum("_v").over(within), F.lit(0)))
        .drop("_v", "_b", "_c")
    )


def number_rows(df: DataFrame, order: Sequence[Column], out: str, partitions: int | None = None) -> DataFrame:
    """1-based global position along ``order`` without one-task sorting.

    Rows are range-partitioned and sorted, the result is checkpointed so that
    positions are stable, and each partition is shifted by the row count of
    those before it.  The order must be total.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranged = cut_lineage(
        ranged.withColumn("_p", F.spark_partition_id()).withColumn(
            "_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        )
    )
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition: bounded by ``n``
    shift = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    return (
        ranged.join(F.broadcast(shift), "_p")
        .withColumn(out, F.col("_s") + F.col("_i") + 1)
        .drop("_p", "_i", "_s")
    )
