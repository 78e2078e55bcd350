"""Query-log, usage and job analytics (batch)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.functions.strings import path_template
from loomgraph.operators.ranking import page

# Price per million tokens of an unlisted model, histogram bounds in seconds.
DEFAULT_RATE = (5.0, 15.0)
LATENCY_BOUNDS = (0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def query_analytics(log: DataFrame) -> DataFrame:
    """Per tenant: totals, cache hit rate, mean and exact p95 latency, error rate.

    Rows are folded to (tenant, latency) counts first; the exact, interpolated
    percentile then reads distinct latencies with their frequencies, however
    many requests a tenant has.
    """
    folded = log.groupBy("tenant_id", "latency_ms").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("cached")).alias("hits"),
        F.count_if(F.col("error").isNotNull()).alias("errs"),
    )
    total = F.sum("n")
    weight = F.when(F.col("latency_ms").isNotNull(), F.col("n")).otherwise(0)
    return folded.groupBy("tenant_id").agg(
        total.alias("total_queries"),
        F.round(F.sum("hits") / total, 3).alias("cache_hit_rate"),
        F.round(F.sum(F.col("latency_ms") * F.col("n")) / F.sum(weight), 1).alias("avg_latency_ms"),
        F.round(F.percentile("latency_ms", F.lit(0.95), F.col("n")), 1).alias("p95_latency_ms"),
        F.sum("errs").alias("error_count"),
        F.round(F.sum("errs") / total, 3).alias("error_rate"),
    )


def counts_by(log: DataFrame, column: str) -> DataFrame:
    return (
        log.where(F.col(column).isNotNull())
        .groupBy("tenant_id", F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def history(log: DataFrame, tenant: str, limit: int = 50, offset: int = 0) -> DataFrame:
    mine = log.where(F.col("tenant_id") == tenant)
    return page(mine, limit, offset, F.desc("created_at"), F.desc("id"))


def token_cost(usage: DataFrame, rates: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Calls, tokens and cost: overall, by caller and by model.

    Tokens are summed per (caller, model) before they are priced; the rate
    table is a driver-side mapping.
    """
    folded = usage.groupBy("caller", "model").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
    )
    price_in, price_out = F.lit(DEFAULT_RATE[0]), F.lit(DEFAULT_RATE[1])
    for model, (rate_in, rate_out) in rates.items():
        price_in = F.when(F.col("model") == model, rate_in).otherwise(price_in)
        price_out = F.when(F.col("model") == model, rate_out).otherwise(price_out)
    cost = (F.col("input_tokens") * price_in + F.col("output_tokens") * price_out) / 1_000_000
    return (
        folded.withColumn("cost", cost)
        .groupingSets([[], ["caller"], ["model"]], "caller", "model")
        .agg(
            F.sum("calls").alias("calls"),
            F.sum("input_tokens").alias("input_tokens"),
            F.sum("output_tokens").alias("output_tokens"),
            F.round(F.sum("cost"), 4).alias("estimated_cost_usd"),
        )
    )


def latency_histogram(requests: DataFrame, bounds: Sequence[float] = LATENCY_BOUNDS) -> DataFrame:
    """Cumulative bucket counts by method and templated path.

    ``requests``: method, path, seconds.  Every row is put into its own bucket
    and counted; the cumulation runs over at most ``len(bounds) + 1`` rows per
    series.
    """
    bucket = F.lit(len(bounds))
    for i in reversed(range(len(bounds))):
        bucket = F.when(F.col("seconds") <= bounds[i], i).otherwise(bucket)
    counted = (
        requests.select("method", path_template(F.col("path")).alias("path"), bucket.alias("b"))
        .groupBy("method", "path", "b")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    labels = [str(b) for b in bounds] + ["+Inf"]
    dense = counted.groupBy("method", "path").pivot("b", list(range(len(labels)))).agg(F.sum("n"))
    running, total = [], F.lit(0)
    for i, label in enumerate(labels):
        total = total + F.coalesce(F.col(f"`{i}`"), F.lit(0))
        running.append(F.struct(F.lit(label).alias("le"), total.cast("long").alias("cnt")))
    return dense.select("method", "path", F.explode(F.array(*running)).alias("r")).select("method", "path", "r.*")


def requests_by_status(requests: DataFrame) -> DataFrame:
    return requests.groupBy("method", path_template(F.col("path")).alias("path"), "status").agg(
        F.count(F.lit(1)).alias("cnt")
    )


def job_counts(jobs: DataFrame, active: Sequence[str] = ("pending", "running")) -> DataFrame:
    """Jobs by status plus ``(total)`` and ``(active)``."""
    by_status = jobs.groupBy("status").agg(F.count(F.lit(1)).alias("cnt"))
    sums = by_status.agg(
        F.sum("cnt").alias("(total)"),
        F.coalesce(F.sum(F.when(F.col("status").isin(list(active)), F.col("cnt"))), F.lit(0)).alias("(active)"),
    )
    extra = sums.select(
        F.explode(
            F.array(
                *[F.struct(F.lit(c).alias("status"), F.col(f"`{c}`").alias("cnt")) for c in ("(total)", "(active)")]
            )
        ).alias("r")
    ).select("r.*")
    return by_status.unionByName(extra)


def trailing_counts(hits: DataFrame, key: str, ts: str, seconds: int = 60) -> DataFrame:
    """Per hit, the number of hits of its key in the trailing window, itself included.

    Each hit also joins the next time slot as context, and windows run per
    (key, slot): a key with a third of all hits is spread over its slots.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    width = seconds * 1_000_000
    slot = F.floor(micros / width)
    copies = hits.withColumn("_us", micros).withColumn(
        "_c", F.explode(F.array(F.struct(slot.alias("slot"), F.lit(True).alias("own")),
                                F.struct((slot + 1).alias("slot"), F.lit(False).alias("own"))))
    )
    w = Window.partitionBy(key, "_c.slot").orderBy("_us").rangeBetween(-(width - 1), 0)
    return (
        copies.withColumn("in_window", F.count(F.lit(1)).over(w)).where("_c.own").drop("_us", "_c")
    )
