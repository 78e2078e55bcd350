"""Streams that maintain stored graphs and document collections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.graph import merge_rows
from loomgraph.operators.hybrid import ingest
from loomgraph.operators.maintenance import path_exists, replace_partitions
from loomgraph.session import settle, shared_dir

BUCKETS = 64


def upsert(batch: DataFrame, folder: str, keys: Sequence[str], order: Sequence[str], buckets: int = BUCKETS) -> None:
    """Merge rows into a stored table: one row per key, the last along ``order``.

    Only the hash buckets the batch touches are read and replaced.  The order
    columns stay in the table, so replaying a batch changes nothing.
    """
    spark = batch.sparkSession
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    rows = batch.withColumn("bucket", bucket)
    if path_exists(spark, folder):
        touched = rows.select("bucket").distinct()  # at most ``buckets`` rows
        stored = spark.read.parquet(folder).join(F.broadcast(touched), "bucket", "left_semi")
        rows = stored.unionByName(rows, allowMissingColumns=True)
    values = [c for c in batch.columns if c not in keys]
    merged = merge_rows(rows, [*keys, "bucket"], [F.col(c) for c in order], values)
    replace_partitions(settle(merged), folder, "bucket")


def upsert_graph(
    stream: DataFrame, folder: str, keys: Sequence[str], order: Sequence[str], buckets: int = BUCKETS
) -> DataFrame:
    """Drain a stream of node or edge rows into a stored table and return it."""
    state = shared_dir(stream.sparkSession, "stream")
    query = (
        stream.writeStream.foreachBatch(lambda batch, _: upsert(batch, folder, keys, order, buckets))
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.parquet(folder).drop("bucket")


DOCUMENT_TABLES = ("documents", "chunks", "mentions")


def ingest_documents(
    stream: DataFrame, names: DataFrame, folder: str, order: Sequence[str] = (), generation: int = 0, **options
) -> dict[str, DataFrame]:
    """Drain a stream of (doc_id, filename, content) into documents, chunks and mentions.

    Every micro-batch appends rows under its own version, and ``stored_documents``
    shows of each document what its newest version left: a document that shrank,
    failed or lost entities keeps nothing of older versions, whatever the batch
    did not touch stays, and no stored file is rewritten.  A repeated batch
    replaces its own version.  Within a batch the last row of a document along
    ``order`` counts.  A later drain into the same folder needs a higher
    ``generation``.  ``options`` go to ``ingest``.
    """
    spark = stream.sparkSession
    schemas: dict[str, T.StructType] = {}

    def store(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c != "doc_id"]
        last = F.max(F.struct(*order, *(c for c in rest if c not in order))).alias("_d")
        newest = batch.groupBy("doc_id").agg(last).select("doc_id", "_d.*")
        got = ingest(settle(newest), names, **options)
        for name, rows in zip(DOCUMENT_TABLES, (got.documents, got.chunks, got.found), strict=True):
            versioned = rows.withColumn("version", F.lit((generation << 40) + number).cast("bigint"))
            schemas[name] = versioned.schema
            (
                versioned.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                .partitionBy("version").parquet(f"{folder}/{name}")
            )

    query = (
        stream.writeStream.foreachBatch(store)
        .option("checkpointLocation", shared_dir(spark, "stream"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if not schemas:
        store(spark.createDataFrame([], stream.schema), 0)
    return stored_documents(spark, folder, schemas)


def stored_documents(spark: SparkSession, folder: str, schemas: dict[str, T.StructType]) -> dict[str, DataFrame]:
    """The newest version of every (tenant, document) in the three tables."""
    tables = {name: spark.read.schema(schemas[name]).parquet(f"{folder}/{name}") for name in DOCUMENT_TABLES}
    newest = tables["documents"].groupBy("tenant_id", "doc_id").agg(F.max("version").alias("version"))
    return {
        name: rows.join(newest, ["tenant_id", "doc_id", "version"], "left_semi").drop("version")
        for name, rows in tables.items()
    }


def compact_documents(stored: dict[str, DataFrame], folder: str, generation: int) -> None:
    """Write what is current to a new folder, as one version; run it off the stream."""
    for name, rows in stored.items():
        rows.withColumn("version", F.lit(generation << 40).cast("bigint")).write.partitionBy("version").parquet(f"{folder}/{name}")
