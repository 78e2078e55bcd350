"""Graph and document upkeep: counts, deletes, resets, versioned storage."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.graph import PropertyGraph, union_all
from loomgraph.operators.counting import element_counts
from loomgraph.session import settle
from loomgraph.spec import GraphSpec


def load_report(spec: GraphSpec, tables: Mapping[str, DataFrame], g: PropertyGraph) -> DataFrame:
    """Rows offered and elements stored per type, with one scan of each table and one of its keys.

    ``offered`` counts source rows (for edges: rows with both endpoints set),
    ``stored`` counts what the upsert keeps.
    """
    counted = element_counts(g, tables, offered=True)
    sums = [
        F.coalesce(F.sum(F.when(F.col("what") == what, F.col("n"))), F.lit(0)).alias(what) for what in ("offered", "stored")
    ]
    return counted.groupBy("kind", "name").agg(*sums)


def delete_documents(
    ids: DataFrame, documents: DataFrame, chunks: DataFrame, mentions: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Drop documents, their chunks and those chunks' edges.

    ``ids``, ``documents``, ``chunks`` and ``mentions`` all have ``doc_id``.
    Returns the three remaining frames and the deleted node counts by label.
    """
    gone = ids.select("doc_id").distinct()
    counts = union_all(
        [
            documents.join(gone, "doc_id", "left_semi").select(F.lit("Document").alias("label")),
            chunks.join(gone, "doc_id", "left_semi").select(F.lit("Chunk").alias("label")),
        ]
    ).groupBy("label").agg(F.count(F.lit(1)).alias("deleted"))
    kept = [df.join(gone, "doc_id", "left_anti") for df in (documents, chunks, mentions)]
    return kept[0], kept[1], kept[2], counts


def reset_tenant(vertices: DataFrame, edges: DataFrame, tenant: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remove a tenant's vertices and every edge touching one of them.

    Returns remaining vertices, remaining edges, and the removed counts.
    """
    mine = F.coalesce("tenant_id", F.lit("_default_")) == tenant
    gone = vertices.where(mine).select("id")
    touched = union_all(
        [
            edges.join(gone.withColumnRenamed("id", side), side, "left_semi").select("src", "dst", "rel_type")
            for side in ("src", "dst")
        ]
    ).distinct()
    kept = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(
        gone.withColumnRenamed("id", "dst"), "dst", "left_anti"
    )
    counts = union_all(
        [gone.select(F.lit("node").alias("kind")), touched.select(F.lit("edge").alias("kind"))]
    ).groupBy("kind").agg(F.count(F.lit(1)).alias("removed"))
    return vertices.where(~mine), kept.select(*edges.columns), counts


# ---- storage -------------------------------------------------------------------


def write_graph(g: PropertyGraph, folder: str) -> None:
    """One Parquet folder per label and edge type below ``folder``.

    ``folder`` must be new: a build is visible only once a reader is pointed at
    it, so a failed build leaves the previous version untouched.
    """
    for label in g.labels:
        g.nodes(label).write.mode("errorifexists").parquet(f"{folder}/nodes/{label}")
    for name, source, target in g.edge_keys:
        g.edges(name, source, target).write.mode("errorifexists").parquet(f"{folder}/edges/{name}.{source}.{target}")


def read_graph(spark: SparkSession, spec: GraphSpec, folder: str) -> PropertyGraph:
    return PropertyGraph(
        spec,
        {n.label: spark.read.parquet(f"{folder}/nodes/{n.label}") for n in spec.nodes},
        {e.key: spark.read.parquet(f"{folder}/edges/{e.name}.{e.source}.{e.target}") for e in spec.edges},
    )


CHUNK_BUCKETS = 64


def write_chunks(
    chunks: DataFrame, folder: str, buckets: int = CHUNK_BUCKETS, documents: DataFrame | None = None
) -> None:
    """Store chunk rows by tenant and document bucket, replacing the touched documents.

    ``chunks`` has tenant_id, doc_id, chunk_index, text and what else is known.
    ``documents`` (tenant_id, doc_id) names the documents that were written: one
    of them without chunks loses its old ones.  By default those with chunks.
    A (tenant, bucket) partition is the unit of replacement: rows of other
    documents in it are carried over, so repeating a write changes nothing.
    ``buckets`` must stay the same for one folder.
    """
    spark = chunks.sparkSession
    fresh = chunks.withColumn("char_count", F.length("text").cast("long")).withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")
    )
    if path_exists(spark, folder):
        stored = spark.read.parquet(folder)
        written = (fresh if documents is None else documents).select("tenant_id", "doc_id").distinct()
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")
        touched = written.select("tenant_id", bucket.alias("bucket")).distinct()
        carried = stored.join(touched, ["tenant_id", "bucket"], "left_semi").join(
            written, ["tenant_id", "doc_id"], "left_anti"
        )
        # the partitions read here are about to be replaced
        fresh = settle(carried.unionByName(fresh, allowMissingColumns=True))
        emptied = settle(touched.join(fresh.select("tenant_id", "bucket").distinct(), ["tenant_id", "bucket"], "left_anti"))
        if not emptied.isEmpty():  # a partition left without rows is not written, so it has to go
            drop_partitions(spark, folder, emptied)
    replace_partitions(fresh, folder, "tenant_id", "bucket")


def drop_partitions(spark: SparkSession, folder: str, partitions: DataFrame) -> None:
    """Delete the folders of the (tenant_id, bucket) rows; at most as many as one write touches."""
    files = spark.read.parquet(folder).select("tenant_id", "bucket", F.col("_metadata.file_path").alias("path")).distinct()
    gone = files.join(partitions, ["tenant_id", "bucket"], "left_semi").select("path").collect()
    folders = {r["path"].rsplit("/", 1)[0] for r in gone}
    for path in folders:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def replace_partitions(df: DataFrame, folder: str, *columns: str) -> None:
    """Overwrite only the partitions that occur in ``df``; one file per partition."""
    (
        df.repartition(*columns)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*columns)
        .parquet(folder)
    )


def path_exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)
