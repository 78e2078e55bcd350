"""Approximate cosine search over learned cells.

``CellIndex.build`` trains coarse centroids by k-means on a bounded sample, puts
every item into the cell of its nearest centroid and stores it there with a code:
its offset from the centroid in one byte per dimension.  ``search`` lets every query
visit the cells nearest to it, scores their codes block by block, and computes exact
scores for the best few only.

* The cell key holds the columns that must agree (a tenant), so other tenants'
  items are not met at all.
* The table is partitioned by cell, so cells that no query visits are not read.  A
  crowded cell is cut into parts of about ``PART`` items: a task holds one part.
* How many cells a query has to visit depends on the vectors.  ``calibrate`` finds it
  from the exact neighbours of a bounded set of probes: the fewest cells that hold
  the wanted share of them.  Well separated groups need a few cells, near-random
  vectors about half of them; ``search`` reports the pairs met beside the result.

Centroids are the only thing broadcast: at most ``MAX_CELLS`` of them, however many
items there are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions.plan import small_side
from loomgraph.operators.ranking import top_k_per
from loomgraph.operators.vectors import SCORE_DIGITS, cosine_topk, nonzero, norm
from loomgraph.session import settle, tidy

MAX_CELLS = 4096
SAMPLE_PER_CELL = 64
PART = 4096
PROBES = 256
HELD = 1 << 21  # scores a task computes at once


def cells_for(items: int) -> int:
    """About as many cells as a cell has items, four times that for small tables."""
    return max(1, min(MAX_CELLS, round(4 * items**0.5)))


def _slices(rows: int, width: int) -> Iterator[tuple[int, int]]:
    """Stretches (first, length) of ``rows`` that with ``width`` scores each stay within ``HELD``."""
    step = max(1, HELD // max(1, width))
    for first in range(0, rows, step):
        yield first, min(step, rows - first)


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors, one per row."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


@dataclass
class CellIndex:
    centroids: np.ndarray
    table: DataFrame  # _tag, _cell, _part, item key, _scale, _code
    items: DataFrame  # item key, vector
    item_key: str
    vector: str
    within: tuple[str, ...] = ()
    visits: int = 1

    @staticmethod
    def build(
        corpus: DataFrame, item_key: str = "item_id", vector: str = "embedding", within: Sequence[str] = (),
        cells: int | None = None, seed: int = 42,
    ) -> CellIndex:
        """Keys must be distinct."""
        items = nonzero(corpus, vector).select(item_key, vector, _tag(within).alias("_tag"))
        total = items.count()
        cells = cells or cells_for(total)
        # a bounded sample: the rows of smallest hash
        sample = items.orderBy(F.xxhash64(item_key, F.lit(seed)), item_key).limit(cells * SAMPLE_PER_CELL)
        unit = F.transform(vector, lambda x: x.cast("double") / norm(F.col(vector)))
        points = settle(sample.select(array_to_vector(unit).alias("features")))
        if total:
            if min(cells, total) > 1:
                centroids = np.array(KMeans(k=min(cells, total), initMode="random", maxIter=8, seed=seed).fit(points).clusterCenters())
            else:
                centroids = np.array([r.features.toArray() for r in points.collect()]).mean(axis=0, keepdims=True)
            lengths = np.linalg.norm(centroids, axis=1, keepdims=True)
            centroids = centroids / np.where(lengths > 0, lengths, 1)
        else:
            centroids = np.zeros((0, 0))
        shared = items.sparkSession.sparkContext.broadcast(centroids)
        schema = T.StructType(
            [items.schema["_tag"], T.StructField("_cell", T.IntegerType()), items.schema[item_key],
             T.StructField("_scale", T.DoubleType()), T.StructField("_code", T.BinaryType())]
        )

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for first, length in _slices(whole.num_rows, len(shared.value)):
                    batch = whole.slice(first, length)
                    points = _matrix(batch.column(1))
                    cell = (points @ shared.value.T).argmax(axis=1)
                    offset = points - shared.value[cell]
                    scale = np.abs(offset).max(axis=1) / 127
                    code = np.round(offset / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(2), pa.array(cell.astype(np.int32)), batch.column(0), pa.array(scale),
                         pa.array([row.tobytes() for row in code], pa.binary())],
                        names=schema.names,
                    )

        placed = settle(items.mapInArrow(tidy(place), schema))
        sizes = placed.groupBy("_tag", "_cell").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("_parts"))
        part = F.pmod(F.xxhash64(item_key), F.col("_parts")).cast("int")
        parted = placed.join(small_side(settle(sizes)), ["_tag", "_cell"]).withColumn("_part", part)
        table = settle(parted.repartition("_cell", "_tag", "_part"), "_cell")
        return CellIndex(centroids, table, items.drop("_tag"), item_key, vector, tuple(within))

    def nearest_cells(self, queries: DataFrame, query_key: str, visits: int) -> DataFrame:
        """(query key, vector, _tag, _cell, _near) for the cells a query visits, nearest first."""
        shared = queries.sparkSession.sparkContext.broadcast(self.centroids)
        cells = T.ArrayType(T.IntegerType())

        @F.pandas_udf(cells)
        def order(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                nearest = []
                for first, length in _slices(len(batch), len(shared.value)):
                    points = np.array(batch.iloc[first : first + length].tolist(), dtype=np.float64)
                    ranked = np.argsort(-(points @ shared.value.T), axis=1, kind="stable")
                    nearest.extend(ranked[:, :visits].astype(np.int32))
                yield pd.Series(nearest, dtype=object)

        asked = nonzero(queries, self.vector).select(query_key, self.vector, _tag(self.within).alias("_tag"))
        return asked.select(query_key, self.vector, "_tag", F.posexplode(order(self.vector)).alias("_near", "_cell"))

    def calibrate(self, probes: DataFrame, corpus: DataFrame, k: int, share: float = 0.92, query_key: str = "query_id") -> CellIndex:
        """The index with the fewest ``visits`` whose cells hold ``share`` of the exact neighbours of at most ``PROBES`` probes."""
        few = settle(probes.orderBy(F.xxhash64(query_key), query_key).limit(PROBES))
        exact = cosine_topk(few, corpus, k, query_key, self.item_key, self.vector, self.within)
        home = exact.join(self.table.select(self.item_key, "_cell"), self.item_key)
        order = self.nearest_cells(few, query_key, len(self.centroids)).select(query_key, "_cell", "_near")
        found = home.join(order, [query_key, "_cell"]).groupBy("_near").count().collect()  # one row per cell
        wanted, seen, visits = share * sum(r["count"] for r in found), 0, 1
        for r in sorted(found):
            if seen >= wanted:
                break
            seen, visits = seen + r["count"], r["_near"] + 1
        self.visits = visits
        return self

    def search(self, queries: DataFrame, k: int, query_key: str = "query_id", rescored: int = 4) -> tuple[DataFrame, DataFrame]:
        """(query key, item key, score, rank), and (query key, met): how many items' codes a query was compared with.

        Of each part the ``rescored`` * k best codes go on, of all parts together as many
        are scored exactly.  Ties go to the smaller item key.
        """
        if not len(self.centroids):
            none = nonzero(queries, self.vector).select(query_key).limit(0)
            item = F.lit(None).cast(self.items.schema[self.item_key].dataType).alias(self.item_key)
            return none.select(query_key, item, F.lit(0.0).alias("score"), F.lit(0).alias("rank")), none.withColumn("met", F.lit(0))
        probes = settle(self.nearest_cells(queries, query_key, self.visits).drop("_near"))
        cells = probes.select("_tag", "_cell").distinct()
        index = self.table.join(small_side(settle(cells)), ["_tag", "_cell"], "left_semi")
        parts = settle(index.groupBy("_tag", "_cell", "_part").agg(F.count(F.lit(1)).alias("_size")))
        asked = probes.join(parts, ["_tag", "_cell"])
        none = lambda f: F.lit(None).cast(f.dataType).alias(f.name)
        unit = F.transform(self.vector, lambda x: x.cast("double") / norm(F.col(self.vector)))
        key, item = probes.schema[query_key], self.table.schema[self.item_key]
        rows = index.select(
            "_tag", "_cell", "_part", F.lit(0).alias("_role"), self.item_key, "_scale", "_code", none(key),
            F.lit(None).cast("array<double>").alias("_asked"),
        ).union(
            asked.select(
                "_tag", "_cell", "_part", F.lit(1).alias("_role"), none(item), F.lit(None).cast("double"),
                F.lit(None).cast("binary"), query_key, unit.alias("_asked"),
            )
        )
        shared = queries.sparkSession.sparkContext.broadcast(self.centroids)
        schema = T.StructType([key, item, T.StructField("_about", T.DoubleType())])
        scan = _scan(shared, rescored * k, schema)
        about = rows.repartition("_tag", "_cell", "_part").sortWithinPartitions("_tag", "_cell", "_part", "_role").mapInArrow(tidy(scan), schema)
        best = settle(top_k_per(about, [query_key], rescored * k, [F.desc("_about"), F.asc(self.item_key)]))
        both = best.select(query_key, self.item_key).join(self.items, self.item_key)
        both = both.join(nonzero(queries, self.vector).select(query_key, F.col(self.vector).alias("_asked")), query_key)
        dot = F.aggregate(
            F.zip_with(self.vector, "_asked", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda a, x: a + x
        )
        score = F.round(dot / (norm(F.col(self.vector)) * norm(F.col("_asked"))), SCORE_DIGITS)
        ranked = top_k_per(both.select(query_key, self.item_key, score.alias("score")), [query_key], k, [F.desc("score"), F.asc(self.item_key)])
        return ranked, asked.groupBy(query_key).agg(F.sum("_size").alias("met"))


def _tag(within: Sequence[str]) -> Column:
    return F.to_json(F.struct(*within)) if within else F.lit("")


def _scan(shared, wanted: int, schema: T.StructType):
    """Task over rows sorted by part, its items first: the ``wanted`` best codes per query and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: tuple | None = None
        keys: list[pa.Array] = []
        scales: list[np.ndarray] = []
        codes: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, part, role = (batch.column(i).to_numpy() for i in (1, 2, 3))
            tag = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((cell[1:] != cell[:-1]) | (part[1:] != part[:-1]) | (role[1:] != role[:-1]) | (tag[1:] != tag[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(cell)], strict=True):
                if (tag[a], cell[a], part[a]) != here:
                    here, keys, scales, codes = (tag[a], cell[a], part[a]), [], [], []
                rows = batch.slice(a, b - a)
                if role[a] == 0:
                    keys.append(rows.column(4))
                    scales.append(rows.column(5).to_numpy())
                    codes.append(np.frombuffer(b"".join(rows.column(6).to_pylist()), dtype=np.int8).reshape(len(rows), -1))
                    continue
                item, scale, code = pa.concat_arrays(keys), np.concatenate(scales), np.concatenate(codes).astype(np.float32)
                keys, scales, codes = [item], [scale], [code.astype(np.int8)]
                # the queries of a part are as many as there are, so they are scored in slices
                by_item, n = code.T, min(wanted, len(item))
                for first, length in _slices(len(rows), len(item)):
                    some = rows.slice(first, length)
                    asked = some.column(8).flatten().to_numpy().reshape(length, -1)
                    about = (asked @ shared.value[cell[a]])[:, None] + (asked.astype(np.float32) @ by_item) * scale
                    top = np.argpartition(-about, n - 1, axis=1)[:, :n]
                    yield pa.RecordBatch.from_arrays(
                        [some.column(7).take(pa.array(np.repeat(np.arange(length), n))), item.take(pa.array(top.ravel())),
                         pa.array(np.take_along_axis(about, top, axis=1).ravel().astype(np.float64))],
                        names=schema.names,
                    )

    return run
