"""Text vectors, cosine search and reranking."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions.plan import bounded_rows, sized, spread
from loomgraph.functions.strings import keywords
from loomgraph.graph import union_all
from loomgraph.operators.ranking import top_k_per
from loomgraph.session import settle

DIMENSIONS = 64
QUERY_BLOCK = 4096
SCORE_DIGITS = 6
REMEMBERED_TOKENS = 200_000
TEXTS_AT_ONCE = 512
Embedder = Callable[[pd.Series], Sequence]


class _Buckets(dict):
    """Token -> bucket, the first 32 bits of its MD5; a bounded number is remembered."""

    def __init__(self, dimensions: int):
        super().__init__()
        self.dimensions = dimensions

    def __missing__(self, token: str) -> int:
        if len(self) >= REMEMBERED_TOKENS:
            self.clear()
        found = self[token] = int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % self.dimensions
        return found


def token_hasher(dimensions: int):
    """Arrow UDF: blank-separated tokens to unit-length vectors of hashed token counts.

    Buckets of words already seen are remembered within a task; the tokens of
    some hundred texts are counted together.
    """

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = _Buckets(dimensions)
        for batch in batches:
            vectors = np.zeros((len(batch), dimensions))
            for first in range(0, len(batch), TEXTS_AT_ONCE):
                rows = [tokens.split() if tokens else [] for tokens in batch.slice(first, TEXTS_AT_ONCE).to_pylist()]
                sizes = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
                buckets = np.fromiter(map(known.__getitem__, chain.from_iterable(rows)), dtype=np.int64, count=sizes.sum())
                at = np.repeat(np.arange(len(rows)) * dimensions, sizes) + buckets
                counts = np.bincount(at, minlength=len(rows) * dimensions).reshape(len(rows), dimensions)
                lengths = np.sqrt((counts * counts).sum(axis=1))
                vectors[first : first + len(rows)] = counts / np.where(lengths > 0, lengths, 1.0)[:, None]
            ends = np.arange(0, vectors.size + 1, dimensions, dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(vectors.ravel()))

    # a repeated evaluation costs more than any rewrite could win
    return hashed.asNondeterministic()


def hashed_vectors(df: DataFrame, keys: Sequence[str], text: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """Adds ``embedding``: unit-length hashed token counts; texts without tokens get zeros.

    Stands in for a model.  Every row is embedded where it is; nothing is
    shuffled.
    """
    tokens = F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\p{M}\p{Nd}_]+", " ")
    return spread(df, *keys).withColumn("embedding", token_hasher(dimensions)(tokens))


def embed_with(df: DataFrame, text: str, embedder: Embedder) -> DataFrame:
    """Adds ``embedding`` and ``embedding_error`` from a user's function over batches of whole texts.

    A limit on the input belongs to the embedder.  If a batch fails, its rows
    are tried one by one; a row that fails has no vector, which search leaves
    out, and the reason in ``embedding_error``.
    """
    schema = T.StructType(
        [
            *df.schema.fields,
            T.StructField("embedding", T.ArrayType(T.DoubleType())),
            T.StructField("embedding_error", T.StringType()),
        ]
    )

    def one(texts: pd.Series) -> tuple[list | None, str | None]:
        try:
            return list(map(float, embedder(texts)[0])), None
        except Exception as exc:  # noqa: BLE001 - the user's function may raise anything
            return None, f"{type(exc).__name__}: {exc}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch[text].fillna("")
            try:
                vectors = [list(map(float, v)) for v in embedder(texts)]
                if len(vectors) != len(batch):
                    raise ValueError(f"{len(vectors)} vectors for {len(batch)} texts")
                errors = [None] * len(batch)
            except Exception:  # noqa: BLE001
                vectors, errors = zip(*(one(texts.iloc[i : i + 1]) for i in range(len(batch))), strict=True)
            yield batch.assign(embedding=list(vectors), embedding_error=list(errors))

    return df.mapInPandas(run, schema)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def nonzero(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows with a usable vector: not null and not all zeros."""
    return df.where(F.col(vector).isNotNull() & (norm(F.col(vector)) > 0))


def searchable(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with a usable vector whose document, of the same tenant, is there and ready."""
    ready = documents.where("status = 'ready'").select("doc_id", "tenant_id")
    return nonzero(chunks).join(sized(ready), ["doc_id", "tenant_id"], "left_semi")


def cosine_topk(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    query_key: str = "query_id",
    item_key: str = "item_id",
    vector: str = "embedding",
    within: Sequence[str] = (),
) -> DataFrame:
    """Exact top-k by cosine: (query key, item key, score, rank).

    Queries travel to the data in blocks of bounded size; each task multiplies
    its Arrow batches with the block and keeps a running top k per query, so
    only k rows per query and task are shuffled.  More queries than one block
    mean more passes over the items, one broadcast block each.  ``within``
    names columns of both sides that must agree (a tenant).  Scores are rounded
    before ranking, ties go to the smaller item key.
    """
    tag = F.to_json(F.struct(*within)) if within else F.lit("")
    usable = nonzero(queries, vector).select(query_key, vector, tag.alias("_tag"))
    items = corpus.where(F.col(vector).isNotNull()).select(item_key, vector, tag.alias("_tag"))
    blocks = _query_blocks(usable, query_key, vector)
    parts = [_block_topk(block, items, k, usable.schema[query_key], item_key, vector) for block in blocks]
    if not parts:
        empty = corpus.select(item_key).limit(0).withColumn("score", F.lit(0.0))
        best = empty.withColumn(query_key, F.lit(None).cast(usable.schema[query_key].dataType))
    else:
        best = union_all(parts)
    ranked = top_k_per(best, [query_key], k, [F.desc("score"), F.asc(item_key)])
    return ranked.select(query_key, item_key, "score", "rank")


def _query_blocks(usable: DataFrame, key: str, vector: str) -> Iterator[tuple[list, list, np.ndarray]]:
    """Query ids, tags and unit vectors in blocks of at most ``QUERY_BLOCK`` rows.

    A query set that fits one block is read at once.  A larger one is stored
    as a table split into blocks, read one after the other.
    """

    def pull(rows: list) -> tuple[list, list, np.ndarray]:
        matrix = np.array([r[vector] for r in rows], dtype=np.float64)
        return [r[key] for r in rows], [r["_tag"] for r in rows], matrix / np.linalg.norm(matrix, axis=1, keepdims=True)

    rows = bounded_rows(usable, QUERY_BLOCK)
    if rows is not None:
        if rows:
            yield pull(rows)
        return
    total = usable.count()
    n = -(-total // (QUERY_BLOCK // 2))
    split = settle(usable.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")), "_b")
    for b in range(n):
        block = bounded_rows(split.where(F.col("_b") == b), QUERY_BLOCK)
        if block is None:
            raise RuntimeError("query keys must be distinct")
        if block:
            yield pull(block)


SLICE = 1024
HELD = 500_000


def _block_topk(block: tuple, items: DataFrame, k: int, key_field: T.StructField, item_key: str, vector: str) -> DataFrame:
    """Best k per query of the block within every task."""
    shared = items.sparkSession.sparkContext.broadcast(block)
    schema = T.StructType(
        [T.StructField(key_field.name, key_field.dataType), items.schema[item_key], T.StructField("score", T.DoubleType())]
    )

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, tags, unit = shared.value
        tags = np.array(tags, dtype=object)
        one_tag = len(set(tags)) == 1
        # the k-th best score of each query so far: whatever lies below cannot enter
        floor = np.full(len(names), -np.inf)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def best() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Query number, score and key of the k best of each query, ties by key."""
            q, s, key = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((np.unique(key, return_inverse=True)[1], -s, q))
            q, s, key = q[order], s[order], key[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            np.maximum.at(floor, q[place == k - 1], s[place == k - 1])
            return q[place < k], s[place < k], key[place < k]

        for batch in batches:
            for first in range(0, len(batch), SLICE):
                part = batch.iloc[first : first + SLICE]
                matrix = np.array(part[vector].tolist(), dtype=np.float64)
                lengths = np.linalg.norm(matrix, axis=1)
                alive = lengths > 0
                if not alive.any():
                    continue
                keys = part[item_key].to_numpy()[alive].astype(object)
                scores = np.round(unit @ (matrix[alive] / lengths[alive, None]).T, SCORE_DIGITS)
                own = part["_tag"].to_numpy()[alive]
                if not one_tag or (own != tags[0]).any():
                    scores[tags[:, None] != own[None, :]] = -np.inf
                if len(keys) >= k:
                    floor = np.maximum(floor, np.partition(scores, len(keys) - k, axis=1)[:, len(keys) - k])
                q, i = np.nonzero((scores >= floor[:, None]) & (scores > -np.inf))
                held.append((q, scores[q, i], keys[i]))
                size += len(q)
                if size > HELD:
                    held = [best()]
                    size = len(held[0][0])
        if size:
            q, s, key = best()
            yield pd.DataFrame({key_field.name: [names[x] for x in q], item_key: list(key), "score": s})

    return items.mapInPandas(search, schema)


def above(ranked: DataFrame, minimum: float = 0.3, score: str = "score") -> DataFrame:
    """Threshold after the limit: fewer than k rows may remain."""
    return ranked.where(F.col(score) >= minimum)


# ---- approximate search ------------------------------------------------------------


def _signer(dimensions: int, tables: int, bits: int, flips: int, seed: int):
    """Arrow UDF: the cells of a vector, table and sides of the table's planes in one long.

    With ``flips`` also the neighbouring cells across the planes the vector lies
    closest to, one or two at a time.
    """

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        planes = np.random.default_rng(seed).standard_normal((tables * bits, dimensions))
        power = 1 << np.arange(bits, dtype=np.int64)
        base = np.arange(tables, dtype=np.int64) << bits
        for batch in batches:
            if not len(batch):
                yield pd.Series([], dtype=object)
                continue
            margin = (np.array(batch.tolist(), dtype=np.float64) @ planes.T).reshape(len(batch), tables, bits)
            cells = [base + ((margin >= 0) @ power)]
            near = power[np.argsort(np.abs(margin), axis=2)[:, :, :flips]]
            for a in range(near.shape[2]):
                cells.append(cells[0] ^ near[:, :, a])
                cells += [cells[0] ^ near[:, :, a] ^ near[:, :, b] for b in range(a)]
            yield pd.Series(list(np.concatenate(cells, axis=1)))

    return sign


def approx_topk(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    dimensions: int,
    tables: int = 16,
    bits: int = 8,
    flips: int = 4,
    query_key: str = "query_id",
    item_key: str = "item_id",
    vector: str = "embedding",
    seed: int = 42,
) -> DataFrame:
    """Approximate top-k: only items in a cell that the query probes are scored, by equi-joins.

    Every item lies in one cell of each table; the narrow index (cell, item key)
    is stored once.  Queries probe their own and neighbouring cells.  Pairs that
    meet are made distinct, then joined with both vectors and scored exactly;
    crowded cells are left to AQE's skew handling.  Keys must be distinct.
    """
    items = nonzero(corpus, vector).select(item_key, vector)
    asked = nonzero(queries, vector).select(query_key, vector)
    index = settle(items.select(item_key, F.explode(_signer(dimensions, tables, bits, 0, seed)(vector)).alias("_cell")))
    probes = asked.select(query_key, F.explode(_signer(dimensions, tables, bits, flips, seed)(vector)).alias("_cell"))
    met = probes.join(index, "_cell").select(query_key, item_key).distinct()
    both = met.join(items, item_key).join(asked.withColumnRenamed(vector, "_asked"), query_key)
    dot = F.aggregate(
        F.zip_with(vector, "_asked", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda a, x: a + x
    )
    scored = both.select(
        query_key, item_key, F.round(dot / (norm(F.col(vector)) * norm(F.col("_asked"))), SCORE_DIGITS).alias("score")
    )
    return top_k_per(scored, [query_key], k, [F.desc("score"), F.asc(item_key)])


def recall(approx: DataFrame, exact: DataFrame, query_key: str = "query_id", item_key: str = "item_id") -> DataFrame:
    """Share of the exact result that the approximate one found."""
    flags = exact.select(query_key, item_key).join(
        approx.select(query_key, item_key, F.lit(1).alias("_hit")), [query_key, item_key], "left"
    )
    return flags.agg((F.count("_hit") / F.count(F.lit(1))).alias("recall"), F.count(F.lit(1)).alias("exact_rows"))


# ---- reranking ----------------------------------------------------------------------


def keyword_rerank(hits: DataFrame, question: str = "question", text: str = "text", score: str = "score") -> DataFrame:
    """Adds ``rerank_score``: 70 % vector score, 30 % share of question words in the text.

    A word counts when it occurs anywhere in the text, also inside a longer
    word.  Questions without usable words keep the vector score.
    """
    words, low = keywords(F.col(question)), F.lower(F.col(text))
    found = F.size(F.filter(words, lambda t: low.contains(t)))
    blended = F.round(F.col(score) * 0.7 + found / F.size(words) * 0.3, 4)
    return hits.withColumn("rerank_score", F.when(F.size(words) == 0, F.col(score)).otherwise(blended))


def blend_scores(
    hits: DataFrame, scores: DataFrame, keys: Sequence[str], group: str, order: Sequence[Column], first: int | None = None
) -> DataFrame:
    """Average the rerank score with an external 0..10 rating, where a rating exists.

    With ``first`` only that many first rows of a question are blended.  ``scores`` has the keys and ``rating``.
    """
    head = hits if first is None else top_k_per(hits, [group], first, order, "_r")
    head = head.select(*keys, F.lit(True).alias("_head"))
    rated = hits.join(head, list(keys), "left").join(scores.select(*keys, "rating"), list(keys), "left")
    # in whole ten-thousandths: halves are common here and must round alike everywhere
    blended = F.round((F.round(F.col("rerank_score") * 10_000) + F.round(F.col("rating") * 1_000)) / 2) / 10_000
    return rated.withColumn(
        "rerank_score", F.when(F.col("_head") & F.col("rating").isNotNull(), blended).otherwise(F.col("rerank_score"))
    ).drop("_head", "rating")


def rerank_cut(hits: DataFrame, group: str, item_key: str, k: int = 5) -> DataFrame:
    return top_k_per(hits, [group], k, [F.desc("rerank_score"), F.asc(item_key)], "position")
