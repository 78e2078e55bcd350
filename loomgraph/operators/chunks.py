"""Splitting documents into overlapping chunks.

Fixed windows are pure column expressions.  Sentence and recursive chunks pack
parts greedily, which no column expression does in linear time; they run as a
small per-text helper inside ``mapInPandas``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions.plan import running_total, spread
from loomgraph.functions.text import has_text, strip_column
from loomgraph.session import tidy

# Sentence ends (with a space, or a line break) and paragraph breaks.
SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|(?<=\n)\s*")
PARAGRAPH = re.compile(r"\n\s*\n")
GLUE = "\n\n"
STRATEGIES = ("fixed", "sentence", "recursive")
BLOCK_WINDOWS = 32
PIECE_CHARS = 4_000_000


def _check(size: int, overlap: int, strategy: str = "fixed") -> None:
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("need size > 0 and 0 <= overlap < size")
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")


def fixed_windows(text: Column, size: int, overlap: int) -> Column:
    """Array of (chunk_index, char_start, char_end, text) windows."""
    _check(size, overlap)
    stride, length = size - overlap, F.length(text)
    last = F.when(length <= size, 0).otherwise(F.ceil((length - size) / stride)).cast("int")
    cut = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct(i.alias("i"), F.substring(text, i * stride + 1, F.lit(size)).alias("text")),
    )
    # a window's end follows from its own length: that of the whole text would be counted for every window
    return F.transform(
        cut,
        lambda w: F.struct(
            w["i"].alias("chunk_index"),
            (w["i"] * stride).alias("char_start"),
            (w["i"] * stride + F.length(w["text"])).alias("char_end"),
            w["text"].alias("text"),
        ),
    )


def fixed_chunks(df: DataFrame, text: str = "text", size: int = 1000, overlap: int = 200) -> DataFrame:
    """One row per non-blank window; the index counts blank windows too."""
    _check(size, overlap)
    keep = [c for c in df.columns if c != text]
    # the same length of text whatever the strategy: blank texts have no chunks
    filled = spread(df, *keep).where(has_text(F.col(text)))
    # a window is found by counting characters from the start: long texts are first cut into blocks of whole windows
    span = BLOCK_WINDOWS * (size - overlap)
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor(F.greatest(F.length(text) - overlap - 1, F.lit(0)) / span).cast("int")),
        lambda b: F.struct(b.alias("b"), F.substring(text, b * span + 1, F.lit(span + overlap)).alias("body")),
    )
    cut = filled.select(*keep, F.explode(blocks).alias("_x"))
    rows = cut.select(*keep, "_x.b", F.explode(fixed_windows(F.col("_x.body"), size, overlap)).alias("w"))
    return _finish(
        rows.select(
            *keep,
            (F.col("b") * BLOCK_WINDOWS + F.col("w.chunk_index")).alias("chunk_index"),
            (F.col("b") * span + F.col("w.char_start")).alias("char_start"),
            (F.col("b") * span + F.col("w.char_end")).alias("char_end"),
            F.col("w.text").alias("text"),
        )
    )


def _finish(rows: DataFrame) -> DataFrame:
    trimmed = rows.where(has_text(F.col("text"))).withColumn("text", strip_column("text"))
    return trimmed.withColumn("char_count", F.length("text"))


def pack(text: str, parts: Sequence[str], size: int, overlap: int) -> Iterator[tuple[str, int]]:
    """Greedy packing of consecutive parts: (joined text, start offset).

    A chunk is a span ``parts[lo:hi]``.  It closes before the part that would
    make it longer than ``size``; the next one begins with the trailing parts
    of the closed one that together fit into ``overlap``.
    """
    lo, filled, cursor, start = 0, 0, 0, 0
    for hi, part in enumerate(parts):
        at = text.find(part, cursor)
        at = cursor if at < 0 else at
        if hi > lo and filled + len(part) > size:
            yield GLUE.join(parts[lo:hi]), start
            first, filled = hi, 0
            while first > lo and filled + len(parts[first - 1]) <= overlap:
                first -= 1
                filled += len(parts[first])
            lo = first
            if lo < hi:
                back = text.find(parts[lo], start)
                start = back if back >= 0 else at
        if hi == lo:
            start = at
        filled += len(part)
        cursor = at + len(part)
    if lo < len(parts):
        yield GLUE.join(parts[lo:]), start


def split_text(text: str, strategy: str, size: int, overlap: int) -> list[tuple[int, int, int, str]]:
    """(index, start, end, stripped text) of the non-blank chunks of one text."""
    if not text or not text.strip():
        return []
    if strategy == "recursive" and len(text) <= size:
        spans = [(text, 0)]
    else:
        parts = PARAGRAPH.split(text) if strategy == "recursive" else []
        if len(parts) < 2 and strategy != "fixed":
            parts = SENTENCE.split(text)
        if strategy == "fixed" or (strategy == "recursive" and len(parts) < 2):
            stop = max(len(text) - overlap, 1)
            spans = [(text[i : i + size], i) for i in range(0, stop, size - overlap)]
        else:
            spans = list(pack(text, parts, size, overlap))
    return [(i, at, at + len(s), s.strip()) for i, (s, at) in enumerate(spans) if s.strip()]


def chunk_schema(kept: Sequence[T.StructField]) -> T.StructType:
    return T.StructType(
        [
            *kept,
            T.StructField("chunk_index", T.IntegerType()),
            T.StructField("char_start", T.IntegerType()),
            T.StructField("char_end", T.IntegerType()),
            T.StructField("text", T.StringType()),
            T.StructField("char_count", T.IntegerType()),
        ]
    )


def chunk_documents(
    df: DataFrame, text: str = "text", strategy: str = "recursive", size: int = 1000, overlap: int = 200
) -> DataFrame:
    """One row per chunk: the other columns, chunk_index, char_start, char_end, text, char_count.

    Offsets refer to the text as re-joined, before trimming, so
    ``char_end - char_start`` may exceed ``char_count``.
    """
    _check(size, overlap, strategy)
    if strategy == "fixed":
        return fixed_chunks(df, text, size, overlap)
    df = spread(df, *[c for c in df.columns if c != text])
    keep = [c for c in df.columns if c != text]
    schema = chunk_schema([df.schema[c] for c in keep])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # texts become Python strings one by one, chunks leave in pieces of bounded size
            at, columns, chars = [], [[] for _ in range(5)], 0
            for row, body in enumerate(batch.column(len(keep))):
                for found in split_text(body.as_py(), strategy, size, overlap):
                    at.append(row)
                    for column, value in zip(columns, (*found, len(found[3])), strict=True):
                        column.append(value)
                    chars += len(found[3])
                    if chars >= PIECE_CHARS:
                        yield _piece(batch, at, columns, len(keep))
                        at, columns, chars = [], [[] for _ in range(5)], 0
            if at:
                yield _piece(batch, at, columns, len(keep))

    return df.select(*keep, text).mapInArrow(tidy(split), schema)


def _piece(batch: pa.RecordBatch, at: list[int], columns: list[list], kept: int) -> pa.RecordBatch:
    """Chunks as a batch: the kept columns of the rows they come from, and their own."""
    own = [pa.array(c, pa.string() if i == 3 else pa.int32()) for i, c in enumerate(columns)]
    rows = pa.array(at, pa.int32())
    names = [*batch.schema.names[:kept], "chunk_index", "char_start", "char_end", "text", "char_count"]
    return pa.RecordBatch.from_arrays([*[batch.column(i).take(rows) for i in range(kept)], *own], names=names)


def chunk_pages(
    pages: DataFrame,
    key: str = "doc_id",
    page: str = "page_num",
    text: str = "text",
    strategy: str = "recursive",
    size: int = 1000,
    overlap: int = 200,
) -> DataFrame:
    """Chunks page by page with a document-wide index and offset.

    Blank pages yield no chunk but still take up room.  Indices and offsets of
    earlier pages are running sums over (document, page), split so that a
    document of any number of pages is spread over tasks.
    """
    rows = pages.select(key, page, text)
    pieces = chunk_documents(rows, text, strategy, size, overlap)
    # position among the kept chunks of the page: indices may skip blank ones
    kept = pieces.groupBy(key, page).agg(F.count(F.lit(1)).alias("_n"))
    lengths = rows.select(key, page, (F.length(text) + 2).cast("long").alias("_len"))
    sized = lengths.join(kept, [key, page], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    shifted = running_total(sized, [key], page, F.col("_len"), "_offset")
    shifted = running_total(shifted, [key], page, F.col("_n"), "_before").select(key, page, "_offset", "_before")
    placed = running_total(pieces, [key, page], "chunk_index", F.lit(1), "_pos")
    return placed.join(shifted, [key, page]).select(
        key,
        page,
        (F.col("_before") + F.col("_pos")).alias("chunk_index"),
        (F.col("char_start") + F.col("_offset")).alias("char_start"),
        (F.col("char_end") + F.col("_offset")).alias("char_end"),
        text,
        "char_count",
    )


@F.udtf(returnType="chunk_index int, char_start int, char_end int, text string, char_count int")
class ChunkText:
    """``chunk_text(text, strategy, size, overlap)`` for SQL users."""

    def eval(self, text: str, strategy: str = "recursive", size: int = 1000, overlap: int = 200):
        _check(size, overlap, strategy)
        for i, start, end, piece in split_text(text, strategy, size, overlap):
            yield i, start, end, piece, len(piece)


def register_chunker(spark, name: str = "chunk_text") -> None:
    spark.udtf.register(name, ChunkText)
