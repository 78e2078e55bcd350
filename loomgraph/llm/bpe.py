"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut first: a position where a white-space character follows
another character is a boundary of the pre-split pattern whatever surrounds it,
as no alternative of the pattern holds white space after something else.  Texts
above ``cut_chars`` are cut at such positions and encoded piece by piece, which
gives the same ids and keeps the library's regex away from huge inputs.  A piece
that stays long (one run without such a position) is split by the pattern in
Python, and every match is encoded by itself.

Decoding joins the raw bytes of the ids, so it returns the exact UTF-8 input.

Defined cases: null is the empty text with no ids; rows are independent, so
repeated doc_ids and ties do not matter; input columns with the names of result
columns are replaced; ids unknown to the rank file raise.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.tables import sent_once, tidy

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
CUT_CHARS = 50_000
ROWS_OUT = 512
_BOUNDARY = regex.compile(r"(?<=\S)\s")
_MATCH = regex.compile(public_tokenizers.PATTERN)


@functools.lru_cache(maxsize=4)
def encoding(path: str = RANKS) -> tiktoken.Encoding:
    """One encoding per worker process and rank file."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, cut_chars: int = CUT_CHARS) -> Iterator[str]:
    """``text`` cut at safe boundaries into pieces of about ``cut_chars``."""
    start = 0
    while len(text) - start > cut_chars:
        cut = _BOUNDARY.search(text, start + cut_chars)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(enc: tiktoken.Encoding, text: str, cut_chars: int = CUT_CHARS) -> list[int]:
    if len(text) <= cut_chars:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for piece in pieces(text, cut_chars):
        if len(piece) <= 2 * cut_chars:
            ids.extend(enc.encode_ordinary(piece))
        else:
            for match in _MATCH.finditer(piece):
                ids.extend(enc._encode_single_piece(match.group()))
    return ids


def _plan(df: DataFrame, keep: list[str] | None, made: str, column: str, kind: T.DataType):
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() != made.lower()]
    source = df.select(*keep, F.col(column).alias("_taken"))
    return keep, source, T.StructType([source.schema[c] for c in keep] + [T.StructField(made, kind)])


def encode(
    df: DataFrame, text: str = "text", out: str = "ids", keep: list[str] | None = None,
    ranks: str = RANKS, cut_chars: int = CUT_CHARS,
) -> DataFrame:
    """Columns ``keep`` (all by default) plus the token ids of ``text``."""
    keep, source, schema = _plan(df, keep, out, text, T.ArrayType(T.IntegerType(), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks)
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS_OUT):
                batch = whole.slice(first, ROWS_OUT)
                coded = [encode_text(enc, t or "", cut_chars) for t in batch.column(len(keep)).to_pylist()]
                at = np.cumsum([0, *map(len, coded)], dtype=np.int32)
                flat = np.fromiter((i for ids in coded for i in ids), dtype=np.int32, count=at[-1])
                ids = pa.ListArray.from_arrays(pa.array(at), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], ids], names=schema.names)

    return source.mapInArrow(run, schema)


def decode(
    df: DataFrame, ids: str = "ids", out: str = "decoded", keep: list[str] | None = None, ranks: str = RANKS
) -> DataFrame:
    """Columns ``keep`` (all by default) plus the bytes that ``ids`` stand for."""
    keep, source, schema = _plan(df, keep, out, ids, T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks)
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS_OUT):
                batch = whole.slice(first, ROWS_OUT)
                coded = batch.column(len(keep))
                if pa.types.is_large_list(coded.type):
                    coded = coded.cast(pa.list_(coded.type.value_type))
                made = [enc.decode_bytes(x.values.to_pylist()) if x.is_valid else b"" for x in coded]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[: len(keep)], pa.array(made, type=pa.binary())], names=schema.names
                )

    return source.mapInArrow(run, schema)


def digests(docs: DataFrame) -> DataFrame:
    coded = encode(docs, keep=["doc_id"])
    back = decode(coded)
    return back.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def with_tokens(docs: DataFrame, ranks: str = RANKS, cut_chars: int = CUT_CHARS) -> DataFrame:
    """``docs`` with ``ids``, ``n_tokens`` and whether decoding gives the text back, in one pass."""
    made = [T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("n_tokens", T.LongType()), T.StructField("round_trip", T.BooleanType())]
    taken = {f.name for f in made}
    keep = [c for c in docs.columns if c.lower() not in taken]
    source, at = sent_once(docs, keep, "text", "_taken")
    schema = T.StructType([*(source.schema[c] for c in keep), *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks)
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS_OUT):
                batch = whole.slice(first, ROWS_OUT)
                texts = [t or "" for t in batch.column(at).to_pylist()]
                coded = [encode_text(enc, t, cut_chars) for t in texts]
                same = [enc.decode_bytes(ids) == t.encode() for ids, t in zip(coded, texts, strict=True)]
                columns = [pa.array(coded, pa.list_(pa.int32())), pa.array(list(map(len, coded)), pa.int64()), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], names=schema.names)

    return source.mapInArrow(tidy(run), schema)
