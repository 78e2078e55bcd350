"""Token counts by rank-synchronous merging of ragged arrays.

The pre-tokens of a batch are held as one flat array of symbols with row
offsets.  In every step each row looks up the ranks of its neighbouring pairs,
takes its lowest rank and merges all pairs of that rank at once, left to right;
rows without a mergeable pair leave.  A merge of this vocabulary's rule list
comes after the merges that make its parts, so applying all pairs of the lowest
rank at once equals the usual one-at-a-time order.  The surviving symbols of a
row are its tokens.

Counts of pre-tokens are kept per worker in a table that is emptied when it
holds ``CACHED`` entries; it saves work and never changes a count.  Texts are
taken in groups, so memory does not follow the batch size.

Special strings are handled as the library does by default: each occurrence of
an added special token in a text is one token.

Defined cases: null is the empty text with no tokens; rows are independent;
input columns with the names of result columns are replaced.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL = public_tokenizers.path("byte_bpe_50k.json")
CACHED = 500_000
GROUP_CHARS = 1 << 20
LIMIT = 512
_MATCH = regex.compile(public_tokenizers.PATTERN)


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            letters[b] = chr(b)
        else:
            letters[b], extra = chr(extra), extra + 1
    return letters


class MergeTable:
    """Rank and product of every mergeable pair, in arrays sorted by pair."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = [p if isinstance(p, list) else p.split(" ") for p in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.width = max(vocab.values()) + 1
        keys = left * self.width + right
        order = np.argsort(keys)
        self.keys, self.rank, self.made = keys[order], order, made[order]
        self.byte_symbol = np.array([vocab[c] for c in _byte_letters()], dtype=np.int64)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.none = len(keys)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank[at], self.none), at

    def count(self, pretokens: list[bytes]) -> np.ndarray:
        """Symbols that survive in each pre-token."""
        length = np.array([len(p) for p in pretokens], dtype=np.int64)
        counts = length.copy()
        symbols = self.byte_symbol[np.frombuffer(b"".join(pretokens), dtype=np.uint8)]
        row = np.repeat(np.arange(len(pretokens)), length)
        while symbols.size:
            rank, at = self.ranks(symbols[:-1], symbols[1:])
            rank = np.append(np.where(row[:-1] == row[1:], rank, self.none), self.none)
            at = np.append(at, 0)
            begin = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            size = np.diff(np.append(begin, len(row)))
            lowest = np.repeat(np.minimum.reduceat(rank, begin), size)
            live = lowest < self.none
            merge = live & (rank == lowest)
            # in a run of equal symbols every second pair merges, counted from the run's start
            index = np.arange(len(merge))
            run = np.maximum.accumulate(np.where(merge & ~np.append(False, merge[:-1]), index, -1))
            merge &= (index - run) % 2 == 0
            symbols = np.where(merge, self.made[at], symbols)
            stay = live & ~np.append(False, merge[:-1])
            np.subtract.at(counts, row[merge], 1)
            symbols, row = symbols[stay], row[stay]
        return counts


@functools.lru_cache(maxsize=4)
def merge_table(path: str = MODEL) -> MergeTable:
    return MergeTable(path)


def count_texts(texts: list[str], table: MergeTable, known: dict[str, int]) -> list[int]:
    """Tokens of each text; ``known`` holds counts of pre-tokens seen before."""
    totals = []
    held: list[tuple[int, list[list[str]]]] = []
    chars = 0

    def flush() -> None:
        nonlocal chars
        new = list({t for _, parts in held for part in parts for t in part}.difference(known))
        if len(known) + len(new) > CACHED:
            known.clear()
            new = list({t for _, parts in held for part in parts for t in part})
        for first in range(0, len(new), 50_000):
            some = new[first : first + 50_000]
            known.update(zip(some, table.count([t.encode() for t in some]).tolist(), strict=True))
        for special, parts in held:
            totals.append(special + sum(sum(map(known.__getitem__, part)) for part in parts))
        held.clear()
        chars = 0

    for text in texts:
        parts = table.special.split(text) if table.special else [text]
        held.append((len(parts) - 1, [_MATCH.findall(p) for p in parts]))
        chars += len(text)
        if chars >= GROUP_CHARS:
            flush()
    flush()
    return totals


def count(
    docs: DataFrame, text: str = "text", keep: list[str] | None = None, model: str = MODEL, limit: int = LIMIT
) -> DataFrame:
    """Columns ``keep`` (all by default) plus n_bytes, n_tokens and over_limit."""
    made = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    taken = {"n_bytes", "n_tokens", "over_limit"}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in taken]
    source = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_counted"))
    schema = T.StructType([source.schema[c] for c in keep] + made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = merge_table(model), {}
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            sizes = pa.array([len(t.encode()) for t in texts], type=pa.int64())
            counts = pa.array(count_texts(texts, table, known), type=pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], sizes, counts], names=schema.names)

    return source.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
