"""Benchmark passages in documents, by Wu-Manber search over words.

Patterns are the runs of ``size`` consecutive words of the benchmark items (a
shorter item is one pattern).  Patterns of one length m form a class with its
own tables:

* a shift table over blocks of up to three words: how far a window end may jump
  without missing a pattern.  Blocks are hashed into the table, and a cell keeps
  the smallest shift of the blocks that fall into it;
* where the shift is zero, suffix-hash buckets: the patterns that end in that
  block, sorted by the hash of the block and of the whole pattern;
* direct comparison of the words' bytes with the pattern confirms an occurrence.

A block that occurs in no pattern moves the window by m - 2 words, and only the
words of inspected blocks are hashed.  Texts are cut into segments whose window
ends are moved side by side, so numpy advances thousands of cursors per step;
the segments overlap by a window, so nothing is missed at their borders.

The benchmark is the stated query set: it is read in blocks of at most
``max_patterns`` patterns, each block is broadcast by itself (its bound is that
parameter), and every document meets every block.  A task holds one block at a
time.  Documents are never shuffled.

Defined cases: null and blank texts have no words and no hits; an item without
words is ignored; items that share a window are all reported; the windows of an
item without item_id hit words, but add nothing to ``items``; rows that repeat a
doc_id are judged row by row; very long texts are scanned whole, in segments; an
empty benchmark gives no hits; item_id may have any type that sorts.  Input
columns with the names of result columns are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from loomgraph.llm import textbytes as tb
from loomgraph.llm.tables import sent_once, tidy

SIZE = 10
MAX_PATTERNS = 500_000
SEGMENT = 256
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_HIT = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_RESULT = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hits", T.ArrayType(_HIT)),
]


@dataclass
class PatternClass:
    """Tables for patterns of one length, in words."""

    length: int
    block: int
    shift: np.ndarray  # by the low bits of a block's hash
    whole: np.ndarray  # sorted hashes of whole patterns
    bytes_at: np.ndarray  # where each pattern's bytes lie in ``text``
    text: bytes
    items_at: np.ndarray
    items: list


def _hashes(words: list[bytes]) -> np.ndarray:
    joined = b" ".join(words)
    low = tb.lowered(np.frombuffer(joined, dtype=np.uint8))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    return tb.hash_words(low, ends - [len(w) for w in words], ends)


def build_class(length: int, patterns: dict[bytes, set[int]]) -> PatternClass:
    """``patterns``: words joined by one blank -> items."""
    block = min(3, length)
    keys = list(patterns)
    flat = [w for k in keys for w in k.split(b" ")]
    word_hash = _hashes(flat).reshape(len(keys), length)
    whole = np.array([tb.hash_windows(row, length)[0] for row in word_hash], dtype=np.uint64)
    blocks = np.stack([tb.hash_windows(row, block) for row in word_hash])
    bits = max(12, min(24, int(blocks.size * 16).bit_length()))
    shift = np.full(1 << bits, length - block + 1, dtype=np.min_scalar_type(length))
    cells = (blocks & np.uint64((1 << bits) - 1)).astype(np.int64)
    for j in range(blocks.shape[1]):
        np.minimum.at(shift, cells[:, j], length - block - j)
    order = np.argsort(whole, kind="stable")
    ordered = [keys[i] for i in order]
    items = [sorted(patterns[k]) for k in ordered]
    return PatternClass(
        length, block, shift, whole[order],
        np.cumsum([0, *map(len, ordered)]), b"".join(ordered),
        np.cumsum([0, *map(len, items)]), [i for x in items for i in x],
    )


def patterns_of(text: str, size: int) -> list[tuple[int, bytes]]:
    words = _WORD.findall(text.encode().lower())
    if not words:
        return []
    n = min(size, len(words))
    return [(n, b" ".join(words[i : i + n])) for i in range(len(words) - n + 1)]


def pattern_blocks(rows: Iterator[tuple[object, str | None]], size: int, max_patterns: int) -> Iterator[list[PatternClass]]:
    """Tables for blocks of at most about ``max_patterns`` patterns (an item is never split)."""
    held: dict[int, dict[bytes, set[int]]] = {}
    count = 0
    for item, text in rows:
        if text is None:
            continue
        found = patterns_of(text, size)
        if count and count + len(found) > max_patterns:
            yield [build_class(n, p) for n, p in sorted(held.items())]
            held, count = {}, 0
        for n, key in found:
            own = held.setdefault(n, {}).setdefault(key, set())
            if item is not None:
                own.add(item)
        count += len(found)
    if held:
        yield [build_class(n, p) for n, p in sorted(held.items())]


def search(cls: PatternClass, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray):
    """Occurrences (first word, pattern number) in the texts whose words are ``starts``/``ends``."""
    m, b = cls.length, cls.block
    lead = first[:-1] + m - 1  # the first window end of each text
    stop = first[1:]
    per_text = np.maximum(-(-(stop - lead) // SEGMENT), 0)
    text = np.repeat(np.arange(len(per_text)), per_text)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    at = lead[text] + nth * SEGMENT
    until = np.minimum(at + SEGMENT, stop[text])
    mask = np.uint64(len(cls.shift) - 1)
    found = []
    while at.size:
        words = (at[:, None] + np.arange(1 - b, 1)).ravel()
        h = tb.hash_words(low, starts[words], ends[words]).reshape(-1, b)
        joint = h[:, 0].copy()
        for k in range(1, b):
            joint = joint * tb._STEP + h[:, k]
        step = cls.shift[(tb.mix(joint + np.uint64(b)) & mask).astype(np.int64)]
        if (step == 0).any():
            found.append(at[step == 0])
        at = at + np.maximum(step, 1)
        going = at < until
        at, until = at[going], until[going]
    if not found:
        return []
    at = np.concatenate(found)
    words = (at[:, None] + np.arange(1 - m, 1)).ravel()
    h = tb.hash_words(low, starts[words], ends[words]).reshape(-1, m)
    joint = h[:, 0].copy()
    for k in range(1, m):
        joint = joint * tb._STEP + h[:, k]
    joint = tb.mix(joint + np.uint64(m))
    left, right = np.searchsorted(cls.whole, joint, "left"), np.searchsorted(cls.whole, joint, "right")
    out = []
    for i in np.flatnonzero(right > left):
        f = int(at[i]) - m + 1
        here = b" ".join(low[starts[w] : ends[w]].tobytes() for w in range(f, f + m))
        for p in range(left[i], right[i]):
            if cls.text[cls.bytes_at[p] : cls.bytes_at[p + 1]] == here:
                out.append((f, p))
    return out


def _scan(blocks, column: pa.Array):
    """n_words, hits and items for each text of an Arrow column."""
    counts = np.zeros(len(column), dtype=np.int64)
    spans: dict[int, list[tuple[int, int]]] = {}
    items: dict[int, set[int]] = {}
    for block in blocks:
        classes = block.value
        for row, end, data, offsets in tb.text_groups(column):
            low = tb.lowered(data)
            starts, ends, first = tb.words(low, offsets, tb.ALNUM)
            counts[row:end] = np.diff(first)
            for cls in classes:
                for f, p in search(cls, low, starts, ends, first):
                    t = int(np.searchsorted(first, f, "right")) - 1
                    spans.setdefault(row + t, []).append((f - int(first[t]), f - int(first[t]) + cls.length))
                    items.setdefault(row + t, set()).update(cls.items[cls.items_at[p] : cls.items_at[p + 1]])
        if len(blocks) > 1:
            vars(block).pop("_value", None)  # one block in memory at a time
    if not blocks:
        for row, end, data, offsets in tb.text_groups(column):
            counts[row:end] = np.diff(tb.words(tb.lowered(data), offsets, tb.ALNUM)[2])
    return counts, spans, items


def _union(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    out: list[dict[str, int]] = []
    for s, e in sorted(set(spans)):
        if out and s <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], e)
        else:
            out.append({"start": s, "end": e})
    return out


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: list[str] | None = None,
    text: str = "text",
    size: int = SIZE,
    max_patterns: int = MAX_PATTERNS,
) -> DataFrame:
    """Columns ``keep`` (all by default) plus n_words, hits (disjoint word spans, end exclusive) and items."""
    spark = docs.sparkSession
    rows = benchmark.select("item_id", "text").toLocalIterator()
    blocks = [spark.sparkContext.broadcast(b) for b in pattern_blocks(rows, size, max_patterns)]
    result = [*_RESULT, T.StructField("items", T.ArrayType(benchmark.schema["item_id"].dataType))]
    taken = {f.name for f in result}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in taken]
    source, at = sent_once(docs, keep, text, "_scanned")
    schema = T.StructType([source.schema[c] for c in keep] + result)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, spans, items = _scan(blocks, batch.column(at))
            n = batch.num_rows
            hit_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            columns = [
                *batch.columns[: len(keep)],
                pa.array(counts),
                pa.array([_union(spans[i]) if i in spans else [] for i in range(n)], type=hit_type),
                pa.array([sorted(items[i]) if i in items else [] for i in range(n)], type=to_arrow_type(result[-1].dataType)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(tidy(scan), schema)


def digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find_passages(docs, benchmark, keep=["doc_id"])
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"])
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a benchmark window, with its columns."""
    aside = docs.select(*(F.col(c).alias(f"_own_{c}") for c in docs.columns))
    clean = find_passages(aside, benchmark, text="_own_text").where(F.size("hits") == 0)
    return clean.select(*(F.col(f"_own_{c}").alias(c) for c in docs.columns))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
w AS (SELECT DISTINCT item_id, n, array_to_string(ws[i : i + n - 1], ' ') AS k
      FROM (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i
            FROM b WHERE len(ws) > 0)),
s AS (SELECT rid, i, n, array_to_string(ws[i : i + n - 1], ' ') AS k
      FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM w))),
h AS (SELECT rid, i, s.n, item_id FROM s JOIN w ON s.k = w.k AND s.n = w.n),
c AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM h) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
      FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)
"""
