"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

A document's set holds its distinct three-word shingles; two documents link when
100 * intersection >= 85 * union.

* Sketch: ``BINS`` values filled in rounds.  In each of the first ``BINS`` rounds
  every shingle is hashed to one bin and to a value, a bin keeps its least value,
  and values of later rounds are larger than all of earlier ones; in round
  ``BINS`` + i every shingle goes to bin i.  A set stops after the first round that
  leaves no bin empty, so every coordinate is filled after at most 2 * ``BINS``
  rounds, large sets take few, and the number of equal coordinates is concentrated
  around the Jaccard similarity.  All sets of a group of texts take a round at once.
* Banding: runs of ``ROWS`` coordinates are one key each.  With 40 bands of six a
  pair at the threshold shares no key with a chance below 1e-8, one of similarity
  0.3 shares one with a chance below 3 %.
* Verification: candidates share a key.  Of each key the members meet its
  smallest one first (a star).  ``linking.Linker`` joins components over the
  links, each confirmed on the full sets, computed anew from the texts.

Documents that then still share a key with one of another component are ruled out
by an exact bound where possible: with their shingles ordered, frequent ones last,
linked sets share one of their first n - ceil(0.85 n) + 1, and its positions
limit the overlap.  A large group of copies with noise of their own so costs few
comparisons.  The order only steers the work: it rests on up to ``MAX_FREQUENT``
shingles that several of these documents have, the most frequent ones, broadcast.

Shingles are 64-bit hashes of the words' bytes.  Equal sets form classes by size
and two independent digests; a class is compared through its smallest doc_id.  A
task offers equal sets once, so a hot group of copies reaches the shuffle once per
task, and a common shingle is counted within the task first.

Defined cases: null and blank texts have an empty set and link with nothing; fewer
than three words are one shingle; very long texts are read whole, a group of
their own each; rows that repeat a doc_id are one document that links if any of
its texts does, each row with its own n_shingles; a row without doc_id has no
component and is kept; of repeated rows all have the same verdict; ties do not
occur, as the smallest doc_id decides; an empty table gives an empty result;
clashing input columns are ignored (only doc_id and text are read).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.plan import small_side
from loomgraph.llm import linking
from loomgraph.llm import textbytes as tb
from loomgraph.llm.linking import named_as
from loomgraph.llm.tables import tidy
from loomgraph.session import settle

WORDS = 3
PERCENT = 85
BINS = 240
ROWS = 6
BANDS = BINS // ROWS
_LOW = np.uint64(0xFFFFFFFF)
_HALF = np.uint64(32)
_GROUP = 400_000


# --- sketches


def sketches(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """One row of ``bins`` filled coordinates per non-empty set of 64-bit hashes."""
    filled = np.full(len(sets) * bins, np.iinfo(np.uint64).max, dtype=np.uint64)
    if not len(sets):
        return filled.reshape(0, bins)
    owner = np.repeat(np.arange(len(sets), dtype=np.int64), [len(s) for s in sets])
    items = np.concatenate(sets)
    seeds = tb.mix(np.arange(1, 2 * bins + 1, dtype=np.uint64) * tb._GOLD)
    for turn in range(2 * bins):
        h = tb.mix(items ^ seeds[turn])
        # the high half chooses the bin, the low half is the value behind the round's number
        at = (((h >> _HALF) * np.uint64(bins)) >> _HALF).astype(np.int64) if turn < bins else turn - bins
        np.minimum.at(filled, owner * bins + at, (np.uint64(turn) << _HALF) | (h & _LOW))
        empty = (filled.reshape(-1, bins) == np.iinfo(np.uint64).max).any(axis=1)
        going = empty[owner]
        if not going.all():
            owner, items = owner[going], items[going]
            if not len(items):
                break
    return filled.reshape(-1, bins)


def band_keys(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One key per band and sketch; the band's number is part of it."""
    bands = sketch.shape[1] // rows
    parts = sketch[:, : bands * rows].reshape(len(sketch), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * tb._GOLD, parts.shape[:2])
    for k in range(rows):
        key = tb.mix(key * tb._STEP + parts[:, :, k])
    return key


def _offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (false, doc_id, n, digests) of the documents, (true, doc, place, key, key of the band before) of their sketches."""
    seen: set[tuple[int, int, int]] = set()
    for batch in batches:
        ids = batch.column(0).to_pylist()
        own, n, d1, d2 = [], [], [], []
        waiting: list[tuple[int, np.ndarray]] = []
        held = 0
        for row, s in linking.shingle_sets(batch.column(1), WORDS):
            one, two = linking.digests(s)
            own.append(ids[row])
            n.append(len(s))
            d1.append(one)
            d2.append(two)
            if not len(s) or ids[row] is None or (len(s), one, two) in seen:
                continue
            seen.add((len(s), one, two))
            waiting.append((ids[row], s))
            held += len(s) + BINS
            if held >= _GROUP:
                yield _banded(waiting)
                waiting, held = [], 0
        if waiting:
            yield _banded(waiting)
        yield _mixed(
            False, pa.array(own, pa.int64()), np.array(n, dtype=np.int64),
            np.array(d1, dtype=np.uint64).view(np.int64), np.array(d2, dtype=np.uint64).view(np.int64),
        )


def _banded(sets: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    keys = band_keys(sketches([s for _, s in sets]))
    before = np.concatenate([np.zeros((len(keys), 1), dtype=np.uint64), keys[:, :-1]], axis=1)
    docs = np.repeat(np.array([d for d, _ in sets], dtype=np.int64), keys.shape[1])
    place = np.repeat(np.array([len(s) for _, s in sets], dtype=np.int64) << 32, keys.shape[1])
    return _mixed(True, pa.array(docs), place, keys.ravel().view(np.int64), before.ravel().view(np.int64))


def _mixed(band: bool, doc_id: pa.Array, n, d1, d2) -> pa.RecordBatch:
    kind = pa.array(np.full(len(n), band))
    return pa.RecordBatch.from_arrays([doc_id, pa.array(n), pa.array(d1), pa.array(d2), kind], names=["doc_id", "n", "d1", "d2", "band"])


# --- candidates


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (key, doc, place, before) sorted by key and place: those of keys with several rows, and the key's first doc.

    A run may span batches: its key, its first doc, and its only row so far are carried over.
    """
    open_key, centre0, alone = None, 0, None
    for batch in batches:
        columns = [batch.column(k).to_numpy() for k in range(4)]
        if not len(columns[0]):
            continue
        if alone is not None:
            columns = [np.append([x], c) for x, c in zip(alone, columns, strict=True)]
            open_key = None
        key, doc = columns[0], columns[1]
        starts = np.append(open_key is None or key[0] != open_key, key[1:] != key[:-1])
        first = np.maximum.accumulate(np.where(starts, np.arange(len(key)), -1))
        centre = np.where(first >= 0, doc[first], centre0)
        single = starts & np.append(starts[1:], True)
        alone = tuple(int(c[-1]) for c in columns) if single[-1] else None
        open_key, centre0 = key[-1], int(centre[-1])
        kept = [pa.array(c[~single]) for c in (*columns, centre)]
        yield pa.RecordBatch.from_arrays(kept, names=["key", "doc", "place", "before", "centre"])


# --- bounds for the candidates left


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that several candidates of a group of texts have, with their number."""
    held: list[np.ndarray] = []
    size = 0

    def told() -> pa.RecordBatch:
        u, c = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(u[c > 1].view(np.int64)), pa.array(c[c > 1])], names=["d1", "c"])

    for batch in batches:
        for _, s in linking.shingle_sets(batch.column(1), WORDS):
            held.append(s)
            size += len(s)
            if size > 2_000_000:
                yield told()
                held, size = [], 0
    if held:
        yield told()


def least_overlap(n: int) -> int:
    return -(-PERCENT * n // 100)


def _prefixes(batches: Iterator[pa.RecordBatch], frequent) -> Iterator[pa.RecordBatch]:
    """Rows (shingle, doc, size and position, shingle before it) for the first shingles of a set, frequent ones last.

    Two sets that link share one of their first n - ceil(0.85 n) + 1.
    """
    hashes, counts = frequent.value
    for batch in batches:
        ids = batch.column(0).to_pylist()
        keys, docs, places, before = [], [], [], []
        for row, s in linking.shingle_sets(batch.column(1), WORDS):
            n = len(s)
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, s), len(hashes) - 1)
                s = s[np.lexsort((s, np.where(hashes[at] == s, counts[at], 0)))]
            p = n - least_overlap(n) + 1 if n else 0
            keys.append(s[:p])
            docs.append(np.full(p, ids[row], dtype=np.int64))
            places.append((n << 32) | np.arange(p, dtype=np.int64))
            before.append(np.append(np.zeros(min(p, 1), dtype=np.uint64), s[: max(p - 1, 0)]))
        cols = [np.concatenate(keys).view(np.int64), np.concatenate(docs), np.concatenate(places), np.concatenate(before).view(np.int64)] if ids else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["key", "doc", "place", "before"])


def first_shingles(near: DataFrame, live: DataFrame) -> DataFrame:
    """The rows of ``_prefixes`` for the documents of ``live`` (_doc)."""
    texts = settle(near.join(small_side(live), F.col("doc_id") == F.col("_doc"), "left_semi"))
    counted = settle(texts.mapInArrow(tidy(_repeated), "d1 bigint, c bigint").groupBy("d1").agg(F.sum("c").alias("c")))
    frequent = near.sparkSession.sparkContext.broadcast(linking.frequent_shingles(counted))
    rows = settle(texts.mapInArrow(tidy(lambda b: _prefixes(b, frequent)), "key bigint, doc bigint, place bigint, before bigint"))
    frequent.unpersist()
    return rows


# --- the operator


def _fits(key, one, two):
    """Whether sets that first share a shingle at two places (size and position in one long) can overlap enough."""
    n, i = F.shiftright(one, 32), one.bitwiseAND(0xFFFFFFFF)
    m, j = F.shiftright(two, 32), two.bitwiseAND(0xFFFFFFFF)
    most = F.least(n - i, m - j)
    return ((100 + PERCENT) * most >= PERCENT * (n + m)) & (100 * F.least(n, m) >= PERCENT * F.greatest(n, m))


def link_components(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    mixed = settle(texts.mapInArrow(tidy(_offer), "doc_id bigint, n bigint, d1 bigint, d2 bigint, band boolean"), "band")
    named, owner, bonds = linking.classes(mixed.where("NOT band").drop("band"))
    offered = mixed.where("band").select(F.col("d1").alias("key"), F.col("doc_id").alias("doc"), F.col("n").alias("place"), F.col("d2").alias("before"))
    met = settle(
        offered.repartition("key").sortWithinPartitions("key", "place", "doc")
        .mapInArrow(tidy(_shared), "key bigint, doc bigint, place bigint, before bigint, centre bigint")
    )
    met = settle(named_as(named_as(met, owner, "doc"), owner, "centre").distinct())
    stars = settle(
        met.where("doc <> centre").groupBy(F.col("centre").alias("a"), F.col("doc").alias("b")).agg(F.count(F.lit(1)).alias("c"))
    )
    rows = met.select("key", "doc", "place", "before").distinct()
    # texts that share a key with another one: few of all, read by every round
    candidates = settle(rows.select(F.col("doc").alias("_doc")).distinct())
    near = settle(texts.join(small_side(candidates), F.col("doc_id") == F.col("_doc"), "left_semi"))
    linker = linking.Linker(near, bonds, WORDS, PERCENT, _fits)
    linker.meet_centres(stars)
    live = settle(linker.split_keys(rows).select(F.col("doc").alias("_doc")).distinct())
    return linking.with_components(named, linker.finish(first_shingles(near, live)))


def kept_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and whether the row's document is the one its component keeps."""
    return link_components(docs).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(ws[i : i + 2], ' ') AS k
      FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM d WHERE len(ws) > 0)),
z AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
o AS (SELECT x.rid AS a, y.rid AS b, count(*) AS c FROM s x JOIN s y ON x.k = y.k AND x.rid < y.rid GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN z p ON p.rid = a JOIN z q ON q.rid = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT rid AS a, rid AS b FROM z UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT doc_id, coalesce(z.n, 0) AS n_shingles, coalesce(m.c, doc_id) AS component_id, coalesce(m.c, doc_id) = doc_id AS kept
FROM d LEFT JOIN z USING (rid) LEFT JOIN (
  SELECT r.a AS rid, min(d.doc_id) AS c FROM r JOIN d ON d.rid = r.b GROUP BY r.a) m USING (rid)
"""
