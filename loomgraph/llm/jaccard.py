"""Jaccard join of documents on word n-grams, by a size-aware heavy-light join.

A document's set holds its distinct five-word shingles.  Two documents link when
100 * intersection >= 75 * union, so a set of n shingles shares at least
ceil(0.75 n) of them with any partner.  Shingles are ordered, frequent ones
last.

* Light sets (n up to a boundary B) enumerate fixed-size subsets: all pairs of
  shingles of their first n - ceil(0.75 n) + 2.  Linked light sets share at
  least two of these shingles, hence a pair.
* Heavy sets scan inverted lists: each of their first n - ceil(0.75 n) + 1
  shingles is a list they are on.  Light sets that are large enough for a heavy
  partner (n above 0.75 B) are on these lists as well.

B is the boundary with the least cost: entries of the enumeration plus entries
of the lists, weighted with the cost of a scanned entry, over the histogram of
set sizes.

Keys (pairs and shingles alike) are sorted in Spark, and each key's members are
paired with the smallest one whose size allows a link (a star, not all pairs).
``linking.Linker`` verifies from these pairs and keys and joins components, so
copies never meet pairwise and no link between different components is lost.  A
position bound discards pairs that cannot overlap enough.  Verification computes
both sets anew from the texts.

The order only steers the work: shingles repeated within a group of a task's
texts are counted, and up to ``linking.MAX_FREQUENT`` of them (eight-byte hashes, a fixed
bound), the most frequent ones, are broadcast.  Any order gives the same links.

Shingles are 64-bit hashes of the words' bytes.  Equal sets form classes by
size and two independent digests; a class is compared through its smallest
doc_id.  A task offers equal sets once, so a hot group of copies reaches the
shuffle once per task.

Defined cases: null and blank texts have an empty set and link with nothing;
fewer than five words are one shingle; rows that repeat a doc_id are one
document that links if any of its texts does, each row with its own
n_shingles; a row without doc_id has no component; an empty table gives an
empty result; clashing input columns are ignored (only doc_id and text are
read).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.functions.plan import small_side
from loomgraph.llm import linking
from loomgraph.llm import textbytes as tb
from loomgraph.llm.linking import named_as
from loomgraph.llm.tables import tidy
from loomgraph.session import settle

WORDS = 5
SCAN_COST = 3.0
LARGEST_BOUNDARY = 64
NOT_SPACE = r"[^\x20\x09-\x0D]"


# --- sets


def shingle_sets(column: pa.Array, words: int = WORDS) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text."""
    return linking.shingle_sets(column, words)


def least_overlap(n: int) -> int:
    return -(-3 * n // 4)


def light_prefix(n: int) -> int:
    return min(n, n - least_overlap(n) + 2)


def heavy_prefix(n: int) -> int:
    return n - least_overlap(n) + 1


def boundary(sizes: dict[int, int], scan_cost: float = SCAN_COST, largest: int = LARGEST_BOUNDARY) -> int:
    """The size up to which enumerating pairs is cheaper than scanning lists.

    ``sizes``: documents per set size, with all sizes above ``2 * largest`` at one key.
    """

    def cost(b: int) -> float:
        pairs = sum(c * light_prefix(n) * (light_prefix(n) - 1) / 2 for n, c in sizes.items() if n <= b)
        lists = sum(c * heavy_prefix(n) for n, c in sizes.items() if 4 * n >= 3 * (b + 1))
        return pairs + scan_cost * lists

    return min(range(3, largest + 1), key=lambda b: (cost(b), b))


# --- the passes over the texts


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document its size and digests; per group of texts the shingles that several of them have."""
    for batch in batches:
        ids = batch.column(0)
        n, d1, d2 = [], [], []
        held: list[np.ndarray] = []
        seen: set[tuple[int, int]] = set()
        size = 0
        hashes, counts = [], []

        def flush(held=held, hashes=hashes, counts=counts) -> None:
            if held:
                u, c = np.unique(np.concatenate(held), return_counts=True)
                hashes.append(u[c > 1])
                counts.append(c[c > 1])
                held.clear()

        for _, s in shingle_sets(batch.column(1)):
            n.append(len(s))
            one = int(s.sum(dtype=np.uint64))
            two = int(tb.mix(s ^ np.uint64(0x5BD1E9955BD1E995)).sum(dtype=np.uint64))
            d1.append(one)
            d2.append(two)
            if (one, two) not in seen:
                seen.add((one, two))
                held.append(s)
                size += len(s)
                if size > 2_000_000:
                    flush()
                    size = 0
        flush()
        u = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
        c = np.concatenate(counts) if counts else np.zeros(0, dtype=np.int64)
        empty = len(u)
        yield pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([ids.cast(pa.int64()), pa.nulls(empty, pa.int64())]),
                pa.concat_arrays([pa.array(n, pa.int64()), pa.nulls(empty, pa.int64())]),
                pa.array(np.concatenate([np.array(d1, dtype=np.uint64), u]).view(np.int64)),
                pa.array(np.concatenate([np.array(d2, dtype=np.uint64).view(np.int64), c])),
            ],
            names=["doc_id", "n", "d1", "d2"],
        )


def _offer(batches: Iterator[pa.RecordBatch], frequent, limit: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, document, size and position, key before it) for the light pairs and the heavy lists.

    The lowest bit of a key says whether it is a pair.
    """
    hashes, counts = frequent.value
    seen: set[tuple[int, int, int]] = set()
    out: list[tuple[np.ndarray, ...]] = []
    held = 0

    def batch_of() -> pa.RecordBatch:
        keys, docs, places, before = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(keys.view(np.int64)), pa.array(docs), pa.array(places), pa.array(before.view(np.int64))],
            names=["key", "doc", "place", "before"],
        )

    for batch in batches:
        ids = batch.column(0).cast(pa.int64()).to_pylist()
        for row, s in shingle_sets(batch.column(1)):
            n = len(s)
            if n == 0 or ids[row] is None:
                continue
            same = (n, int(s.sum(dtype=np.uint64)), int(s[0]))
            if same in seen:
                continue
            seen.add(same)
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, s), len(hashes) - 1)
                common = hashes[at] == s
                if common.any():
                    s = s[np.lexsort((s, np.where(common, counts[at], 0)))]
            parts = []
            if n <= limit and n >= 2:
                i, j = np.triu_indices(light_prefix(n), 1)
                keys = tb.mix(s[i] * tb._STEP + tb.mix(s[j])) | np.uint64(1)
                parts.append((keys, j))
            if 4 * n >= 3 * (limit + 1):
                p = heavy_prefix(n)
                parts.append((s[:p] & ~np.uint64(1), np.arange(p)))
            for keys, pos in parts:
                before = np.concatenate([np.zeros(1, dtype=np.uint64), keys[:-1]])
                out.append((keys, np.full(len(keys), ids[row], dtype=np.int64), (n << 32) | pos.astype(np.int64), before))
                held += len(keys)
            if held >= 100_000:
                yield batch_of()
                out, held = [], 0
    if out:
        yield batch_of()


def may_link(pair_key, n, i, m, j):
    """Whether sets of n and m shingles that first share a key at positions i and j can overlap enough."""
    most = np.where(pair_key, 2, 1) + np.minimum(n - 1 - i, m - 1 - j)
    return (7 * most >= 3 * (n + m)) & (4 * np.minimum(n, m) >= 3 * np.maximum(n, m))


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (key, place): centre and member of a star per key, and the rows of keys with three or more.

    A pair comes as (null, centre, member, how many keys), a row as (key, document, size and position, key before it).

    A run may span batches: only its key, its current centre and its length so far are carried over.
    """
    key0, doc0, n0, i0, length0 = None, 0, 0, 0, 0
    pending: tuple | None = None  # rows of an open run that are not yet known to have three members
    for batch in batches:
        key, doc, place, before = (batch.column(k).to_numpy() for k in range(4))
        n, i = place >> 32, place & 0xFFFFFFFF
        if not len(key):
            continue
        held = 0
        if pending is not None:
            held = len(pending[0])
            key, doc, place, before = (np.concatenate(x) for x in zip(pending, (key, doc, place, before), strict=True))
            n, i = place >> 32, place & 0xFFFFFFFF
            pending = None
        begins = np.append(True, key[1:] != key[:-1])
        cont = bool(not held and key0 is not None and key[0] == key0)
        at = np.flatnonzero(begins)
        size = np.diff(np.append(at, len(key)))
        total = np.repeat(size, size)
        if cont:
            total[: size[0]] += length0
        # the last run may go on: keep its rows back while it is short
        last = at[-1]
        open_short = not (cont and len(at) == 1) and len(key) - last < 3
        if open_short:
            pending = (key[last:], doc[last:], place[last:], before[last:])
            key, doc, place, before, n, i, begins, total = (
                x[:last] for x in (key, doc, place, before, n, i, begins, total)
            )
            key0 = None
            if not last:
                continue
        # centres: a run's first row, then the first row too large for the centre before it
        starts = begins.copy()
        base_doc, base_n, base_i = doc0, n0, i0
        if cont:
            starts[0] = not (4 * base_n >= 3 * n[0])
        index = np.arange(len(key))
        while True:
            centre = np.maximum.accumulate(np.where(starts, index, -1))
            cn = np.where(centre >= 0, n[centre], base_n)
            wrong = 4 * cn < 3 * n
            if not wrong.any():
                break
            w = np.flatnonzero(wrong)
            first = w[np.append(True, centre[w][1:] != centre[w][:-1])]
            starts[first] = True
        cd = np.where(centre >= 0, doc[centre], base_doc)
        ci = np.where(centre >= 0, i[centre], base_i)
        ok = ~starts & (cd != doc) & may_link((key & 1).astype(bool), cn, ci, n, i)
        many = total >= 3
        cd_ok, doc_ok = cd[ok], doc[ok]
        order = np.lexsort((doc_ok, cd_ok))
        cd_ok, doc_ok = cd_ok[order], doc_ok[order]
        at = np.flatnonzero(np.append(True, (cd_ok[1:] != cd_ok[:-1]) | (doc_ok[1:] != doc_ok[:-1]))[: len(cd_ok)])
        yield _found(cd_ok[at], doc_ok[at], np.diff(np.append(at, len(cd_ok))), key[many], doc[many], place[many], before[many])
        if not open_short:
            key0, length0 = key[-1], int(total[-1])
            doc0, n0, i0 = int(cd[-1]), int(cn[-1]), int(ci[-1])
    if pending is not None:
        key, doc, place, _ = pending
        if len(key) == 2 and doc[0] != doc[1]:
            n, i = place >> 32, place & 0xFFFFFFFF
            if may_link(bool(key[0] & 1), n[0], i[0], n[1], i[1]):
                none = key[:0]
                yield _found(doc[:1], doc[1:], np.ones(1, dtype=np.int64), none, none, none, none)


def _found(centre, member, keys, key, doc, place, before) -> pa.RecordBatch:
    k = len(centre)
    return pa.RecordBatch.from_arrays(
        [
            pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(key, pa.int64())]),
            pa.array(np.concatenate([centre, doc])),
            pa.array(np.concatenate([member, place])),
            pa.array(np.concatenate([keys, before])),
        ],
        names=["key", "a", "b", "c"],
    )


# --- the join


def link_components(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    mixed = settle(texts.mapInArrow(tidy(_profile), "doc_id bigint, n bigint, d1 bigint, d2 bigint"))
    profile = mixed.where("n IS NOT NULL")
    counted = settle(mixed.where("n IS NULL").groupBy("d1").agg(F.sum("d2").alias("c")))
    frequent = spark.sparkContext.broadcast(linking.frequent_shingles(counted))
    sizes = dict(
        profile.where("n > 0").groupBy(F.least("n", F.lit(2 * LARGEST_BOUNDARY))).agg(F.count(F.lit(1))).collect()
    )
    limit = boundary(sizes)

    named, owner, bonds = linking.classes(profile)
    offered = texts.mapInArrow(tidy(lambda b: _offer(b, frequent, limit)), "key bigint, doc bigint, place bigint, before bigint")
    found = settle(
        offered.repartition("key").sortWithinPartitions("key", "place", "doc")
        .mapInArrow(tidy(_stars), "key bigint, a bigint, b bigint, c bigint")
    )

    pairs, rows = found.where("key IS NULL"), found.where("key IS NOT NULL")
    stars = named_as(named_as(pairs.select("a", "b", "c"), owner, "a"), owner, "b")
    stars = settle(stars.where("a <> b").groupBy("a", "b").agg(F.sum("c").alias("c")))
    live = named_as(rows.select("key", F.col("a").alias("doc"), F.col("b").alias("place"), F.col("c").alias("before")), owner, "doc")
    live = settle(live.distinct())
    frequent.unpersist()
    # texts that share a key with another one: few of all, read by every round
    shared = stars.select("a").union(stars.select("b")).union(live.select("doc")).distinct().toDF("_doc")
    near = settle(texts.join(small_side(settle(shared)), F.col("doc_id") == F.col("_doc"), "left_semi"))
    linker = linking.Linker(near, bonds, WORDS, 75, _fits)
    left = linker.meet_centres(stars)
    return linking.with_components(named, linker.finish(live, left))


def _fits(key, one, two):
    """``may_link`` as a column expression over two places (size and position in one long)."""
    n, i = F.shiftright(one, 32), one.bitwiseAND(0xFFFFFFFF)
    m, j = F.shiftright(two, 32), two.bitwiseAND(0xFFFFFFFF)
    most = F.when(key.bitwiseAND(1) == 1, 2).otherwise(1) + F.least(n - 1 - i, m - 1 - j)
    return (7 * most >= 3 * (n + m)) & (4 * F.least(n, m) >= 3 * F.greatest(n, m))


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each component the document with the smallest doc_id, with the columns of ``docs``.

    Rows without doc_id are documents of their own and come after all others;
    of rows that repeat a kept doc_id one stays; texts without words stay.
    """
    key, rank, gone_key = (linking.fresh(n, docs.columns) for n in ("row_key", "rank", "gone"))
    nameless = settle(
        docs.where("doc_id IS NULL").withColumn(key, F.lit(1 << 62) + F.monotonically_increasing_id())
    )
    keyed = docs.where("doc_id IS NOT NULL").withColumn(key, F.col("doc_id").cast("bigint")).union(nameless)
    linked = settle(link_components(keyed.select(F.col(key).alias("doc_id"), "text")))
    gone = settle(linked.where("component_id <> doc_id").select(F.col("doc_id").alias(gone_key)).distinct())
    kept = keyed.join(gone, F.col(key) == F.col(gone_key), "left_anti")
    repeated = settle(
        linked.where("n_shingles > 0").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(gone_key))
    )
    several = kept.where(F.col("text").rlike(NOT_SPACE)).join(repeated, F.col(key) == F.col(gone_key), "left_semi")
    first = several.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64("text"), "text")))
    single = kept.join(repeated, (F.col(key) == F.col(gone_key)) & F.col("text").rlike(NOT_SPACE), "left_anti")
    return single.select(*docs.columns).union(first.where(F.col(rank) == 1).select(*docs.columns))


SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(ws[i : i + 4], ' ') AS k
      FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM d WHERE len(ws) > 0)),
z AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
o AS (SELECT x.rid AS a, y.rid AS b, count(*) AS c FROM s x JOIN s y ON x.k = y.k AND x.rid < y.rid GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN z p ON p.rid = a JOIN z q ON q.rid = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT rid AS a, rid AS b FROM z UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT doc_id, coalesce(z.n, 0) AS n_shingles, coalesce(m.c, doc_id) AS component_id
FROM d LEFT JOIN z USING (rid) LEFT JOIN (
  SELECT r.a AS rid, min(d.doc_id) AS c FROM r JOIN d ON d.rid = r.b GROUP BY r.a) m USING (rid)
"""
