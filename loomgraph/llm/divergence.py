"""Audit of how sources of a language diverge, by one-hot level products.

Terms are runs of letters and non-ASCII characters, A-Z lower-cased.  A language
keeps the terms that at least ``MIN_DOCS`` of its documents have, V of them.  A
group is a (lang, source) that occurs, N the sum of its counts of kept terms.  It
gives a kept term with count c >= 0 the share p = 1 + floor(10^9 (c + 2) / (N + 2 V))
and two shares differ by floor((p - q)^2 / (p + q)).  All of it is whole numbers.

* ``pair`` rows: for every other source of the language the sum of the
  differences over all kept terms, those that neither has included.
* ``term`` rows: the kept terms that a group has with a larger share than its
  language as a whole, the ``TOP`` largest differences.

A difference depends on the two counts only, so a pair needs no terms but its
joint table of count levels.  All tables come from matrix products: an indicator
matrix has a row per term and a column per (group, count level), count 0 included;
its transpose times itself holds, for every pair of groups, how many terms have
which two levels.  Each cell is priced once.  The product is blocked: terms go to
buckets of a language by hash, within a bucket frequent ones first, and a block
ends where it has ``COLUMNS`` columns, so rare terms with their few levels form
large blocks and frequent ones small blocks; the columns of many groups are cut
into tiles.  Entries of a product are at most a block's terms, exact in float32.

Counting is the only pass over the texts.  A task adds up the terms of its
documents in dictionaries of at most ``HELD`` entries before anything is shuffled,
so a hot source or a common term sends one row per task and flush.  Counts are
then dealt by (lang, term), where totals over a language are a window over its
sources.  Nothing is broadcast or collected; each bucket gets the list of its
language's groups as rows of its own.

Defined cases: null text, lang and source are ''; every row is a document,
whatever its doc_id, and repeated rows count again; blank texts form groups
without terms, whose pairs use N = 0; a language without kept terms has pairs of
value 0 and no terms; very long texts are read whole; equal values are ranked by
item in UTF-8 order; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.llm.tables import tidy
from loomgraph.session import settle

MIN_DOCS = 10
TOP = 10
SCALE = 1_000_000_000
HELD = 300_000
BUCKET = 200_000
COLUMNS = 512
LEAST_TERMS, MOST_TERMS = 32, 4096
ALL_PAIRS_HELD = 1024
_TERM = re.compile(rb"[a-z\x80-\xff]+")


# --- counting


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of runs of documents."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def told() -> pa.RecordBatch:
        lang, source, term, n, docs = [], [], [], [], []
        for (a, b), (c, d) in counts.items():
            lang += [a] * len(c)
            source += [b] * len(c)
            term += c.keys()
            n += c.values()
            docs += map(d.__getitem__, c)
        columns = [lang, source, pa.array(term, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.string()) if isinstance(c, list) else c for c in columns], names=["lang", "source", "term", "n", "docs"]
        )

    for batch in batches:
        for lang, source, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            found = _TERM.findall(text.lower())  # bytes: only A-Z change
            if not found:
                continue
            c, d = counts.setdefault((lang, source), (Counter(), Counter()))
            before = len(c)
            c.update(found)
            d.update(set(found))
            held += len(c) - before
            if held >= HELD:
                yield told()
                counts.clear()
                held = 0
    if counts:
        yield told()


def levels(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n, lang_n, leads) of the kept terms a group has; ``leads`` on one row per (lang, term)."""
    parts = docs.select(_named("lang"), _named("source"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    counted = parts.mapInArrow(tidy(_count), "lang string, source string, term string, n bigint, docs bigint")
    # dealt once: the window's groups hold the aggregate's
    dealt = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    totals = dealt.withColumns(
        {"lang_n": F.sum("n").over(term), "_docs": F.sum("docs").over(term), "leads": F.col("source") == F.min("source").over(term)}
    )
    return totals.where(F.col("_docs") >= min_docs).select("lang", "source", "term", "n", "lang_n", "leads")


def _named(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias(column)


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)), in decimals as the product may leave 64 bits."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    return F.call_function("div", above, (total + 2 * terms).cast("decimal(20,0)")) + 1


def difference(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


# --- groups


def group_sizes(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, gid, groups, total, terms, lang_total, buckets) of every group that occurs; gid counts from 0 in its language."""
    occurring = docs.select(_named("lang"), _named("source")).distinct()
    own = kept.groupBy("lang", "source").agg(
        F.sum("n").alias("total"), F.sum(F.when(F.col("leads"), 1).otherwise(0)).alias("terms"), F.count(F.lit(1)).alias("entries")
    )
    lang = Window.partitionBy("lang")
    return occurring.join(own, ["lang", "source"], "left").select(
        "lang", "source",
        (F.row_number().over(lang.orderBy("source")) - 1).cast("bigint").alias("gid"),
        F.count(F.lit(1)).over(lang).alias("groups"),
        F.coalesce("total", F.lit(0)).alias("total"),
        F.coalesce(F.sum("terms").over(lang), F.lit(0)).alias("terms"),
        F.coalesce(F.sum("total").over(lang), F.lit(0)).alias("lang_total"),
        (1 + F.call_function("div", F.coalesce(F.sum("entries").over(lang), F.lit(0)), F.lit(BUCKET))).alias("buckets"),
    )


# --- joint tables by matrix products


def joint_values(term: np.ndarray, gid: np.ndarray, p: np.ndarray, zero: np.ndarray, acc: np.ndarray) -> None:
    """Add to ``acc`` (groups x groups, upper half) the differences over all terms of a block.

    ``term``: row numbers from 0, without gaps; ``zero``: each group's share of a term it does not have.
    """
    groups, terms = len(zero), int(term.max()) + 1
    column, level = np.unique(np.stack([gid, p]), axis=1, return_inverse=True)
    level = level.ravel()
    own = column.shape[1]
    if own + groups > COLUMNS and terms > LEAST_TERMS:
        half = term < terms // 2
        joint_values(term[half], gid[half], p[half], zero, acc)
        joint_values(term[~half] - terms // 2, gid[~half], p[~half], zero, acc)
        return
    owner = np.concatenate([column[0], np.arange(groups)])
    price = np.concatenate([column[1], zero])
    order = np.argsort(owner, kind="stable")
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    owner, price = owner[order], price[order]
    x = np.zeros((terms, len(order)), dtype=np.float32)
    x[:, place[own:]] = 1
    x[term, place[own + gid]] = 0
    x[term, place[level]] = 1
    tiles = _tiles(owner)
    for k, (a, b) in enumerate(tiles):
        for c, d in tiles[k:]:
            table = x[:, a:b].T @ x[:, c:d]
            i, j = np.nonzero(table)
            gi, gj = owner[a + i], owner[c + j]
            upper = gi < gj
            i, j, gi, gj = i[upper], j[upper], gi[upper], gj[upper]
            one, two = price[a + i], price[c + j]
            worth = (one - two) ** 2 // (one + two) * table[i, j].astype(np.int64)
            np.add.at(acc, (gi, gj), worth)


def _tiles(owner: np.ndarray) -> list[tuple[int, int]]:
    """Runs of columns of whole groups, about ``2 * COLUMNS`` each."""
    ends = np.flatnonzero(np.append(owner[1:] != owner[:-1], True)) + 1
    out, first = [], 0
    for k, end in enumerate(ends):
        if k + 1 == len(ends) or ends[k + 1] - first > 2 * COLUMNS:
            out.append((first, int(end)))
            first = int(end)
    return out


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (lang, bucket, term, gid, p), a bucket's groups first without a term: (lang, a, b, value)."""
    here: tuple | None = None
    zero: list[np.ndarray] = []
    acc: np.ndarray | None = None
    held: list[tuple] = []

    def block(upto_end: bool) -> None:
        """Price the held rows; the last term may go on in the next batch unless the bucket ends."""
        nonlocal held, acc, zero
        if isinstance(zero, list):
            zero = np.concatenate(zero)
        if acc is None:
            acc = np.zeros((len(zero), len(zero)), dtype=np.int64)
        if not held:
            return
        term = pa.concat_arrays([h[0] for h in held])
        gid, p = (np.concatenate([h[k] for h in held]) for k in (1, 2))
        new = np.append(True, pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False))
        number = np.cumsum(new) - 1
        end = len(number) if upto_end else int(np.searchsorted(number, number[-1]))
        for first in range(0, int(number[end - 1]) + 1 if end else 0, MOST_TERMS):
            a, b = np.searchsorted(number[:end], [first, first + MOST_TERMS])
            joint_values(number[a:b] - first, gid[a:b], p[a:b], zero, acc)
        held = [] if upto_end else [(term[end:], gid[end:], p[end:])]

    def told() -> Iterator[pa.RecordBatch]:
        """The sums so far; the first bucket of a language tells every pair."""
        nonlocal acc
        a, b = np.nonzero(np.triu(np.ones_like(acc), 1) if here[1] == 0 else acc)
        acc_ab = acc[a, b]
        acc = np.zeros_like(acc)
        for k in range(0, len(a), 100_000):
            part = slice(k, k + 100_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array([here[0]] * len(a[part]), pa.string()), pa.array(a[part]), pa.array(b[part]), pa.array(acc_ab[part])],
                names=["lang", "a", "b", "value"],
            )

    for batch in batches:
        lang, bucket = batch.column(0), batch.column(1)
        rows = batch.num_rows
        if not rows:
            continue
        changes = pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(bucket[1:], bucket[:-1])).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(changes) + 1).tolist(), rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = (lang[a].as_py(), bucket[a].as_py())
            if key != here:
                if here is not None:
                    block(True)
                    yield from told()
                here, zero, acc, held = key, [], None, []
            part = batch.slice(a, b - a)
            gid, p = (part.column(k).to_numpy() for k in (3, 4))
            heads = int(part.column(2).null_count)  # they come first
            if heads:
                zero.append(p[:heads])
            if b - a > heads:
                held.append((part.column(2)[heads:], gid[heads:], p[heads:]))
        if sum(len(h[0]) for h in held) >= 50_000:
            block(False)
    if here is not None:
        block(True)
        yield from told()


def pair_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every ordered pair of sources of a language."""
    heads = groups.select(
        "lang", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"), F.lit(None).cast("string").alias("term"), "gid",
        F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms"))).otherwise(1).alias("p"),
        F.lit(None).cast("bigint").alias("lang_n"),
    )
    entries = kept.join(groups, ["lang", "source"]).select(
        "lang", F.pmod(F.xxhash64("term"), F.col("buckets")).alias("bucket"), "term", "gid",
        share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), "lang_n",
    )
    sums = (
        heads.union(entries).repartition("lang", "bucket")
        .sortWithinPartitions("lang", "bucket", F.desc_nulls_first("lang_n"), F.asc_nulls_first("term"), "gid")
        .select("lang", "bucket", "term", "gid", "p")
        .mapInArrow(tidy(_products), "lang string, a bigint, b bigint, value bigint")
        .groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    )
    both = sums.union(sums.select("lang", "b", "a", "value"))
    name = lambda column, gid: groups.select("lang", F.col("source").alias(column), F.col("gid").alias(gid))
    return both.join(name("source", "a"), ["lang", "a"]).join(name("item", "b"), ["lang", "b"]).select("lang", "source", "item", "value")


# --- the audit


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank."""
    kept = settle(levels(docs, min_docs))
    groups = settle(group_sizes(docs, kept))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pairs = settle(pair_values(kept, groups)).withColumn("rank", F.row_number().over(by_value))
    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    terms = (
        kept.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q"))
        .where("p > q").select("lang", "source", "item", difference(F.col("p"), F.col("q")).alias("value"))
        .withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)
    )
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs, "pair").union(columns(terms, "term"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT rid, lang, source, unnest(ts) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT rid) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
        1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2)) // (coalesce(s.n, 0) + 2 * v.v) AS p,
        1 + (CAST(1000000000 AS HUGEINT) * (k.n + 2)) // (v.n + 2 * v.v) AS q
      FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN s USING (lang, source)),
w AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(w.value, 0) AS BIGINT) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN w ON w.lang = a.lang AND w.source = a.source AND w.item = b.source
      UNION ALL
      SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM x)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
"""
