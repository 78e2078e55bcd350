"""From rows (key, document) to components of linked documents, without comparing groups pairwise.

Two documents are candidates when they share a key.  ``Linker`` verifies few
candidates at a time and joins components over the links found:

1. every document meets the centre it shares most keys with (``stars``);
2. for some rounds, while this finds links, the members of each key that lie outside its largest
   component meet one member of that component, first the one that can overlap
   most (a text near the middle of its group links with whatever links at all);
3. every pair of members of *different* components that share a key and can
   overlap enough is verified.

Step 3 makes the result exact for the candidates: a pair inside one component
needs no test, any other pair is tested or ruled out by its bound.

``place`` holds a set's size in its high half and, in its low half, how many of
its members are known to lie outside any overlap through that key.

Everything is stored below the checkpoint folder as it is made; nothing is
collected.  Tables of few rows are written by few tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.functions.plan import small_side
from loomgraph.llm import textbytes as tb
from loomgraph.llm.components import components
from loomgraph.llm.tables import tidy
from loomgraph.session import settle

BLOCK = 64
MAX_FREQUENT = 1 << 20
#: Rounds of step 2, which end earlier when one finds fewer than ``FEW`` links; step 3 does the rest.
MERGES = 6
FEW = 16
PAIRS_PER_TASK = 1_000


def shingle_sets(column: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text.

    Fewer words than a shingle has are one shingle; no words are the empty set.
    """
    for row, _, data, offsets in tb.text_groups(column):
        low = tb.lowered(data)
        starts, ends, first = tb.words(low, offsets, tb.SPACED)
        h = tb.hash_words(low, starts, ends)
        runs = tb.hash_windows(h, words)
        for t in range(len(first) - 1):
            a, b = int(first[t]), int(first[t + 1])
            if b - a >= words:
                yield row + t, np.unique(runs[a : b - words + 1])
            elif b > a:
                yield row + t, tb.hash_windows(h[a:b], b - a)
            else:
                yield row + t, np.zeros(0, dtype=np.uint64)


def digests(s: np.ndarray) -> tuple[int, int]:
    """Two independent digests of a set; equal sets have equal ones."""
    return int(s.sum(dtype=np.uint64)), int(tb.mix(s ^ np.uint64(0x5BD1E9955BD1E995)).sum(dtype=np.uint64))


def stored(df: DataFrame, rows: int, per_task: int) -> DataFrame:
    """``df``, made from ``rows`` rows, written by as many tasks as that takes."""
    return settle(df.coalesce(max(1, -(-rows // per_task))))


def fresh(name: str, taken: list[str]) -> str:
    """A column name like ``name`` that is not among ``taken``."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def frequent_shingles(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of the most frequent rows (d1, c), at most ``MAX_FREQUENT``."""
    top = 1 << 12
    histogram = counted.groupBy(F.least("c", F.lit(top)).alias("c")).count().collect()  # one row per count
    taken, least = 0, top + 1
    for c, k in sorted(map(tuple, histogram), reverse=True):
        if taken + k > MAX_FREQUENT:
            break
        taken, least = taken + k, c
    rows = counted.where(F.col("c") >= least).toArrow()
    hashes = rows.column("d1").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], rows.column("c").to_numpy()[order]


# --- classes of equal sets


def classes(profile: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From (doc_id, n, d1, d2): all rows with their class' smallest doc_id as ``rep``; owners; bonds.

    Owners (_doc, _rep) are the documents that another one stands for.  A doc_id
    with several texts binds their classes: bonds (a, b).
    """
    several = settle(
        profile.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "d1", "d2")
        .agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("_k")).where("_k > 1").drop("_k")
    )
    named = settle(
        profile.join(several, ["n", "d1", "d2"], "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"))
    )
    used = named.where("doc_id IS NOT NULL AND n > 0")
    other = used.where("doc_id <> rep").select(F.col("doc_id").alias("_doc")).distinct()
    owner = settle(
        used.join(other, F.col("doc_id") == F.col("_doc"), "left_semi").select(F.col("doc_id").alias("_doc"), F.col("rep").alias("_rep")).distinct()
    )
    bonds = settle(
        owner.groupBy("_doc").agg(F.min("_rep").alias("a"), F.max("_rep").alias("_z")).where("a < _z")
        .join(owner, "_doc").select("a", F.col("_rep").alias("b"))
    )
    return named, owner, bonds


def named_as(df: DataFrame, owner: DataFrame, column: str) -> DataFrame:
    """``df`` with the documents in ``column`` replaced by those that stand for them."""
    joined = df.join(owner, F.col(column) == F.col("_doc"), "left")
    return joined.withColumn(column, F.coalesce("_rep", column)).drop("_doc", "_rep")


def with_components(named: DataFrame, roots: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``named``."""
    return named.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("root", "rep"))
        .otherwise(F.col("doc_id")).alias("component_id"),
    )


# --- verification


def _check(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (a, block), the text of a first: the partners that link with a."""
    current, own = None, None
    for batch in batches:
        a, block, doc, centre = (batch.column(k).to_pylist() for k in range(4))
        left, right = [], []
        for row, s in shingle_sets(batch.column(4), words):
            if centre[row]:
                if (a[row], block[row]) != current:
                    current, own = (a[row], block[row]), []
                own.append(s)  # a repeated doc_id has several texts
                continue
            if (a[row], block[row]) != current:
                continue
            for t in own:
                if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
                    continue
                shared = len(np.intersect1d(s, t, assume_unique=True))
                if shared and 100 * shared >= percent * (len(s) + len(t) - shared):
                    left.append(a[row])
                    right.append(doc[row])
                    break
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def verify(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link; ``texts``: doc_id, text.

    Partners of one centre are compared in blocks, so its text is moved once per
    block and a centre with very many partners is spread over tasks.
    """
    crowded = pairs.groupBy("a").count().where(F.col("count") > BLOCK).select("a", F.ceil(F.col("count") / BLOCK).alias("_k"))
    blocked = pairs.join(crowded, "a", "left").select(
        "a", F.pmod(F.xxhash64("b"), F.coalesce("_k", F.lit(1))).cast("int").alias("block"), "b"
    )
    members = blocked.select("a", "block", F.col("b").alias("doc"), F.lit(False).alias("centre")).union(
        blocked.select("a", "block").distinct().select("a", "block", F.col("a").alias("doc"), F.lit(True).alias("centre"))
    )
    # counted: broadcast up to a fixed number of rows, so only wanted texts move; joined by shuffle beyond
    rows = texts.join(small_side(settle(members)), F.col("doc") == F.col("doc_id")).select("a", "block", "doc", "centre", "text")
    sorted_rows = rows.repartition("a", "block").sortWithinPartitions("a", "block", F.desc("centre"))
    return sorted_rows.mapInArrow(tidy(lambda b: _check(b, words, percent)), "a bigint, b bigint")


# --- components


class Linker:
    """Components of documents, grown link by link.

    ``texts``: doc_id and text of at least the candidates; ``fits`` says from a
    key and two places whether the two can overlap enough.
    """

    def __init__(
        self, texts: DataFrame, bonds: DataFrame, words: int, percent: int, fits: Callable[[Column, Column, Column], Column]
    ):
        self.texts, self.words, self.percent, self.fits = texts, words, percent, fits
        self.tested = bonds
        self.roots = settle(components(bonds, "a", "b"))

    def attempt(self, pairs: DataFrame) -> int:
        """Verify the pairs (a, b) not tested before and join components; how many links there were."""
        new = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        picks = settle(new.join(self.tested, ["a", "b"], "left_anti"))
        wanted = picks.count()
        if not wanted:
            return 0
        self.tested = self.tested.union(picks)
        linked = stored(verify(picks, self.texts, self.words, self.percent), wanted, PAIRS_PER_TASK)
        found = linked.count()
        if found:
            self._join(linked)
        return found

    def _join(self, linked: DataFrame) -> None:
        """Components over the links between components only."""
        one = self.roots.select(F.col("node").alias("a"), F.col("root").alias("_ra"))
        two = self.roots.select(F.col("node").alias("b"), F.col("root").alias("_rb"))
        ends = linked.join(one, "a", "left").join(two, "b", "left")
        moved = settle(components(ends.select(F.coalesce("_ra", "a").alias("a"), F.coalesce("_rb", "b").alias("b")), "a", "b"))
        to = moved.select(F.col("node").alias("_n"), F.col("root").alias("_to"))
        old = self.roots.join(to, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_to", "root").alias("root"))
        self.roots = settle(old.union(moved.join(self.roots, "node", "left_anti")))

    def apart(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b, ...) whose ends lie in different components."""
        one = self.roots.select(F.col("node").alias("_x"), F.col("root").alias("_rx"))
        two = self.roots.select(F.col("node").alias("_y"), F.col("root").alias("_ry"))
        joined = pairs.join(one, F.col("a") == F.col("_x"), "left").join(two, F.col("b") == F.col("_y"), "left")
        return joined.where(F.coalesce("_rx", "a") != F.coalesce("_ry", "b")).select(*pairs.columns)

    def meet_centres(self, stars: DataFrame) -> DataFrame:
        """Step 1 over (a, b, c): centre, member, keys they share; returns the pairs left between components."""
        best = stars.groupBy("b").agg(F.max_by("a", F.struct("c", -F.col("a"))).alias("a"))
        if not self.attempt(best):
            return stars
        return settle(self.apart(stars).join(self.tested, ["a", "b"], "left_anti"))

    def split_keys(self, rows: DataFrame, turn: int = 0) -> DataFrame:
        """Rows of the keys that several components hold, with ``root`` and the key's largest component ``_top``.

        Also one member (document and place) of that component as ``_rep``: the
        one with most room for an overlap, among equals another one each turn.
        Rows are dealt by key once; sums per component and per key are windows
        over that, so nothing is moved again.
        """
        placed = rows.join(self.roots, F.col("doc") == F.col("node"), "left").select(
            "key", "doc", "place", "before", F.coalesce("root", "doc").alias("root")
        )
        room = F.struct(F.col("place").bitwiseAND(0xFFFFFFFF), F.xxhash64("doc", F.lit(turn)), "doc", "place")
        held, key = Window.partitionBy("key", "root"), Window.partitionBy("key")
        return settle(
            placed.repartition("key")
            .withColumn("_own", F.struct(F.count(F.lit(1)).over(held), F.col("root"), F.min(room).over(held).alias("m")))
            .withColumn("_t", F.max("_own").over(key)).withColumn("_least", F.min("root").over(key))
            .withColumn("_most", F.max("root").over(key)).where("_least <> _most")
            .select(
                "key", "doc", "place", "before", "root", F.col("_t.root").alias("_top"),
                F.struct(F.col("_t.m.doc"), F.col("_t.m.place")).alias("_rep"),
            )
        )

    def finish(self, rows: DataFrame, left: DataFrame | None = None) -> DataFrame:
        """Steps 2 and 3 over rows (key, doc, place, before) and pairs without such rows; returns (node, root)."""
        for turn in range(MERGES):
            placed = self.split_keys(rows, turn)
            rows = placed.select("key", "doc", "place", "before")
            met = placed.where("root <> _top").where(self.fits(F.col("key"), F.col("place"), F.col("_rep.place")))
            best = (
                met.groupBy("doc", F.col("_rep.doc").alias("a")).count().groupBy(F.col("doc").alias("b"))
                .agg(F.max_by("a", F.struct("count", -F.col("a"))).alias("a"))
            )
            if self.attempt(best) < FEW:
                break
        rest = self.across(rows)
        self.attempt(rest if left is None else rest.union(self.apart(left.select("a", "b"))))
        return self.roots

    def across(self, rows: DataFrame) -> DataFrame:
        """Pairs of different components on one key.

        Of each key the members outside its largest component meet all others, so a
        key held by one component costs nothing and a hot component never meets itself.
        Two members with the same key before this one meet there already: a pair is
        formed where its common keys begin, so copies do not meet once per key.
        """
        placed = self.split_keys(rows)
        outer = placed.where("root <> _top").select("key", "doc", "place", "before", "root")
        other = placed.select(
            "key", F.col("doc").alias("doc2"), F.col("place").alias("place2"), F.col("before").alias("before2"),
            F.col("root").alias("root2"), "_top",
        )
        met = outer.join(other, "key").where(
            (F.col("root") != F.col("root2"))
            & ((F.col("root2") == F.col("_top")) | (F.col("doc") < F.col("doc2")))
            & ((F.col("before") != F.col("before2")) | (F.col("before") == 0))
            & self.fits(F.col("key"), F.col("place"), F.col("place2"))
        )
        return met.select(F.col("doc").alias("a"), F.col("doc2").alias("b")).distinct()
