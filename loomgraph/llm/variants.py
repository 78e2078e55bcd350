"""Groups of spelling variants: k-d trees over letter counts, letter order verified.

A word is a distinct run of letters, A-Z lower-cased, of at least ``LENGTH`` code
points and at least ``LEAST`` occurrences.  Two words are near when they differ by
one inserted, deleted or replaced code point.  One insertion changes one letter
count by one, one replacement lowers one count and raises another: letter-count
vectors of near words have L1 distance one or two.

Vectors are kept in unary code: 32 counts (a to z, the rest folded into six) of up
to four, a bit each, so L1 distance is the number of differing bits, never more
than the true one, and a box (the counts that all, and that any of its points
reach) is two such codes.

Every pair of lengths (L, L) and (L, L + 1) is one range search:

* A coarse k-d tree per length, fitted on at most ``SAMPLE`` words in all (those of
  smallest hash), cuts its words into cells of about ``CELL``; all words are placed.
* A word goes to its own cell, and as a query to every other cell of its length and
  of the next one whose box it can reach: at most one count up, and one down where
  the lengths are equal.  Of two cells of one length only the later one is asked.
* A cell's words form a k-d tree of their own, split where it halves them best down
  to leaves of ``LEAF``; queries descend in batches, pruned at each box by the same
  rule.  Words of a leaf within reach are then compared letter by letter.

A word's form is its near word of largest n if that is at least ``RATIO`` times its
own; every step multiplies n, so chains of forms are short, and doubling steps find
their ends in a number of joins known from the largest n.

Runs are counted once, in dictionaries of at most ``HELD`` words per task before
anything is shuffled.  Some runs lose a code point, chosen by a checksum of document
and run (``FAULT``).

Defined cases: null and blank texts have no words; a null doc_id counts as '' in the
checksum; repeated rows count again; very long texts and runs are read whole, cells
of long words hold fewer of them; ties of n go to the smaller word in code-point
order; without words, or for an empty table, the result is empty; other columns are
not read.  Words with one and the same letter counts cannot be told apart by a tree:
they share a leaf and are compared in blocks.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.tables import tidy
from loomgraph.session import settle

LENGTH = 7
LEAST = 2
RATIO = 10
FAULT = 31
HELD = 300_000
SAMPLE = 1 << 16
CELL = 8192
CELL_BYTES = 4 << 20
LEAF = 64
_BLOCK = 1 << 20
_RUN = re.compile("[a-z\\u00C0-\\u00FF]{%d,}" % LENGTH)


# --- words


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of runs of documents."""
    total: Counter[str] = Counter()

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if not text:
                continue
            low = text.lower() if text.isascii() else text.encode().lower().decode()  # bytes: only A-Z change
            start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
            for run, n in Counter(_RUN.findall(low)).items():
                h = zlib.crc32(run.encode(), start)
                if h % FAULT == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                    if len(run) < LENGTH:
                        continue
                total[run] += n
            if len(total) >= HELD:
                yield told()
                total.clear()
    if total:
        yield told()


def words(docs: DataFrame) -> DataFrame:
    """(word, n, length)."""
    parts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    counted = parts.mapInArrow(tidy(_count), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= LEAST).withColumn("length", F.length("word"))


# --- letter counts


_DIMENSION = np.array([c - 97 if 97 <= c <= 122 else 26 + c % 6 for c in range(256)])
_LEVELS = 4


def codes(strings: list[str]) -> np.ndarray:
    """One row of letters per word; all of one length.  Letters are below U+0100."""
    return np.frombuffer("".join(strings).encode("latin-1"), dtype=np.uint8).reshape(len(strings), -1)


def unary(letters: np.ndarray) -> np.ndarray:
    """Letter counts as two 64-bit words per row: bit 4 d + k is set when letter d occurs more than k times."""
    counts = np.zeros((len(letters), 32), dtype=np.int32)
    rows = np.arange(len(letters))
    for column in letters.T:
        counts[rows, _DIMENSION[column]] += 1
    bits = (counts[:, :, None] > np.arange(_LEVELS)).reshape(len(letters), 128)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def _bits(code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(code).sum(axis=-1, dtype=np.int64)


class Tree:
    """A k-d tree over unary letter counts; a node is a box, and two nodes or a leaf.

    ``tight``: boxes around the points, otherwise all that the splits allow.
    """

    def __init__(self, points: np.ndarray, leaf: int, tight: bool):
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.children: list[tuple[int, int] | None] = []
        self.members: list[np.ndarray | None] = []
        everything = np.full(2, np.iinfo(np.uint64).max, dtype=np.uint64)
        waiting = [(np.arange(len(points)), np.zeros(2, dtype=np.uint64), everything, None)]
        while waiting:
            at, low, high, above = waiting.pop()
            node = len(self.low)
            if above is not None:
                pair = list(self.children[above[0]])
                pair[above[1]] = node
                self.children[above[0]] = tuple(pair)
            mine = points[at]
            if tight and len(at):
                low, high = np.bitwise_and.reduce(mine, axis=0), np.bitwise_or.reduce(mine, axis=0)
            self.low.append(low)
            self.high.append(high)
            split = self._split(mine) if len(at) > leaf else None
            if split is None:
                self.children.append(None)
                self.members.append(at)
                continue
            self.children.append((0, 0))
            self.members.append(None)
            bit, has = split
            # a count above k is above all smaller k; a count not above k is not above any larger one
            word, first = bit // 64, bit % 64 // _LEVELS * _LEVELS
            below = np.uint64(((1 << (bit % 64 + 1)) - 1) ^ ((1 << first) - 1))
            beyond = np.uint64(((1 << (first + _LEVELS)) - 1) ^ ((1 << (bit % 64)) - 1))
            more, less = low.copy(), high.copy()
            more[word] |= below
            less[word] &= ~beyond
            waiting.append((at[has], more, high, (node, 1)))
            waiting.append((at[~has], low, less, (node, 0)))
        self.leaves = [k for k, c in enumerate(self.children) if c is None]
        self.number = {node: k for k, node in enumerate(self.leaves)}

    @staticmethod
    def _split(points: np.ndarray) -> tuple[int, np.ndarray] | None:
        """The count and level that halve the points best."""
        bits = np.unpackbits(np.ascontiguousarray(points).view(np.uint8), axis=1, bitorder="little")
        ones = bits.sum(axis=0, dtype=np.int64)
        bit = int(np.abs(2 * ones - len(points)).argmin())
        return (bit, bits[:, bit].astype(bool)) if 0 < ones[bit] < len(points) else None

    def reach(self, queries: np.ndarray, longer: bool) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, queries that can reach its box): by one letter more, and one fewer unless the points are ``longer``."""
        waiting = [(0, np.arange(len(queries)))]
        while waiting:
            node, at = waiting.pop()
            q = queries[at]
            near = (_bits(self.low[node] & ~q) <= 1) & (_bits(q & ~self.high[node]) <= (0 if longer else 1))
            if not near.all():
                at = at[near]
            if not len(at):
                continue
            if self.children[node] is None:
                yield node, at
            else:
                waiting += [(child, at) for child in self.children[node]]

    def home(self, points: np.ndarray) -> np.ndarray:
        """The leaf (counted from 0) whose box holds each point; boxes must not be tight."""
        out = np.zeros(len(points), dtype=np.int64)
        waiting = [(0, np.arange(len(points)))]
        while waiting:
            node, at = waiting.pop()
            if not len(at):
                continue
            if self.children[node] is None:
                out[at] = self.number[node]
                continue
            zero, one = self.children[node]
            inside = (_bits(self.low[one] & ~points[at]) == 0) & (_bits(points[at] & ~self.high[one]) == 0)
            waiting += [(one, at[inside]), (zero, at[~inside])]
        return out


# --- coarse cells


class Cells:
    """Per length a coarse tree and the number of its first cell."""

    def __init__(self, sample: list[str], lengths: dict[int, int]):
        by_length: dict[int, list[str]] = {}
        for word in sample:
            by_length.setdefault(len(word), []).append(word)
        self.trees: dict[int, tuple[Tree, int]] = {}
        first = 0
        for length, total in sorted(lengths.items()):
            mine = sorted(by_length.get(length, []))
            wanted = -(-total // max(1, min(CELL, CELL_BYTES // length)))
            points = unary(codes(mine)) if mine else np.zeros((0, 2), dtype=np.uint64)
            tree = Tree(points, max(8, len(mine) // wanted), tight=False)
            self.trees[length] = (tree, first)
            first += len(tree.leaves)

    def place(self, strings: list[str], length: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """(cell, role, words): role 0 at home, 1 asking a later cell of the same length, 2 a cell of the next length."""
        points = unary(codes(strings))
        tree, first = self.trees[length]
        own = tree.home(points)
        order = np.argsort(own, kind="stable")
        cuts = np.flatnonzero(np.append(True, own[order][1:] != own[order][:-1]))
        for part in np.split(order, cuts[1:]):
            yield first + int(own[part[0]]), 0, part
        for node, at in tree.reach(points, longer=False):
            later = at[own[at] < tree.number[node]]
            if len(later):
                yield first + tree.number[node], 1, later
        if length + 1 in self.trees:
            tree, first = self.trees[length + 1]
            for node, at in tree.reach(points, longer=True):
                yield first + tree.number[node], 2, at


def _place(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    cells: Cells = shared.value
    for batch in batches:
        length = batch.column(2).to_numpy()
        rows, cell, role = [], [], []
        for one in np.unique(length):
            at = np.flatnonzero(length == one)
            for number, part, some in cells.place(batch.column(0).take(pa.array(at)).to_pylist(), int(one)):
                rows.append(at[some])
                cell.append(np.full(len(some), number, dtype=np.int64))
                role.append(np.full(len(some), part, dtype=np.int32))
        if rows:
            at = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(cell)), pa.array(np.concatenate(role)), batch.column(0).take(at), batch.column(1).take(at)],
                names=["cell", "role", "word", "n"],
            )


# --- search in a cell


def near_pairs(points: np.ndarray, tree: Tree, letters: np.ndarray, asked: np.ndarray, longer: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, point) numbers of near words; ``points`` and ``letters`` are the tree's, ``asked`` the queries' letters."""
    queries = unary(asked)
    for node, at in tree.reach(queries, longer):
        members = tree.members[node]
        step = max(1, _BLOCK // max(1, len(members)))
        for k in range(0, len(at), step):
            some = at[k : k + step]
            apart = _bits(queries[some][:, None, :] ^ points[members][None, :, :])
            i, j = np.nonzero(apart <= (1 if longer else 2))
            i, j = some[i], members[j]
            width = max(1, _BLOCK // letters.shape[1])
            for m in range(0, len(i), width):
                a, b = i[m : m + width], j[m : m + width]
                good = one_edit(asked[a], letters[b])
                yield a[good], b[good]


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows differ by one replaced letter, or, where ``b`` is one longer, by one inserted letter."""
    n = a.shape[1]
    if b.shape[1] == n:
        return (a != b).sum(axis=1) == 1
    none = np.zeros((len(a), 1), dtype=bool)
    front = np.append(a == b[:, :n], none, axis=1).argmin(axis=1)
    back = np.append((a == b[:, 1:])[:, ::-1], none, axis=1).argmin(axis=1)
    return front + back >= n


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (cell, role, word, n) sorted by cell and role: (word, near, near_n), both ways."""
    here, home, home_n = None, [], []
    built: tuple | None = None

    def out(left, left_n, right, right_n, pairs) -> Iterator[pa.RecordBatch]:
        for a, b in pairs:
            if not len(a):
                continue
            la, rb = pa.array(left).take(pa.array(a)), pa.array(right).take(pa.array(b))
            na, nb = np.asarray(left_n)[a], np.asarray(right_n)[b]
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([la, rb]), pa.concat_arrays([rb, la]), pa.array(np.concatenate([nb, na]))], names=["word", "near", "near_n"]
            )

    def build() -> Iterator[pa.RecordBatch]:
        nonlocal built
        letters = codes(home)
        points = unary(letters)
        tree = Tree(points, LEAF, tight=True)
        built = (points, tree, letters)
        inner = near_pairs(points, tree, letters, letters, False)
        yield from out(home, home_n, home, home_n, ((a[a < b], b[a < b]) for a, b in inner))

    for batch in batches:
        cell, role = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(cell):
            continue
        cuts = [0, *(np.flatnonzero((cell[1:] != cell[:-1]) | (role[1:] != role[:-1])) + 1).tolist(), len(cell)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if cell[a] != here:
                if home and built is None:
                    yield from build()
                here, home, home_n, built = cell[a], [], [], None
            strings, n = batch.column(2)[a:b].to_pylist(), batch.column(3)[a:b].to_pylist()
            if role[a] == 0:
                home += strings
                home_n += n
                continue
            if not home:
                continue
            if built is None:
                yield from build()
            yield from out(strings, n, home, home_n, near_pairs(*built, codes(strings), role[a] == 2))
    if home and built is None:
        yield from build()


# --- forms and roots


def group_variants(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root."""
    spark = docs.sparkSession
    found = settle(words(docs))
    lengths = dict(found.groupBy("length").agg(F.count(F.lit(1))).collect())  # one row per length
    sample = [r.word for r in found.select("word").orderBy(F.xxhash64("word"), "word").limit(SAMPLE).collect()]
    cells = spark.sparkContext.broadcast(Cells(sample, lengths))
    placed = found.mapInArrow(tidy(lambda b: _place(b, cells)), "cell bigint, role int, word string, n bigint")
    pairs = placed.repartition("cell").sortWithinPartitions("cell", "role").mapInArrow(tidy(_search), "word string, near string, near_n bigint")
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    judged = settle(
        found.join(best, "word", "left").withColumn("form_n", F.when(-F.col("best.less") >= RATIO * F.col("n"), -F.col("best.less")))
        .select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(F.col("form_n").isNotNull(), F.col("best.near")).alias("form"), "form_n",
        )
    )
    cells.unpersist()
    ends = judged.where("form IS NOT NULL").select("word", F.col("form").alias("end"))
    largest = judged.agg(F.max("n")).first()[0] or 1
    steps = 1  # a chain has at most log10(largest n) steps; each join doubles those taken
    while RATIO**steps <= largest:
        ends = settle(ends)
        on = ends.select(F.col("word").alias("end"), F.col("end").alias("_further"))
        ends = ends.join(on, "end", "left").select("word", F.coalesce("_further", "end").alias("end"))
        steps *= 2
    return judged.join(ends, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("end", "word").alias("root")
    )


SQL = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, v: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
d AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, run, count(*) AS n FROM r WHERE length(run) >= 7 GROUP BY ALL),
h AS (SELECT run, n, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(doc || ':' || run, ''),
        lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END))),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM d, crc),
f AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM f WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
i AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w),
m AS (SELECT word, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS k FROM i),
x AS (SELECT DISTINCT word, substr(word, 1, i - 1) || substr(word, i + 1) AS k FROM i),
e AS (SELECT a.word, b.word AS near FROM m a JOIN m b ON a.k = b.k AND a.word <> b.word
      UNION SELECT x.word, w.word FROM x JOIN w ON x.k = w.word UNION SELECT w.word, x.word FROM x JOIN w ON x.k = w.word),
b AS (SELECT e.word, count(*) AS n_near, min(ROW(-w.n, e.near)) AS best FROM e JOIN w ON w.word = e.near GROUP BY e.word),
j AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN -b.best[1] >= 10 * w.n THEN b.best[2] END AS form,
        CASE WHEN -b.best[1] >= 10 * w.n THEN -b.best[1] END AS form_n FROM w LEFT JOIN b USING (word)),
c AS (SELECT word, word AS root, form AS further FROM j UNION ALL SELECT c.word, c.further, j.form FROM c JOIN j ON j.word = c.further)
SELECT j.word, j.n, j.n_near, j.form, j.form_n, c.root FROM j JOIN c ON c.word = j.word AND c.further IS NULL
"""
