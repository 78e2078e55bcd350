"""Finding entity names in text."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomgraph.functions.lists import distinct
from loomgraph.functions.plan import bounded_rows, spread
from loomgraph.graph import PropertyGraph, union_all
from loomgraph.operators.ranking import longest_match
from loomgraph.session import settle, tidy

MAX_DICTIONARY_ROWS = 50_000
MAX_DICTIONARY_CHARS = 20_000_000
GRAMS = (8, 4, 2, 1)
GRAM_BLOCK = 1 << 20
FILTER_BITS = 1 << 27


def entity_dictionary(g: PropertyGraph, labels: Sequence[str] | None = None) -> DataFrame:
    """Distinct (name, label) of named nodes."""
    frames = [
        g.nodes(label).where("name IS NOT NULL AND name <> ''").select("name", F.lit(label).alias("label"))
        for label in labels or g.labels
    ]
    return union_all(frames).distinct()


def _finder(names: Sequence[str]):
    """``text -> [(position in names, first start)]``."""
    automaton = ahocorasick.Automaton()
    for i, name in enumerate(names):
        automaton.add_word(name, (i, len(name)))
    if not names:
        return lambda text: ()
    automaton.make_automaton()

    def find(text: str):
        first: dict[int, int] = {}
        for end, (i, size) in automaton.iter(text):
            first.setdefault(i, end - size + 1)
        return first.items()

    return find


def match_small(texts: DataFrame, keys: Sequence[str], folded: Sequence[str]) -> DataFrame:
    """(keys, folded, char_start) for a dictionary held by every task.

    ``texts`` has the key columns and ``_t``; one pass over each text finds all
    names at once.
    """
    names = texts.sparkSession.sparkContext.broadcast(list(folded))
    schema = T.StructType(
        [texts.schema[k] for k in keys]
        + [T.StructField("_f", T.StringType()), T.StructField("char_start", T.IntegerType())]
    )

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = names.value
        find = _finder(words)
        for batch in batches:
            rows = [
                (*key, words[i], start)
                for *key, text in batch[[*keys, "_t"]].itertuples(index=False, name=None)
                if text
                for i, start in find(text)
            ]
            yield pd.DataFrame(rows, columns=schema.names)

    return texts.select(*keys, "_t").mapInPandas(scan, schema)


def gram_hashes(text: str, n: int) -> np.ndarray:
    """One 64-bit hash per distinct n-gram of a text, ascending."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    found = []
    for start in range(0, len(points) - n + 1, GRAM_BLOCK):
        part = points[start : start + GRAM_BLOCK + n - 1].astype(np.uint64)
        size = len(part) - n + 1
        h = np.full(size, n, np.uint64)
        for i in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + part[i : i + size]
        # the high bits choose a filter's bit: all bits of a hash have to depend on all of the gram
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        found.append(distinct(h ^ (h >> np.uint64(31))))
    return found[0] if len(found) == 1 else distinct(np.concatenate([np.empty(0, np.uint64), *found]))


class HashFilter:
    """Which hashes a frame may have: one bit per hash, at most ``FILTER_BITS`` of them.

    The bits are set on the executors and meet on the driver in pages of 4 KB,
    so neither side holds more than the filter however large the frame is; a
    frame of more rows only lets more foreign hashes pass.
    """

    def __init__(self, df: DataFrame, column: str, rows: int) -> None:
        self.shift = 64 - min(max((16 * rows).bit_length(), 22), FILTER_BITS.bit_length() - 1)
        at = F.shiftrightunsigned(column, self.shift)
        pages = df.groupBy(F.shiftright(at, 15).alias("p")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(32767))).alias("b"))
        bits = np.zeros((1 << (64 - self.shift)) // 8, np.uint8)
        for p, b in pages.where("p IS NOT NULL").toLocalIterator():
            bits[p * 4096 : (p + 1) * 4096] = np.frombuffer(b, np.uint8)
        self.bits = df.sparkSession.sparkContext.broadcast(bits)

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(self.shift)
        return (self.bits.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def _grams(df: DataFrame, keys: Sequence[str], text: str, n: int, known: HashFilter | None = None) -> DataFrame:
    """(keys, _g): hashes of the distinct n-grams of every text, only those ``known`` may have."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            picked, hashes, size = [], [], 0
            for i, body in enumerate(batch.column(len(keys))):
                h = gram_hashes(body.as_py() or "", n)
                h = h if known is None else h[known.passes(h)]
                picked.append(np.full(len(h), i, np.int64))
                hashes.append(h)
                size += len(h)
                if size >= GRAM_BLOCK or i + 1 == batch.num_rows:
                    rows = batch.select(range(len(keys))).take(pa.array(np.concatenate(picked)))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.concatenate(hashes).view(np.int64))], schema.names)
                    picked, hashes, size = [], [], 0

    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("_g", T.LongType())])
    return df.select(*keys, text).mapInArrow(tidy(scan), schema)


def _holders(texts: DataFrame, keys: Sequence[str], known: HashFilter) -> DataFrame:
    """The texts whose keys ``known`` may have."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).view(np.uint64)
            yield batch.select(range(batch.num_columns - 1)).filter(pa.array(known.passes(hashes)))

    kept = texts.select(*keys, "_t")
    return kept.withColumn("_h", F.xxhash64(*keys)).mapInArrow(tidy(scan), kept.schema)


def match_large(texts: DataFrame, keys: Sequence[str], folded: DataFrame) -> DataFrame:
    """The same for a dictionary of any size (``folded`` has column ``_f``).

    Each name is represented by its rarest n-gram among the dictionary; texts
    and names meet on that gram's hash and candidates are verified.  Name length
    picks n, so short names are found as well.  A text sends only grams that may
    represent a name, and only texts with candidates are moved to be verified.
    Names compress so well that a planner takes them for small; merge joins keep
    them off the driver.
    """
    length = F.length("_f")
    gram_size = F.lit(GRAMS[-1])
    for n in reversed(GRAMS):
        gram_size = F.when(length >= n, n).otherwise(gram_size)
    # one row per gram size
    names_of = {r["n"]: r["names"] for r in folded.groupBy(gram_size.alias("n")).agg(F.count(F.lit(1)).alias("names")).collect()}
    frames = []
    for n, count in sorted(names_of.items()):
        grams = _grams(folded.where(gram_size == n), ["_f"], "_f", n)
        frequency = grams.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
        anchors = settle(
            grams.join(frequency.hint("merge"), "_g").groupBy("_f").agg(F.min_by("_g", F.struct("_n", "_g")).alias("_g"))
        )
        seen = _grams(texts, keys, "_t", n, HashFilter(anchors, "_g", count))
        frames.append(seen.join(anchors.hint("merge"), "_g").select(*keys, "_f"))
    if not frames:
        return texts.select(*keys, F.col("_t").alias("_f"), F.lit(0).alias("char_start")).limit(0)
    candidates = settle(union_all(frames).distinct().withColumn("_h", F.xxhash64(*keys)))
    holders = _holders(texts, keys, HashFilter(candidates, "_h", candidates.count()))
    verified = candidates.drop("_h").join(holders.hint("merge"), list(keys)).withColumn(
        "char_start", (F.expr("position(_f, _t)") - 1).cast("int")
    )
    return verified.where("char_start >= 0").select(*keys, "_f", "char_start")


def match_dictionary(
    texts: DataFrame,
    keys: Sequence[str],
    text: str,
    names: DataFrame,
    ignore_case: bool = True,
    max_rows: int = MAX_DICTIONARY_ROWS,
) -> DataFrame:
    """First occurrence of every dictionary name in every text.

    Rows: the keys, name, label, char_start, char_end.  A dictionary of at most
    ``max_rows`` names and a bounded number of characters is sent to the tasks;
    a larger one is joined.
    """

    def fold(col: Column) -> Column:
        return F.lower(col) if ignore_case else col

    bodies = spread(texts.select(*keys, text), *keys).select(*keys, fold(F.col(text)).alias("_t"))
    folded = names.select(fold(F.col("name")).alias("_f")).where("_f <> ''").distinct()
    size = folded.limit(max_rows + 1).agg(F.count("_f").alias("n"), F.sum(F.length("_f")).alias("c")).first()
    if size["n"] <= max_rows and (size["c"] or 0) <= MAX_DICTIONARY_CHARS:
        words = sorted(r["_f"] for r in bounded_rows(folded, max_rows) or [])
        hits = match_small(bodies, keys, words)
        large = False
    else:
        hits = match_large(bodies, keys, folded)
        large = True
    spelled = names.select("name", "label", fold(F.col("name")).alias("_f")).distinct()
    if large:
        spelled = spelled.hint("merge")
    return hits.join(spelled, "_f").select(
        *keys, "name", "label", "char_start", (F.col("char_start") + F.length("name")).alias("char_end")
    )


def mentions(
    chunks: DataFrame, keys: Sequence[str], names: DataFrame, text: str = "text", limit: int | None = None
) -> DataFrame:
    """The entities of every text in order of first position; with ``limit`` only so many."""
    hits = match_dictionary(chunks, keys, text, names)
    # order among equal positions: label, longer name first
    order = [F.asc("char_start"), F.asc("label"), F.desc(F.length("name")), F.asc("name")]
    placed = hits.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    if limit is not None:
        placed = placed.where(F.col("position") <= limit)
    return placed.select(
        *keys,
        "name",
        "label",
        F.lit(1.0).alias("confidence"),
        F.lit("kg_match").alias("source"),
        "char_start",
        "char_end",
        "position",
    )


def link_documents(
    documents: DataFrame, chunks: DataFrame, found: DataFrame, threshold: float = 0.5
) -> dict[str, DataFrame]:
    """Document and Chunk nodes, HAS_CHUNK and MENTIONS edges.

    ``documents``: doc_id, filename, file_type.  ``chunks``: doc_id,
    chunk_index, text.  ``found``: doc_id, chunk_index, name, label,
    confidence, source.
    """
    ref = F.concat_ws(":", "doc_id", "chunk_index")
    sure = found.where(F.col("confidence") >= threshold)
    return {
        "Document": documents.select(F.col("doc_id").alias("id"), "filename", "file_type").dropDuplicates(["id"]),
        "Chunk": chunks.select(
            ref.alias("id"), "doc_id", "chunk_index", "text", F.left("text", F.lit(200)).alias("text_preview")
        ).dropDuplicates(["id"]),
        "HAS_CHUNK": chunks.select(F.col("doc_id").alias("src"), ref.alias("dst")).distinct(),
        "MENTIONS": sure.select(
            ref.alias("src"), "name", "label", "confidence", "source"
        ).dropDuplicates(["src", "name", "label"]),
    }


def entities_per_document(found: DataFrame, threshold: float = 0.5) -> DataFrame:
    sure = found.where(F.col("confidence") >= threshold)
    return sure.select("doc_id", "name", "label").distinct().groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("entities")
    )


def question_entities(
    questions: DataFrame, key: str, text: str, names: DataFrame, label_order: Sequence[str]
) -> DataFrame:
    """The main entity of every question: first label with a hit, longest name. Case-sensitive."""
    hits = match_dictionary(questions, [key], text, names, ignore_case=False)
    rank = F.array_position(F.array(*map(F.lit, label_order)), F.col("label"))
    return longest_match(hits.where(rank > 0), key, rank)
