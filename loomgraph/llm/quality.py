"""Quality rules with thresholds that adapt to language and source.

Method: per-document measures are collected in mergeable quantile sketches, one
per (language, source) and measure; sketches of thin groups give way to the
merged sketch of their language, then of the corpus; a document is kept if all
its measures lie inside the fences its sketch gives, found by a join.

The sketch is a log-linear histogram (``bucket_of``): integers below 64 have a
bucket each, larger ones 32 buckets per power of two, so a quantile is off by
at most 1/32 of its value.  A sketch is rows (group, measure, bucket, count):
partial counts are combined before the shuffle, merging is a sum, the result
does not depend on order, and a hot source costs no more than a cold one.

Everything is DataFrame expressions; no Python runs on the executors.

Defined cases: a null or blank text has no words and fails the base rule; null
language or source is a group of its own; rows that repeat a doc_id are judged
row by row; a very long text is read whole, in one task; an empty table gives an
empty result.  In measures and verdicts columns of the input with
the name of a result column are replaced; ``keep_good`` keeps whatever columns there are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.session import settle

SPACES = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Fence:
    """Bounds q25 - reach * iqr - slack and q75 + reach * iqr + slack, in the measure's integer unit."""

    measure: str
    slack: int
    reach: int = 3
    low: bool = False


FENCES = (
    Fence("symbols_per_mille", 100),
    Fence("repeats_per_mille", 250),
    Fence("dup_lines_per_mille", 400),
    Fence("mean_word_centis", 60, low=True),
)
MIN_DOCS = 200
PACKED = 4096
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def bucket_of(v: Column) -> Column:
    shift = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return F.when(v < 64, v).otherwise(shift * 32 + F.call_function("shiftright", v, shift)).cast("int")


def bucket_floor(b: Column) -> Column:
    shift = F.greatest(F.floor(b / 32).cast("int") - 1, F.lit(0))
    return F.when(b < 64, b.cast("bigint")).otherwise(
        F.call_function("shiftleft", (F.lit(32) + b % 32).cast("bigint"), shift)
    )


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts of ``MEASURES`` and ``n_lines``.

    Repeated three-word windows are found inside the row: a sort by hash brings
    equal windows together.  Up to ``PACKED`` words a window is one long, its hash
    in the high 51 bits or more and its position in the low ones, which sorts fast;
    longer texts sort structs of the whole 64-bit hash and the position.
    """
    clean = F.coalesce(F.col(text), F.lit(""))
    first = docs.drop(*(c for c in docs.columns if c.lower() in {*MEASURES, "n_lines"}))
    staged = first.withColumns(
        {
            "_words": F.array_remove(F.split(clean, SPACES), ""),
            "_lines": F.filter(F.split(clean, "\n"), lambda x: x.rlike(NOT_SPACE)),
            "n_symbols": F.regexp_count(clean, F.lit(SYMBOLS)).cast("bigint"),
        }
    )
    staged = staged.withColumns(
        {
            "n_words": F.size("_words").cast("bigint"),
            "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
            "n_lines": F.size("_lines").cast("bigint"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
            "_h": F.transform("_words", lambda w: F.xxhash64(w)),
            "_bits": F.length(F.bin(F.size("_words").cast("bigint"))),
        }
    ).drop("_words", "_lines")
    window = "xxhash64(h, get(_h, i + 1), get(_h, i + 2))"
    over = "transform(slice(_h, 1, greatest(size(_h) - 2, 0)), (h, i) ->"
    long = F.size("_h") > PACKED
    staged = staged.withColumns(
        {
            "_w": F.when(~long, F.sort_array(F.expr(f"{over} shiftleft({window}, _bits) | cast(i as bigint))"))),
            "_s": F.when(long, F.sort_array(F.expr(f"{over} struct({window} AS k, cast(i as bigint) AS p))"))),
        }
    ).drop("_h")
    packed = F.expr(
        """sort_array(transform(
             filter(_w, (x, j) -> shiftright(x, _bits) <=> shiftright(get(_w, j - 1), _bits)
                               or shiftright(x, _bits) <=> shiftright(get(_w, j + 1), _bits)),
             x -> x & (shiftleft(1L, _bits) - 1)))"""
    )
    whole = F.expr(
        "sort_array(transform(filter(_s, (x, j) -> x.k <=> get(_s, j - 1).k or x.k <=> get(_s, j + 1).k), x -> x.p))"
    )
    staged = staged.withColumn("_p", F.coalesce(packed, whole)).drop("_w", "_s", "_bits")
    covered = F.expr(
        """aggregate(transform(_p, (p, k) -> coalesce(least(get(_p, k + 1) - p, 3L), 3L)), 0L, (s, x) -> s + x)"""
    )
    done = staged.withColumn("n_repeat_words", covered).drop("_p")
    return done.withColumn(
        "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    )


def _measures() -> Column:
    """One array of (measure, value); only for rows with words."""
    n = F.col("n_words")
    values = {
        "symbols_per_mille": F.floor(1000 * F.col("n_symbols") / n),
        "repeats_per_mille": F.floor(1000 * F.col("n_repeat_words") / n),
        "dup_lines_per_mille": F.floor(1000 * F.col("n_dup_lines") / F.col("n_lines")),
        "mean_word_centis": F.floor(100 * F.col("word_chars") / n),
    }
    return F.array(
        *(F.struct(F.lit(f.measure).alias("measure"), values[f.measure].alias("value")) for f in FENCES)
    )


def sketches(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Rows (lang, source, measure, bucket, n) over the documents that pass the base rule."""
    return (
        measured.where(~F.col("base_failed"))
        .select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.explode(_measures()).alias("m"))
        .groupBy("lang", "source", F.col("m.measure").alias("measure"), bucket_of(F.col("m.value")).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def merged(sketch: DataFrame, *keys: str) -> DataFrame:
    """Sketches of coarser groups."""
    return sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """(keys, measure, docs, q25, q75): the lowest bucket that holds at least that share of the documents.

    The window runs over the buckets of one sketch, of which there are at most
    about 1,900 however many documents it counts.
    """
    group = Window.partitionBy(*keys, "measure")
    seen = sketch.withColumn("_c", F.sum("n").over(group.orderBy("bucket"))).withColumn("_n", F.sum("n").over(group))
    at = lambda q: F.min(F.when(F.col("_c") * 100 >= F.col("_n") * q, F.col("bucket")))
    return seen.groupBy(*keys, "measure").agg(
        F.max("_n").alias("docs"), bucket_floor(at(25)).alias("q25"), bucket_floor(at(75)).alias("q75")
    )


def thresholds(sketch: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Per (lang, source): one row with the fences of every measure.

    ``min_docs`` documents are wanted in a sketch; otherwise the language's, then
    the corpus' sketch is taken.
    """
    own = quartiles(sketch, "lang", "source")
    tongue = quartiles(merged(sketch, "lang"), "lang").select(
        F.col("lang").alias("_l"), F.col("measure").alias("_m"), F.struct("docs", "q25", "q75").alias("_tongue")
    )
    corpus = quartiles(merged(sketch)).select(
        F.col("measure").alias("_a"), F.struct("docs", "q25", "q75").alias("_corpus")
    )
    joined = own.join(tongue, F.col("lang").eqNullSafe(F.col("_l")) & (F.col("measure") == F.col("_m"))).join(
        corpus, F.col("measure") == F.col("_a")
    )
    q = (
        F.when(F.col("docs") >= min_docs, F.struct("docs", "q25", "q75"))
        .when(F.col("_tongue.docs") >= min_docs, F.col("_tongue"))
        .otherwise(F.col("_corpus"))
    )
    joined = joined.select("lang", "source", "measure", q.alias("q"))
    fences = []
    for f in FENCES:
        of = lambda c, f=f: F.max(F.when(F.col("measure") == f.measure, F.col(c)))
        reach = f.reach * (of("q.q75") - of("q.q25")) + f.slack
        fences.append((of("q.q75") + reach).alias(f"_hi_{f.measure}"))
        if f.low:
            fences.append((of("q.q25") - reach).alias(f"_lo_{f.measure}"))
    return joined.groupBy(F.col("lang").alias("_lang"), F.col("source").alias("_source")).agg(*fences)


def judge(measured: DataFrame, lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS) -> DataFrame:
    """``measured`` with ``kept``.  ``measured`` is read twice: give a stored frame.

    The thresholds are stored first, so the planner knows their size: they are
    broadcast if that is below the session's threshold, joined by shuffle with
    AQE's skew handling otherwise.
    """
    fences = settle(thresholds(sketches(measured, lang, source), min_docs))
    joined = measured.drop("kept").join(
        fences, F.col(lang).eqNullSafe(F.col("_lang")) & F.col(source).eqNullSafe(F.col("_source")), "left"
    )
    n = F.when(F.col("n_words") > 0, F.col("n_words"))
    lines = F.when(F.col("n_lines") > 0, F.col("n_lines"))
    inside = (
        (F.floor(1000 * F.col("n_symbols") / n) <= F.col("_hi_symbols_per_mille"))
        & (F.floor(1000 * F.col("n_repeat_words") / n) <= F.col("_hi_repeats_per_mille"))
        & (F.floor(1000 * F.col("n_dup_lines") / lines) <= F.col("_hi_dup_lines_per_mille"))
        & F.floor(100 * F.col("word_chars") / n).between(
            F.col("_lo_mean_word_centis"), F.col("_hi_mean_word_centis")
        )
    )
    kept = F.when(F.col("base_failed"), False).otherwise(F.coalesce(inside, F.lit(False)))
    return joined.withColumn("kept", kept).drop(*(c for c in joined.columns if c.startswith(("_hi_", "_lo_"))), "_lang", "_source")


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, the measures, base_failed and kept for every row."""
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    measured = settle(
        with_measures(docs.select("doc_id", "lang", "source", "text")).drop("text")
    )
    return judge(measured).select(*columns)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with its columns."""
    aside = {c: f"own_{k}" for k, c in enumerate(docs.columns)}
    low = {c.lower(): name for c, name in aside.items()}
    measured = with_measures(docs.toDF(*aside.values()), text=low["text"])
    kept = judge(settle(measured), lang=low["lang"], source=low["source"]).where("kept")
    return kept.select(*(F.col(name).alias(c) for c, name in aside.items()))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
f AS (SELECT rid, doc_id, lang, source, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
tri AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM f WHERE len(ws) >= 3)),
rep AS (SELECT rid, i FROM tri QUALIFY count(*) OVER (PARTITION BY rid, k) > 1),
cov AS (SELECT rid, count(DISTINCT i + s) AS n FROM rep, (VALUES (0), (1), (2)) v(s) GROUP BY rid),
m AS (SELECT f.rid, doc_id, lang, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, n_symbols,
        len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
        FROM f LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        1000 * n_symbols // greatest(n_words, 1) AS v1, 1000 * n_repeat_words // greatest(n_words, 1) AS v2,
        1000 * n_dup_lines // greatest(n_lines, 1) AS v3, 100 * word_chars // greatest(n_words, 1) AS v4 FROM m),
v AS (SELECT lang, source, 1 AS k, v1 AS v FROM b WHERE NOT base_failed UNION ALL
      SELECT lang, source, 2, v2 FROM b WHERE NOT base_failed UNION ALL
      SELECT lang, source, 3, v3 FROM b WHERE NOT base_failed UNION ALL
      SELECT lang, source, 4, v4 FROM b WHERE NOT base_failed),
h AS (SELECT lang, source, k, CASE WHEN v < 64 THEN v ELSE (v >> (length(bin(v)) - 6)) << (length(bin(v)) - 6) END AS v FROM v),
q3 AS (SELECT lang, source, k, count(*) AS docs, quantile_disc(v, 0.25) AS q25, quantile_disc(v, 0.75) AS q75 FROM h GROUP BY ALL),
q2 AS (SELECT lang, k, count(*) AS docs, quantile_disc(v, 0.25) AS q25, quantile_disc(v, 0.75) AS q75 FROM h GROUP BY ALL),
q1 AS (SELECT k, count(*) AS docs, quantile_disc(v, 0.25) AS q25, quantile_disc(v, 0.75) AS q75 FROM h GROUP BY ALL),
q AS (SELECT q3.lang, q3.source, q3.k,
        CASE WHEN q3.docs >= 200 THEN q3.q25 WHEN q2.docs >= 200 THEN q2.q25 ELSE q1.q25 END AS q25,
        CASE WHEN q3.docs >= 200 THEN q3.q75 WHEN q2.docs >= 200 THEN q2.q75 ELSE q1.q75 END AS q75
      FROM q3 JOIN q2 ON q3.lang IS NOT DISTINCT FROM q2.lang AND q3.k = q2.k JOIN q1 ON q3.k = q1.k),
t AS (SELECT lang, source, max(CASE WHEN k = 1 THEN q75 + 3 * (q75 - q25) + 100 END) AS h1,
        max(CASE WHEN k = 2 THEN q75 + 3 * (q75 - q25) + 250 END) AS h2,
        max(CASE WHEN k = 3 THEN q75 + 3 * (q75 - q25) + 400 END) AS h3,
        max(CASE WHEN k = 4 THEN q75 + 3 * (q75 - q25) + 60 END) AS h4,
        min(CASE WHEN k = 4 THEN q25 - 3 * (q75 - q25) - 60 END) AS l4 FROM q GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(v1 <= h1 AND v2 <= h2 AND v3 <= h3 AND v4 BETWEEN l4 AND h4, false) AS kept
FROM b LEFT JOIN t ON b.lang IS NOT DISTINCT FROM t.lang AND b.source IS NOT DISTINCT FROM t.source
"""
