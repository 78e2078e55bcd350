from collections import Counter

from pyspark.sql import functions as F

from loomgraph.llm import quality


def test_buckets_keep_order_and_error(spark):
    values = [*range(0, 300), 1_000, 12_345, 999_999, 2**40 + 7]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    b = quality.bucket_of(F.col("v"))
    rows = df.select("v", b.alias("b"), quality.bucket_floor(b).alias("f")).orderBy("v").collect()
    assert [r.b for r in rows] == sorted(r.b for r in rows)
    assert all(r.f <= r.v <= r.f * 33 / 32 + 1 for r in rows)


def test_sketches_merge(spark):
    rows = [(lang, src, i) for lang in ("en", "de") for src in "ab" for i in range(50)]
    docs = spark.createDataFrame(
        [(n, " ".join(f"w{i}{n}{j}" for j in range(60)) + " #" * (i % 7), lang, src) for n, (lang, src, i) in enumerate(rows)],
        "doc_id bigint, text string, lang string, source string",
    )
    fine = quality.sketches(quality.with_measures(docs))
    merged = {tuple(r) for r in quality.merged(fine, "lang").collect()}
    direct = {
        tuple(r) for r in fine.groupBy("lang", "measure", "bucket").agg(F.sum("n").alias("n")).collect()
    }
    assert merged == direct
    assert sum(n for _, m, _, n in merged if m == "symbols_per_mille") == len(rows)


def test_awkward_rows(awkward, nothing):
    out = quality.verdicts(awkward).collect()
    assert len(out) == 8 and all(r.base_failed and not r.kept for r in out)
    by_id = {r.doc_id: r for r in out}
    assert by_id[1].n_words == by_id[2].n_words == by_id[3].n_words == 0
    assert by_id[4].n_words == by_id[4].n_repeat_words + 1 == 60_001
    assert by_id[6].word_chars == 100_000
    assert quality.verdicts(nothing).count() == 0
    assert quality.keep_good(awkward).columns == awkward.columns
    clashing = awkward.selectExpr("*", "1 AS _p", "2 AS _hi_x", "3 AS _lang", "4 AS own_1", "5 AS _words", "6 AS base_failed", "7 AS _w")
    assert quality.keep_good(clashing).columns == clashing.columns and quality.keep_good(clashing).count() == 0


def test_repeats_by_brute_force(spark):
    import random

    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcd") for _ in range(n)) for n in range(0, 80)]
    texts += [" ".join(str(rng.randrange(30)) for _ in range(n)) for n in (4095, 4096, 4097, 9000)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string")
    got = {r.doc_id: r.n_repeat_words for r in quality.with_measures(docs).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {k + s for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for s in range(3)}
        assert got[i] == len(hit)


def test_a_junk_document_leaves_a_clean_source(spark):
    clean = [(i, " ".join(f"w{100 + i}x{100 + j}" for j in range(80)), "en", "s") for i in range(60)]
    junk = [(99, " ".join(f"w{100 + j}###x" for j in range(80)), "en", "s")]
    docs = spark.createDataFrame(clean + junk, "doc_id bigint, text string, lang string, source string")
    kept = {r.doc_id for r in quality.keep_good(docs).collect()}
    assert kept == set(range(60))
