import random
import re
from collections import Counter, defaultdict

import numpy as np

from loomgraph.llm import divergence


def brute(rows, min_docs):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = re.findall("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)
        share = {}
        for key in [*((lang, s) for s in sources), (lang, None)]:
            c = counts[key] if key[1] is not None else sum((counts[lang, s] for s in sources), Counter())
            total = sum(c[t] for t in kept)
            share[key] = {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in sources:
            mine = share[lang, s]
            pairs = [(sum(f(mine[t], share[lang, o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(mine[t], share[lang, None][t]), t) for t in kept if counts[lang, s][t] and mine[t] > share[lang, None][t]]
            for part, found, top in (("pair", pairs, None), ("term", terms, 10)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:top]
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def got(df, min_docs):
    out = divergence.audit(df, min_docs)
    return sorted((r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in out.collect())


def corpus(seed, sources):
    rng = random.Random(seed)
    vocab = [f"{a}{b}é" if rng.random() < 0.2 else f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    rows = []
    for i in range(250):
        words = [vocab[min(int(rng.expovariate(0.05)), len(vocab) - 1)] for _ in range(rng.randrange(1, 60))]
        rows.append((rng.choice([" ", ",", "1"]).join(rng.choice([w, w.upper()]) for w in words), rng.choice(["en", "de", None]), rng.choice(sources)))
    return rows + [(None, "xx", "a"), ("", "xx", "b"), ("one", "xx", None), ("x", "en", "lonely"), (None, None, "empty")]


def test_against_brute_force(spark):
    rows = corpus(1, ["a", "b", "c", "d", None])
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    for min_docs in (1, 4):
        assert got(df, min_docs) == brute(rows, min_docs)


def test_blocks_and_buckets(spark, monkeypatch):
    """Small blocks, several buckets of a language, rows cut into small batches, flushes while counting."""
    monkeypatch.setattr(divergence, "BUCKET", 300)
    monkeypatch.setattr(divergence, "HELD", 500)
    rows = corpus(2, [f"s{i}" for i in range(9)])
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        assert got(df, 2) == brute(rows, 2)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_products_do_not_depend_on_blocks(monkeypatch):
    rng = np.random.default_rng(5)
    held = sorted({(int(t), int(g)) for t, g in zip(rng.integers(0, 200, 1500), rng.integers(0, 12, 1500))})
    term = np.unique([t for t, _ in held], return_inverse=True)[1]
    gid = np.array([g for _, g in held])
    p = rng.integers(2, 40, len(held)) * 1_000_003
    zero = rng.integers(1, 100, 12) * 1009
    want = np.zeros((12, 12), dtype=np.int64)
    dense = np.tile(zero, (int(term.max()) + 1, 1))
    dense[term, gid] = p
    for a in range(12):
        for b in range(a + 1, 12):
            want[a, b] = ((dense[:, a] - dense[:, b]) ** 2 // (dense[:, a] + dense[:, b])).sum()
    for columns, least in ((512, 32), (20, 1), (40, 16), (5, 2)):
        monkeypatch.setattr(divergence, "COLUMNS", columns)
        monkeypatch.setattr(divergence, "LEAST_TERMS", least)
        acc = np.zeros((12, 12), dtype=np.int64)
        divergence.joint_values(term, gid, p, zero, acc)
        assert (acc == want).all()


def test_awkward_rows(spark, awkward, nothing):
    rows = [(r.text, r.lang, r.source) for r in awkward.collect()]
    assert got(awkward, 1) == brute(rows, 1)
    assert got(awkward, 2) == brute(rows, 2)
    assert divergence.audit(nothing).count() == 0
    clashing = awkward.selectExpr("*", "1 AS value", "2 AS rank", "3 AS gid", "4 AS term", "5 AS n", "6 AS item")
    assert got(clashing, 1) == brute(rows, 1)


def test_shares_beyond_64_bits(spark):
    df = spark.createDataFrame([(9 * 10**15, 10**16, 7)], "c bigint, n bigint, v bigint")
    from pyspark.sql import functions as F

    assert df.select(divergence.share(F.col("c"), F.col("n"), F.col("v"))).first()[0] == 1 + 10**9 * (9 * 10**15 + 2) // (10**16 + 14)
