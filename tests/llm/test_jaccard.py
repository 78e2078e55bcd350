import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from loomgraph.llm import jaccard, linking
from loomgraph.llm.components import components
from loomgraph.session import settle


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", low) if x]
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and (100 * shared >= 75 * len(sets[i] | sets[j])) or (rows[i][0] == rows[j][0] and sets[i] and sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows))


def corpus(seed):
    """Copies, near copies around the threshold, chains, and passages that many texts share."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    boiler = [rng.choice(vocab) for _ in range(30)]
    rows = []
    for _ in range(40):
        base = [rng.choice(vocab) for _ in range(rng.choice([1, 3, 5, 7, 9, 12, 20, 40, 90, 200]))]
        if rng.random() < 0.4:
            base = boiler + base
        rows.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 2, 6])):
            near = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                near[rng.randrange(len(near))] = rng.choice(vocab)
            if rng.random() < 0.4:
                near += [rng.choice(vocab) for _ in range(rng.randrange(1, 8))]
            rows.append(" \n".join(near).upper() if rng.random() < 0.3 else " ".join(near))
    rng.shuffle(rows)
    return list(enumerate(rows, 10))


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    rows = corpus(seed) + [(3, None), (4, ""), (5, "one two"), (6, "One  two")]
    if seed == 3:
        rows += [(12, rows[9][1]), (12, rows[20][1]), (500, rows[20][1])]  # one id with several texts
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = sorted(map(tuple, jaccard.link_components(df).collect()))
    assert got == brute(rows)


def test_frequent_shingles_and_hubs(spark):
    """A large group of near copies beside texts that share its passage."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(150):
        near = list(base)
        for _ in range(2):
            near[rng.randrange(60)] = f"e{i}"
        rows.append((i, " ".join(near)))
    rows += [(1000 + i, " ".join(base[:30] + [f"o{i}x{j}" for j in range(60)])) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, jaccard.link_components(df).collect())) == brute(rows)


def test_large_group_around_the_threshold(spark):
    """2,000 near copies of which many pairs just link and many just miss."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(2000):
        near = list(base)
        for at in rng.sample(range(150), rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 8])):
            near[at] = f"e{i}x{at}"
        rows.append((i, " ".join(near)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    m = np.zeros((len(rows), 1 << 17), dtype=np.float32)
    number = {}
    for i, (_, t) in enumerate(rows):
        for s in shingles(t):
            m[i, number.setdefault(s, len(number))] = 1
    m = m[:, : len(number)]
    shared, size = m @ m.T, m.sum(1)
    near = 100 * shared >= 75 * (size[:, None] + size[None, :] - shared)
    label = np.arange(len(rows))
    while True:
        less = np.where(near, label[None, :], len(rows)).min(1)
        if (less == label).all():
            break
        label = less
    assert 10 < len(set(label.tolist())) < 1000
    got = {r.doc_id: r.component_id for r in jaccard.link_components(df).collect()}
    assert got == dict(enumerate(label.tolist()))


def test_stars_do_not_depend_on_batches():
    rng = np.random.default_rng(4)
    key = np.sort(rng.integers(0, 40, 400)) * 2
    n = rng.integers(4, 30, 400)
    pos = rng.integers(0, 3, 400)
    doc = rng.permutation(400)
    place = (n << 32) | pos
    order = np.lexsort((doc, place, key))
    key, doc, place = key[order], doc[order], place[order]

    def run(cuts):
        batches = [
            pa.RecordBatch.from_arrays([pa.array(x[a:b]) for x in (key, doc, place, doc)], names=["key", "doc", "place", "before"])
            for a, b in zip([0, *cuts], [*cuts, 400], strict=True)
        ]
        pairs, kept = Counter(), set()
        for out in jaccard._stars(iter(batches)):
            for k, a, b, c in zip(*(c.to_pylist() for c in out.columns), strict=True):
                if k is None:
                    pairs[a, b] += c
                else:
                    kept.add((k, a, b))
        return pairs, kept

    whole = run([])
    assert whole[0] and whole[1]
    for size in (1, 2, 3, 7, 50):
        assert run(list(range(size, 400, size))) == whole


def test_boundary_follows_cost():
    assert jaccard.boundary({5: 1000}) >= 5
    assert jaccard.boundary({128: 1000}) == 3
    assert jaccard.boundary({}) == 3


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.node: r.root for r in components(df, "a", "b").collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    assert got == {x: find(x) for x in parent}


def test_awkward_rows(awkward, nothing):
    out = jaccard.link_components(awkward).collect()
    assert len(out) == 8
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in out} >= {(1, 0, 1), (2, 0, 2), (3, 0, 3), (5, 1, 5), (None, 1, None), (6, 1, 6)}
    assert jaccard.link_components(nothing).count() == 0
    kept = jaccard.keep_one(awkward)
    # both texts "one two" without doc_id or with a repeated one are copies of document 5
    assert kept.columns == awkward.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [1, 2, 3, 4, 5, 6]
    clashing = awkward.selectExpr("*", "1 AS row_key", "2 AS gone", "3 AS rank", "4 AS _gone", "5 AS _doc")
    assert jaccard.keep_one(clashing).columns == clashing.columns and jaccard.keep_one(clashing).count() == 6


def test_rows_without_or_with_repeated_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(None, a), (None, a), (None, b), (7, b), (7, b), (7, ""), (None, None), (None, "c d"), (9, a + " more")]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    want = [(9, a + " more"), (7, b), (7, ""), (None, None), (None, "c d")]
    assert sorted(map(repr, kept)) == sorted(repr(type(kept[0])(doc_id=d, text=t)) for d, t in want)


def test_few_edges_are_joined_without_rounds(spark, monkeypatch):
    edges = [(i + 1, i) for i in range(60)] + [(100, 101), (101, 100), (105, 101), (7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    spark.sparkContext.setJobGroup("few-edges", "")
    got = {r.node: r.root for r in components(df, "a", "b").collect()}
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("few-edges")
    spark.sparkContext.setJobGroup("", "")
    assert got == dict.fromkeys(range(61), 0) | dict.fromkeys([100, 101, 105], 100)
    assert len(jobs) < 12  # each round takes more than that
    monkeypatch.setattr("loomgraph.llm.components.EDGES_PER_TASK", 20)
    assert {r.node: r.root for r in components(df, "a", "b").collect()} == got


def test_split_keys_deals_rows_by_key_once(spark, monkeypatch):
    rows = [(k, d, (8 << 32) + (d % 5), 0) for k in range(20) for d in range(k, k + 1 + k % 7)]
    df = spark.createDataFrame(rows, "key bigint, doc bigint, place bigint, before bigint")
    texts = spark.createDataFrame([], "doc_id bigint, text string")
    linker = linking.Linker(texts, spark.createDataFrame([(0, 1), (1, 2), (4, 5), (5, 6)], "a bigint, b bigint"), 5, 75, jaccard._fits)
    root = {0: 0, 1: 0, 2: 0, 4: 4, 5: 4, 6: 4}
    plans = []
    monkeypatch.setattr(linking, "settle", lambda d: plans.append(d._jdf.queryExecution().executedPlan().toString()) or settle(d))
    got = {(r.key, r.doc): (r.root, r._top, tuple(r._rep)) for r in linker.split_keys(df).collect()}
    assert sum(p.count("Exchange hashpartitioning(key") for p in plans) == 1
    wanted = set()
    for k in range(20):
        held = {}
        for _, d, place, _ in (r for r in rows if r[0] == k):
            held.setdefault(root.get(d, d), []).append((d, place))
        if len(held) < 2:
            continue
        top = max(held, key=lambda r: (len(held[r]), r))
        least = min(p & 0xFFFFFFFF for _, p in held[top])
        for r, members in held.items():
            for d, _ in members:
                wanted.add((k, d))
                assert got[k, d][:2] == (r, top)
                assert got[k, d][2] in held[top] and got[k, d][2][1] & 0xFFFFFFFF == least
    assert set(got) == wanted
