import random
import re

import numpy as np
import pyarrow as pa
import pytest

from loomgraph.llm import minhash


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
    if len(w) < 3:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


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
            if shared and (100 * shared >= 85 * len(sets[i] | sets[j])) or (rows[i][0] == rows[j][0] and sets[i] and sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    found = [(d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)]
    return sorted((d, n, c, d == c) for d, n, c in found)


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    boiler = [rng.choice(vocab) for _ in range(30)]
    rows = []
    for _ in range(40):
        base = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 5, 9, 20, 40, 90, 200]))]
        if rng.random() < 0.4:
            base = boiler + base
        rows.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 2, 6])):
            near = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                near[rng.randrange(len(near))] = rng.choice(vocab)
            rows.append(" \n".join(near).upper() if rng.random() < 0.3 else " ".join(near))
    rng.shuffle(rows)
    return list(enumerate(rows, 10))


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rows = corpus(seed) + [(3, None), (4, ""), (5, "one two"), (6, "One  two")]
    if seed == 2:
        rows += [(12, rows[9][1]), (12, rows[20][1]), (500, rows[20][1])]  # one id with several texts
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert sorted(map(tuple, minhash.kept_documents(df).collect())) == brute(rows)


def test_large_group_around_the_threshold(spark):
    """Near copies of which many pairs just link and many just miss."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(1200):
        near = list(base)
        for at in rng.sample(range(150), rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 8])):
            near[at] = f"e{i}x{at}"
        rows.append((i, " ".join(near)))
    number = {}
    m = np.zeros((len(rows), 1 << 16), dtype=np.float32)
    for i, (_, t) in enumerate(rows):
        for s in shingles(t):
            m[i, number.setdefault(s, len(number))] = 1
    shared, size = m @ m.T, m.sum(1)
    near = 100 * shared >= 85 * (size[:, None] + size[None, :] - shared)
    label = np.arange(len(rows))
    while True:
        less = np.where(near, label[None, :], len(rows)).min(1)
        if (less == label).all():
            break
        label = less
    assert 10 < len(set(label.tolist())) < 800
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in minhash.link_components(df).collect()}
    assert got == dict(enumerate(label.tolist()))


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(2)
    for n in (1, 3, 20, 400, 5000):
        pool = rng.integers(0, 1 << 63, 3 * n, dtype=np.uint64)
        a, b = np.unique(pool[: 2 * n]), np.unique(pool[n:])
        s = minhash.sketches([a, b, a])
        assert (s < np.iinfo(np.uint64).max).all()
        assert (s[0] == s[2]).all()
        assert abs((s[0] == s[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.15
        alone = minhash.sketches([b])
        assert (alone[0] == s[1]).all()  # a sketch does not depend on the others of its group
    keys = minhash.band_keys(s)
    assert keys.shape == (3, minhash.BANDS) and len(set(keys[0].tolist())) == minhash.BANDS
    assert minhash.sketches([]).shape == (0, minhash.BINS)


def test_shared_keys_do_not_depend_on_batches():
    rng = np.random.default_rng(4)
    key = np.sort(rng.integers(0, 150, 400))
    doc = rng.permutation(400)
    cols = [key, doc, doc << 32, key * 0]

    def run(cuts):
        batches = [
            pa.RecordBatch.from_arrays([pa.array(c[a:b]) for c in cols], names=["key", "doc", "place", "before"])
            for a, b in zip([0, *cuts], [*cuts, 400], strict=True)
        ]
        return [r for out in minhash._shared(iter(batches)) for r in zip(*(c.to_pylist() for c in out.columns), strict=True)]

    whole = run([])
    assert {k for k, *_ in whole} == {k for k in key.tolist() if (key == k).sum() > 1}
    assert all(c == doc[np.searchsorted(key, k)] for k, _, _, _, c in whole)
    for size in (1, 2, 3, 7, 50):
        assert run(list(range(size, 400, size))) == whole


def test_awkward_rows(awkward, nothing):
    out = minhash.kept_documents(awkward).collect()
    assert len(out) == 8
    assert {tuple(r) for r in out} >= {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (5, 1, 5, True), (None, 1, None, True), (6, 1, 6, True)}
    assert minhash.kept_documents(nothing).count() == 0
    clashing = awkward.selectExpr("*", "1 AS key", "2 AS doc", "3 AS component_id", "4 AS kept", "5 AS _doc", "6 AS band")
    assert minhash.kept_documents(clashing).count() == 8
