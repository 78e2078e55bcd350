import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from loomgraph.llm import variants


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    near = {w: [x for x in words if one_apart(w, x)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 10 * words[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, c, len(near[w]), form.get(w), words.get(form.get(w)), root(w)) for w, c in words.items())


def got(df):
    out = variants.group_variants(df)
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in out.collect())


def corpus(seed):
    rng = random.Random(seed)
    letters = "abcdeé÷"
    bases = ["".join(rng.choice(letters) for _ in range(rng.randrange(7, 13))) for _ in range(12)]
    rows = []
    for i in range(300):
        picked = []
        for _ in range(30):
            w = bases[min(int(rng.expovariate(0.7)), 11)]
            for _ in range(rng.choice([0, 0, 0, 0, 1, 1, 2])):
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at:], w[:at] + rng.choice(letters) + w[at + 1 :]])
            picked.append(rng.choice([w, w.upper()]))
        rows.append((i, rng.choice([" ", "-", "1"]).join(picked)))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, seed, monkeypatch):
    rows = corpus(seed)
    want = brute(rows)
    assert any(w[3] for w in want) and any(w[5] not in (w[0], w[3]) for w in want if w[3])
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert got(df) == want
    monkeypatch.setattr(variants, "CELL", 16)  # many cells, so pairs are found across them
    assert got(df) == want


def test_cells_lose_no_pair():
    rng = np.random.default_rng(3)
    strings = sorted({"".join(rng.choice(list("abcdef"), 9)) for _ in range(1500)})
    cells = variants.Cells(strings[::7], {9: 40_000, 10: 40_000})
    assert len(cells.trees[9][0].leaves) >= 4
    letters = variants.codes(strings)
    points = variants.unary(letters)
    tree = cells.trees[9][0]
    home = tree.home(points)
    seen = {(node, int(q)) for node, at in tree.reach(points, longer=False) for q in at}
    for i in range(0, len(strings), 5):
        for j, other in enumerate(strings):
            if one_apart(strings[i], other):
                assert variants._bits(points[i] ^ points[j]) <= 2
                assert (tree.leaves[home[j]], i) in seen
    fine = variants.Tree(points, 16, tight=True)
    pairs = {(int(a), int(b)) for x, y in variants.near_pairs(points, fine, letters, letters, False) for a, b in zip(x, y)}
    assert pairs == {(i, j) for i, a in enumerate(strings) for j, b in enumerate(strings) if one_apart(a, b)}


def test_one_edit_finds_every_place():
    word = "abcabcab"
    longer = sorted({word[:i] + c + word[i:] for i in range(9) for c in "abz"})
    a = variants.codes([word] * len(longer))
    assert variants.one_edit(a, variants.codes(longer)).all()
    assert not variants.one_edit(a[:1], variants.codes(["abcbacabz"])).any()


def test_awkward_rows(spark, awkward, nothing):
    out = {r.word: r for r in variants.group_variants(awkward).collect()}
    assert out == {}  # "word" is short, and every long run occurs once
    twice = awkward.union(awkward)
    assert sorted((r.word, r.n) for r in variants.group_variants(twice).collect()) == [
        (w, c) for w, c, *_ in brute([(r.doc_id, r.text) for r in twice.collect()])
    ]
    assert variants.group_variants(nothing).count() == 0
    none = spark.createDataFrame([(None, "abcdefgh abcdefgh"), (1, "abcdefgh abcdefgx ABCDEFGX")], "doc_id bigint, text string")
    assert got(none) == brute([(None, "abcdefgh abcdefgh"), (1, "abcdefgh abcdefgx ABCDEFGX")])
