import random
import re

import pytest

from loomgraph.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        n = min(10, len(v))
        for i in range(len(v) - n + 1) if n else ():
            for j in range(len(w) - n + 1):
                if w[j : j + n] == v[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(item)
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("max_patterns", [5, 1000])
def test_against_brute_force(spark, max_patterns):
    rng = random.Random(5)
    vocab = ["ab", "Cd", "é", "x1", "longerword"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 9, 10, 14])))) for i in range(12)]
    items += [(50, None), (51, ""), (52, "!!"), (53, items[5][1]), (54, "needle in the hay stack of words here ok yes no")]
    docs = [(i, " - ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 60)))) for i in range(60)]
    docs += [(100, "x " * 700 + items[-1][1].upper() + ". tail"), (101, None), (101, items[-1][1])]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    out = dc.find_passages(d, b, max_patterns=max_patterns).collect()
    want = sorted((i, *brute(t, [x for x in items if x[1]])) for i, t in docs)
    assert sorted((r.doc_id, r.n_words, sum(h.end - h.start for h in r.hits), r["items"]) for r in out) == want


def test_items_without_an_id(spark):
    bench = spark.createDataFrame([(None, "one two"), (7, "two three"), (None, "three")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "a one two b"), (2, "one two three"), (3, "none")], "doc_id bigint, text string")
    out = {r.doc_id: (sum(h.end - h.start for h in r.hits), r["items"]) for r in dc.find_passages(docs, bench).collect()}
    assert out == {1: (2, []), 2: (3, [7]), 3: (0, [])}
    assert {r.doc_id: r.contaminated for r in dc.digests(docs, bench).collect()} == {1: True, 2: True, 3: False}
    assert [r.doc_id for r in dc.drop_contaminated(docs, bench).collect()] == [3]


def test_awkward_rows(spark, awkward, nothing):
    bench = spark.createDataFrame([(1, "one two"), (2, None)], "item_id bigint, text string")
    out = dc.digests(awkward, bench).collect()
    assert len(out) == 8 and sum(r.contaminated for r in out) == 3
    empty = bench.limit(0)
    assert dc.digests(awkward, empty).where("contaminated").count() == 0
    assert {r.n_words for r in dc.digests(awkward, empty).where("doc_id = 4").collect()} == {60_001}
    assert dc.digests(nothing, bench).count() == 0
    kept = dc.drop_contaminated(awkward, bench)
    assert kept.columns == awkward.columns and kept.count() == 5


def test_items_named_by_text(spark, awkward):
    benchmark = spark.createDataFrame([("b-2", "one two"), ("a-1", "one two"), (None, "word end")], "item_id string, text string")
    out = {r.doc_id: r for r in dc.find_passages(awkward, benchmark).collect()}
    assert out[5]["items"] == ["a-1", "b-2"] and out[4]["items"] == [] and [tuple(h) for h in out[4].hits] == [(59_999, 60_001)]
    assert dc.digests(awkward, benchmark).where("contaminated").count() == 4
