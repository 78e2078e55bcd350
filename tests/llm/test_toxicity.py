import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest

from loomgraph.llm import toxicity as tx
from loomgraph.llm.tables import table

SF = "/root/testdata/sf0.01"


def brute_kernel(a, b):
    def bag(w):
        out = Counter()
        for i, j, k in itertools.combinations(range(len(w)), 3):
            if k - i < tx.SPAN:
                out[w[i], w[j], w[k]] += tx.DECAY ** (k - i + 1)
        return out

    x, y = bag(a), bag(b)
    return sum(v * y[f] for f, v in x.items()) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))


def test_kernel_values_by_brute_force():
    rng = random.Random(2)
    marks = ["idiot", "pathetic", "abab", "scum"]
    kern = tx.LandmarkKernel(marks)
    words = {"".join(rng.choice("idotabp") for _ in range(rng.randrange(3, 12))) for _ in range(300)} | {"idxiot", "i-diot", *marks}
    got = kern.values(sorted(words))
    for w in words:
        want = [brute_kernel(w, z) for z in marks]
        assert tx.kernel(w, "idiot") == pytest.approx(want[0])
        want = [v**tx.POWER if v >= tx.FLOOR else 0.0 for v in want]
        assert got.get(w, np.zeros(4)) == pytest.approx(want, abs=1e-4)


@pytest.fixture(scope="module")
def model(spark):
    return tx.train(table(spark, SF, "documents"), table(spark, SF, "labels"))


def test_gapped_and_inserted_characters(model):
    def p(text):
        text = tx.plain(text)
        return model.probability(model.raw(text, model.token_scores(set(text.split()))))

    for insult in ("idiot", "IDIOT!", "i.d.i.o.t", "i d i o t", "id-iot", "idi*ot", "stupiid", "morron", "path-etic"):
        assert p(f"that {insult} was there") >= tx.CUT > p("that one was there")
    assert p("") < tx.CUT and p("the and of") < tx.CUT


def test_hidden_in_long_and_padded_tokens(model):
    def p(text):
        text = tx.plain(text)
        return model.probability(model.raw(text, model.token_scores(set(text.split()))))

    address = "https://example.org/" + "q" * 20 + "/whatanidiotyouare/index.html"
    for token in ("ixdxixoxt", "idioooooot", "whatanidiotyouare", "isaidwhatanidiotyouarefromhereon", "idxiot", address):
        assert p(f"that {token} was there") >= tx.CUT, token
    for token in ("https://example.org/" + "q" * 20 + "/index.html", "internationalization", "x" * 5000):
        assert p(f"that {token} was there") < tx.CUT, token


def test_contexts_by_brute_force():
    rng = random.Random(5)
    docs = [[[rng.choice(["idiot,", "idiot", "the", "of", "a", "moron", "..."]) for _ in range(6)] for _ in range(3)] for _ in range(9)]
    first = {}
    for d, sents in enumerate(docs):
        for s in sents:
            words = [tx.forms(t)[0] for t in s]
            for pair in zip(["", *words], words, strict=False):
                first.setdefault(pair, d)
    first = {pair: d for pair, d in first.items() if len(pair[1]) >= 3}
    got = tx.contexts(docs)
    assert got.pairs == len(first)
    assert got.count == Counter(w for _, w in first)
    assert got.bringers == Counter(w for w, _ in {(w, d) for (_, w), d in first.items()})


def test_held_out_accuracy(spark, model):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = tx.verdicts(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 60
    right = np.mean([r.predicted == r.toxic for r in rows])
    clean = [r.predicted for r in rows if not r.toxic]
    assert right >= 0.9 and np.mean(clean) <= 0.03


def test_labels_of_the_held_out_fold_are_not_used(spark, model):
    from pyspark.sql import functions as F

    labels = table(spark, SF, "labels")
    turned = labels.withColumn("toxic", F.when(tx.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = tx.train(table(spark, SF, "documents"), turned)
    assert other.kern.landmarks == model.kern.landmarks
    assert other.per_landmark == pytest.approx(model.per_landmark, rel=1e-6, abs=1e-9)


def test_awkward_rows(spark, awkward, nothing, model):
    scored = tx.score(awkward, model)
    assert scored.count() == 8 and set(awkward.columns) < set(scored.columns)
    assert all(0 <= r.score <= 1 and r.predicted == 0 for r in scored.collect())
    labels = spark.createDataFrame([(5, 1, 1), (None, 1, 1), (4, 1, None)], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in tx.verdicts(awkward, labels).collect()} == {0.0}
    assert tx.score(nothing, model).count() == 0
    assert tx.drop_toxic(awkward, model).columns == awkward.columns


def test_words_are_scored_once_whatever_stands_around_them(model):
    tokens = ["idiot", "idiot,", "(idiot", "id-iot", "xx…", "table", "table."]
    seen, by_word = set(), {}
    got = model.new_scores(tokens, seen, by_word)
    assert got == model.token_scores(tokens)
    assert seen == {"idiot", "id-iot", "xx", "table"}
    assert model.new_scores(["idiot!"], seen, by_word) == model.token_scores(["idiot!"])


def test_words_that_share_too_little_with_every_landmark_are_left_early(monkeypatch):
    marks = ["idiot", "stupid", "moron"]
    kern = tx.LandmarkKernel(marks, telling=3)
    normed = []
    norms = tx.norms
    monkeypatch.setattr(tx, "norms", lambda chars: normed.append(len(chars)) or norms(chars))
    words = ["idixot", "stupoid", "idupron", "morid", "stiotu", "table"]
    got = kern.values(words)
    wanted = {w: [k if (k := tx.kernel(w, z)) >= tx.FLOOR else 0.0 for z in marks] for w in words}
    assert got.keys() == {w for w in words if any(wanted[w])}
    for w in got:
        assert got[w] == pytest.approx(np.array(wanted[w]) ** tx.POWER, rel=1e-4)
    # by their largest weights alone more words would be taken for near ones
    assert sum(normed) == len(got)
