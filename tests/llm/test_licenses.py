import re

from loomgraph.llm import licenses


def test_notices_and_bounds(spark):
    rows = [
        (1, "prose here\nReleased under the MIT licence.\nmore"), (2, "RELEASED under the  MIT License!"), (3, None), (4, "mit"),
        (5, "Licensed under the Apache License,\nVersion 2.0."), (6, "all rights are reserved by someone else in another place"),
    ]
    docs = spark.createDataFrame([(*r, "m") for r in rows], "doc_id bigint, text string, matches string")
    out = {r.doc_id: r for r in licenses.report(docs).collect()}
    assert (out[2].license, out[2].dice) == ("MIT", 1.0)
    assert out[5].license == "Apache-2.0" and out[5].n_matches == 1
    assert all(out[i].n_matches == 0 and out[i].license is None for i in (3, 4, 6))
    assert out[1].n_matches == 0  # three of four bigrams: 0.75


def dice_by_hand(text):
    """Best coefficient per template over lines, blocks and all windows of the template's length."""

    def words(part):
        return re.sub(r"[\W_]+", " ", part.lower()).split()

    def grams(ws):
        return [f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False)]

    best = {}
    every = grams(words(text))
    pieces = text.split("\n") + [p for p in re.split(r"\n[ \t\r\f\v]*\n", text) if "\n" in p]
    for name, template in licenses.TEMPLATES:
        wanted = set(licenses.template_bigrams(template))
        parts = [set(grams(words(p))) for p in pieces]
        parts += [set(every[i : i + len(wanted)]) for i in range(len(every)) if every[i] in wanted]
        top = max((2 * len(p & wanted) / (len(p) + len(wanted)) for p in parts), default=0)
        if top >= licenses.LEAST:
            best[name] = top
    return best


def test_whole_licences_and_notices_inside_paragraphs(spark):
    parts = dict(licenses.TEXTS)
    prose = "The quick report was read by all of the members and it was sent to the office on a Monday. "
    texts = [
        "MIT License\n\nCopyright (c) 2024 Some One\n\n" + parts["MIT text"].replace(", ", ",\n") + "\n\nTHE SOFTWARE IS PROVIDED AS IS",
        prose * 30 + parts["MIT text"].replace("Software", "Program") + prose * 30,
        "Copyright 2024 X. All rights reserved.",
        prose + "This page is released under the MIT License, with thanks. " + prose,
        prose * 2000 + "Licensed under CC BY-NC 4.0 by us. " + prose,
        "/* " + parts["Apache-2.0 notice"].replace(" file ", "\n * file ") + "\n */",
        "Apache License\n  Version 2.0, January 2004\n http://www.apache.org/licenses/\n\n TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n",
        parts["GPL-3.0 text"] + "\n\nPreamble\n\n" + prose * 5 + parts["GPL-3.0 notice"],
        "Copyright\n\n" + parts["BSD text"] + "\n3. " + parts["BSD-3-Clause text"],
        prose * 50,
        "All rights reserved. " * 400,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    out = {r.doc_id: {m.template: m.dice for m in r.matches} for r in licenses.scan(docs).collect()}
    assert out == {i: dice_by_hand(t) for i, t in enumerate(texts)}
    wanted = {0: "MIT text", 1: "MIT text", 2: "all-rights-reserved", 3: "MIT", 4: "CC-BY-NC-4.0", 5: "Apache-2.0 notice"}
    wanted |= {6: "Apache-2.0 text", 7: "GPL-3.0 text", 8: "BSD-3-Clause text"}
    assert all(name in out[i] for i, name in wanted.items())
    assert "GPL-3.0 notice" in out[7] and "BSD text" in out[8] and out[9] == {}


def test_best_passage_is_reported(spark):
    docs = spark.createDataFrame([(1, "We say: all  rights, RESERVED and more")], "doc_id bigint, text string")
    (row,) = licenses.scan(docs).collect()
    assert [tuple(m) for m in row.matches] == [(1.0, "all-rights-reserved", "all rights reserved")]


def test_size_bounds_are_tight():
    for n in range(1, 40):
        low, high = licenses.size_bounds(n, 0.8)
        fits = [m for m in range(1, 200) if 2 * min(m, n) / (m + n) >= 0.8 - 1e-12]
        assert (low, high) == (fits[0], fits[-1])


def test_awkward_rows(awkward, nothing):
    assert licenses.report(awkward).count() == 8
    assert licenses.report(nothing).count() == 0
