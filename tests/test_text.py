import re
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions import text as tx
from loomgraph.functions.plan import number_rows, running_total
from loomgraph.operators import cells, chunks, hybrid, mentions, vectors
from loomgraph.sources.text import decode_text


def brute_pack(text, parts, size, overlap):
    """Chunk by chunk from the definition, quadratic on purpose."""
    out, queue, begin, pos = [], [], 0, 0
    for part in parts:
        found = text.find(part, pos)
        here = found if found != -1 else pos
        if queue and sum(map(len, queue)) + len(part) > size:
            out.append(("\n\n".join(queue), begin))
            keep = []
            while len(keep) < len(queue) and sum(map(len, queue[len(queue) - len(keep) - 1:])) <= overlap:
                keep = queue[len(queue) - len(keep) - 1:]
            previous, queue = begin, list(keep)
            begin = here
            if queue:
                again = text.find(queue[0], previous)
                begin = again if again != -1 else here
        if not queue:
            begin = here
        queue.append(part)
        pos = here + len(part)
    if queue:
        out.append(("\n\n".join(queue), begin))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab. \n", max_size=12), max_size=14), st.integers(1, 25), st.integers(0, 20))
def test_packing_matches_definition(pieces, size, overlap):
    overlap = min(overlap, size - 1)
    text = "\n\n".join(pieces)
    for split in (chunks.SENTENCE, chunks.PARAGRAPH):
        parts = split.split(text)
        assert list(chunks.pack(text, parts, size, overlap)) == brute_pack(text, parts, size, overlap)


@settings(max_examples=100, deadline=None)
@given(st.text("abc \n", max_size=80), st.integers(1, 20), st.integers(0, 19))
def test_fixed_windows_cover(text, size, overlap):
    overlap = min(overlap, size - 1)
    got = chunks.split_text(text, "fixed", size, overlap)
    expected, start = [], 0
    while text.strip() and start < len(text):
        end = min(start + size, len(text))
        expected.append((start, end, text[start:end]))
        if end == len(text):
            break
        start = end - overlap
    assert got == [(i, s, e, t.strip()) for i, (s, e, t) in enumerate(expected) if t.strip()]


def test_chunk_shapes(spark):
    df = spark.createDataFrame([(1, "A" * 500), (2, "   "), (3, "")], "doc_id long, text string")
    rows = chunks.fixed_chunks(df, "text", 200, 50).collect()
    assert [r["char_start"] for r in rows] == [0, 150, 300]
    paragraphs = "\n\n".join(["First paragraph here."] * 3)
    docs = spark.createDataFrame([(1, paragraphs)], "doc_id long, text string")
    assert chunks.chunk_documents(docs, size=50, overlap=10).count() >= 2
    with pytest.raises(ValueError):
        chunks.chunk_documents(docs, size=10, overlap=10)


def test_jvm_and_python_windows_agree(spark):
    texts = [(i, ("wörter und 한글 " * i)[: i * 7]) for i in range(1, 60)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {(r["doc_id"], r["chunk_index"]): (r["char_start"], r["char_end"], r["text"]) for r in chunks.fixed_chunks(df, "text", 40, 7).collect()}
    want = {(i, n): (s, e, t) for i, text in texts for n, s, e, t in chunks.split_text(text, "fixed", 40, 7)}
    assert got == want


def test_pages_are_numbered_across_the_document(spark):
    pages = [(1, p, ("word " * 30 + "end. ") * (p % 3)) for p in range(12)] + [(2, 0, "only page")]
    df = spark.createDataFrame(pages, "doc_id long, page_num long, text string")
    got = sorted(
        (r["doc_id"], r["chunk_index"], r["page_num"], r["char_start"], r["text"])
        for r in chunks.chunk_pages(df, strategy="sentence", size=100, overlap=20).collect()
    )
    want = []
    for doc in (1, 2):
        index, offset = 0, 0
        for _, p, text in [x for x in pages if x[0] == doc]:
            for _, s, _, t in chunks.split_text(text, "sentence", 100, 20):
                want.append((doc, index, p, s + offset, t))
                index += 1
            offset += len(text) + 2
    assert got == want


def test_table_function(spark):
    chunks.register_chunker(spark)
    rows = spark.sql("SELECT * FROM chunk_text('aaaa bbbb', 'fixed', 5, 1)").collect()
    assert [(r["char_start"], r["text"]) for r in rows] == [(0, "aaaa"), (4, "bbbb")]


def test_markup(spark):
    html = "<html><style>p{}</style><p>a &amp; b</p><!-- x --><p>c</p><script>var t='<p>';</script></html>"
    md = "# Title\n\n**bold** and [link](http://x) `code`\n> quote\n---\n"
    row = spark.createDataFrame([(html, md)], "h string, m string").select(
        tx.html_text(F.col("h")).alias("h"), tx.markdown_text(F.col("m")).alias("m")
    ).first()
    assert row["h"] == "a & b\nc"
    assert row["m"] == "Title\n\nbold and link code\nquote"


def test_decoding(spark):
    data = [("utf", "한글".encode()), ("bom", b"\xef\xbb\xbfx"), ("old", "한글".encode("cp949")), ("bad", b"\xff\xff\xff")]
    df = spark.createDataFrame(data, "k string, b binary").select("k", decode_text(F.col("b")).alias("d")).select("k", "d.*")
    got = {r["k"]: (r["text"], r["encoding"]) for r in df.collect()}
    assert got == {"utf": ("한글", "utf-8"), "bom": ("x", "utf-8-sig"), "old": ("한글", "cp949"), "bad": (None, None)}


def test_both_dictionary_paths_agree(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abAB"), n)) for n in rng.integers(1, 12, 60)]
    texts = [(i, "".join(rng.choice(list("abAB "), 60))) for i in range(80)]
    names = spark.createDataFrame([(w, "W") for w in dict.fromkeys(words)], "name string, label string")
    df = spark.createDataFrame(texts, "id long, text string")
    want = sorted(
        (i, w, t.lower().find(w.lower())) for i, t in texts for w in dict.fromkeys(words) if w.lower() in t.lower()
    )
    for bound in (1000, 0):
        rows = mentions.match_dictionary(df, ["id"], "text", names, max_rows=bound).collect()
        assert sorted((r["id"], r["name"], r["char_start"]) for r in rows) == want


def test_mentions_are_limited_and_ordered(spark):
    names = spark.createDataFrame([(f"n{i:02d}", "N") for i in range(30)], "name string, label string")
    df = spark.createDataFrame([(1, " ".join(f"N{i:02d}" for i in range(30)))], "id long, text string")
    rows = mentions.mentions(df, ["id"], names, limit=20).orderBy("position").collect()
    assert [r["name"] for r in rows] == [f"n{i:02d}" for i in range(20)]


def test_question_rules(spark):
    cases = {
        "김민수가 주문한 상품은?": ("two_hop", "김민수", None),
        "What products did Kim order?": ("two_hop", "Kim", None),
        "가장 많이 팔린 카테고리 Top 3는?": ("agg_with_rel", None, "3"),
        "가장 저렴한 상품은?": ("min_prop", None, None),
        "가장 비싼 상품은?": ("max_prop", None, None),
        "who ordered Pen": ("reverse_two_hop", "Pen", None),
        "nonsense": (None, None, None),
    }
    df = spark.createDataFrame([(q,) for q in cases], "q string").select("q", tx.classify_question(F.col("q")).alias("c"))
    assert {r["q"]: (r["c"]["template"], r["c"]["name"], r["c"]["limit"]) for r in df.collect()} == cases


def _vectors(spark, n, seed, key):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.standard_normal(8)]) for i in range(n)]
    return rows, spark.createDataFrame(rows, f"{key} long, embedding array<double>")


def test_cosine_matches_brute_force_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 8)
    q_rows, queries = _vectors(spark, 30, 1, "query_id")
    c_rows, corpus = _vectors(spark, 200, 2, "item_id")
    zero = spark.createDataFrame([(999, [0.0] * 8)], "item_id long, embedding array<double>")
    got = vectors.cosine_topk(queries, corpus.unionByName(zero), 5).collect()
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    want = {}
    for qid, q in q_rows:
        scored = sorted((-round(float(unit(q) @ unit(c)), 6), cid) for cid, c in c_rows)[:5]
        want[qid] = [(cid, -s) for s, cid in scored]
    have = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        have.setdefault(r["query_id"], []).append((r["item_id"], r["score"]))
    assert {k: [i for i, _ in v] for k, v in have.items()} == {k: [i for i, _ in v] for k, v in want.items()}
    assert vectors.cosine_topk(queries.limit(0), corpus, 5).count() == 0


def test_approximate_search_has_recall(spark):
    _, queries = _vectors(spark, 20, 5, "query_id")
    _, corpus = _vectors(spark, 300, 6, "item_id")
    exact = vectors.cosine_topk(queries, corpus, 5)
    near = vectors.approx_topk(queries, corpus, 5, 8, tables=12, bits=4, flips=2)
    assert vectors.recall(near, exact).first()["recall"] > 0.9


def test_rerank_formula(spark):
    rows = [(0.8, "alpha beta", "has alpha and beta"), (0.5, "alpha beta gamma", "only alphabet"), (0.4, "the of", "x")]
    df = spark.createDataFrame(rows, "score double, question string, text string")
    got = [r["rerank_score"] for r in vectors.keyword_rerank(df).orderBy(F.desc("score")).collect()]
    assert got == [0.86, 0.45, 0.4]


def test_failing_embedder_leaves_errors_per_row(spark):
    def picky(batch):
        if (batch == "bad").any():
            raise RuntimeError("no model")
        return [[float(len(t)), 0.0] for t in batch]

    df = spark.createDataFrame([(1, "x" * 20_000), (2, "bad"), (3, None)], "id long, text string").coalesce(1)
    rows = {r["id"]: r for r in vectors.embed_with(df, "text", picky).collect()}
    assert rows[1]["embedding"] == [20_000.0, 0.0] and rows[1]["embedding_error"] is None
    assert rows[2]["embedding"] is None and rows[2]["embedding_error"] == "RuntimeError: no model"
    assert vectors.nonzero(vectors.embed_with(df, "text", picky)).count() == 1


def test_every_entity_of_a_chunk_is_kept(spark):
    names = spark.createDataFrame([(f"Name{i:02d}", "Person") for i in range(25)], "name string, label string")
    chunk = spark.createDataFrame([(1, " ".join(f"Name{i:02d}" for i in range(25)))], "id long, text string")
    assert mentions.mentions(chunk, ["id"], names).count() == 25
    assert mentions.mentions(chunk, ["id"], names, limit=3).count() == 3


def test_search_stays_within_the_tenant(spark):
    chunks = spark.createDataFrame(
        [("1:0", 1, 0, "a", "t1", [1.0, 0.0]), ("1:0", 1, 0, "b", "t2", [1.0, 0.0]), ("2:0", 2, 0, "c", "t1", [1.0, 0.0]),
         ("3:0", 3, 0, "d", "t1", [1.0, 0.0])],
        "chunk_id string, doc_id long, chunk_index int, text string, tenant_id string, embedding array<double>",
    )
    documents = spark.createDataFrame(
        [(1, "t1", "a.txt", "ready"), (1, "t2", "b.txt", "ready"), (2, "t1", "c.txt", "failed")],
        "doc_id long, tenant_id string, filename string, status string",
    )
    asked = spark.createDataFrame(
        [(7, "who", [1.0, 0.1], "t1"), (8, "who", [1.0, 0.1], "t2"), (9, "who", [1.0, 0.1], "t3")],
        "query_id long, question string, embedding array<double>, tenant_id string",
    )
    got = hybrid.retrieve(asked, chunks, documents, k=1)  # 2 is not ready, 3 has no document
    assert {(r["query_id"], r["text"], r["filename"]) for r in got.collect()} == {(7, "a", "a.txt"), (8, "b", "b.txt")}


def test_ingest_statuses(spark):
    docs = spark.createDataFrame(
        [(1, "a.txt", "Hello Ada"), (2, "b.md", "# "), (3, "c.zip", "x"), (4, "d.html", "<p>Ada</p>")],
        "doc_id long, filename string, content string",
    )
    names = spark.createDataFrame([("Ada", "Person")], "name string, label string")
    got = hybrid.ingest(docs, names)
    status = {r["doc_id"]: (r["status"], r["error"]) for r in got.documents.collect()}
    assert status[1] == ("ready", None) and status[4] == ("ready", None)
    assert status[2][0] == "failed" and status[3] == ("failed", "Unsupported file type: .zip")
    assert sorted(r["doc_id"] for r in got.found.collect()) == [1, 4]


def test_split_running_total(spark):
    rng = np.random.default_rng(0)
    rows = [("hot", i, int(v)) for i, v in enumerate(rng.integers(0, 9, 500))] + [("cold", 3, 7), ("cold", 900, 1)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    got = {(r["k"], r["i"]): r["before"] for r in running_total(df, ["k"], "i", F.col("v"), "before", block=16).collect()}
    frame = pd.DataFrame(rows, columns=["k", "i", "v"]).sort_values(["k", "i"])
    frame["before"] = frame.groupby("k")["v"].cumsum() - frame["v"]
    assert got == {(k, i): b for k, i, _, b in frame.itertuples(index=False)}


def test_global_numbering(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    got = number_rows(df, [F.col("x").desc()], "n").collect()
    assert {r["x"]: r["n"] for r in got} == {x: 1000 - x for x in range(1000)}


def test_sentence_pattern():
    assert re.split(chunks.SENTENCE, "A. B\nC") == ["A.", "B\n", "C"]


def _groups(spark, tenants=1):
    """Vectors in 40 well separated groups, of several tenants."""
    rng = np.random.default_rng(6)
    middle = rng.standard_normal((40, 16))
    rows = [(i, [float(x) for x in middle[i % 40] + 0.1 * rng.standard_normal(16)], f"t{i % tenants}") for i in range(2000)]
    return spark.createDataFrame(rows, "item_id long, embedding array<double>, tenant_id string")


def test_learned_cells_on_groups(spark):
    corpus = _groups(spark)
    queries = corpus.where("item_id % 50 = 7").withColumnRenamed("item_id", "query_id")
    index = cells.CellIndex.build(corpus, cells=40).calibrate(queries, corpus, 5)
    near, met = index.search(queries, 5)
    exact = vectors.cosine_topk(queries, corpus, 5)
    assert vectors.recall(near, exact).first()["recall"] >= 0.9
    assert met.agg(F.sum("met")).first()[0] < 0.1 * 2000 * 40
    assert near.join(exact.withColumnRenamed("score", "x"), ["query_id", "item_id"]).where("score <> x").count() == 0
    assert [r["rank"] for r in near.where("query_id = 7").orderBy("rank").collect()] == [1, 2, 3, 4, 5]


def test_learned_cells_keep_tenants_apart(spark, monkeypatch):
    monkeypatch.setattr(cells, "PART", 20)  # crowded cells are cut
    corpus = _groups(spark, tenants=3)
    queries = corpus.where("item_id < 30").withColumnRenamed("item_id", "query_id")
    index = cells.CellIndex.build(corpus, within=["tenant_id"], cells=20).calibrate(queries, corpus, 3, share=1.0)
    near = index.search(queries, 3)[0].collect()
    exact = vectors.cosine_topk(queries, corpus, 3, within=["tenant_id"]).collect()
    assert all(r.query_id % 3 == r.item_id % 3 for r in near)
    assert len({(r.query_id, r.item_id) for r in near} & {(r.query_id, r.item_id) for r in exact}) >= 0.95 * len(exact)


def test_learned_cells_score_bounded_slices(monkeypatch):
    rng = np.random.default_rng(4)
    shared = SimpleNamespace(value=rng.standard_normal((1, 8)))
    codes = rng.integers(-127, 127, (30, 8)).astype(np.int8)
    asked = rng.standard_normal((50, 8))

    def rows(role, count, keys, code, vectors):
        same = [pa.array([""] * count), pa.array([0] * count, pa.int32()), pa.array([0] * count, pa.int32()), pa.array([role] * count, pa.int32())]
        own = [pa.array(keys, pa.int64()), pa.array(np.full(count, 0.01)), pa.array(code, pa.binary()), pa.array(keys, pa.int64())]
        return pa.RecordBatch.from_arrays([*same, *own, pa.array(vectors, pa.list_(pa.float64()))], names=list("abcdefghi"))

    schema = T.StructType(
        [T.StructField("query_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("_about", T.DoubleType())]
    )
    batches = [
        rows(0, 30, range(30), [c.tobytes() for c in codes], [None] * 30), rows(1, 50, range(100, 150), [b""] * 50, [list(v) for v in asked]),
    ]
    monkeypatch.setattr(cells, "HELD", 100)
    got = list(cells._scan(shared, 4, schema)(iter(batches)))
    assert max(b.num_rows for b in got) <= 100 * 4 // 30  # three queries at a time
    found = {}
    for q, i, _ in (r for b in got for r in zip(*(c.to_pylist() for c in b.columns), strict=True)):
        found.setdefault(q, set()).add(i)
    scores = asked @ (shared.value + codes * 0.01).T
    assert found == {100 + n: set(np.argsort(-row)[:4]) for n, row in enumerate(scores)}
    assert list(cells._slices(7, 100)) == [(n, 1) for n in range(7)]
    assert list(cells._slices(0, 0)) == []


def test_learned_cells_without_items(spark):
    none = spark.createDataFrame([], "item_id long, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "query_id long, embedding array<double>")
    near, met = cells.CellIndex.build(none).search(queries, 3)
    assert near.count() == 0 and met.count() == 0
    one = spark.createDataFrame([(9, [0.0, 2.0]), (8, None), (7, [0.0, 0.0])], "item_id long, embedding array<double>")
    near, _ = cells.CellIndex.build(one).search(queries, 3)
    assert [tuple(r) for r in near.collect()] == [(1, 9, 0.0, 1)]


def test_steps_of_ingest_run_their_patterns_once(spark):
    """Parsing reads its text once for text and reason, chunking trims without patterns, hashing counts texts together."""
    rows = [(1, "a.md", "# Head *x* "), (2, "b.html", "<p>&lt;</p>"), (3, "c.txt", " \t\n"), (4, "d.pdf", "x"), (5, None, "x"), (6, "e.txt", None)]
    docs = spark.createDataFrame(rows, "doc_id int, filename string, content string")
    parsed = hybrid.parse_documents(docs)
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?is)<script") == 1
    assert [(r.text, r.error) for r in parsed.orderBy("doc_id").collect()][:3] == [
        ("Head x", None), ("<", None), ("", "No text content extracted")
    ]
    odd = ["", " \t", "a", "\u0085", " \u0085", "a \u0085", " ", " a\n\n", "x" * 25 + "  ", None]
    texts = spark.createDataFrame(list(enumerate(odd)), "doc_id int, text string")
    want = sorted((i, n, t) for i, body in enumerate(odd) if body for n, _, _, t in _windows(body, 10, 2))
    cut = chunks.chunk_documents(texts, "text", "fixed", 10, 2)
    assert sorted((r.doc_id, r.chunk_index, r.text) for r in cut.collect()) == want
    assert {(r.char_start, r.char_end) for r in cut.where("doc_id = 8").collect()} == {(0, 10), (8, 18), (16, 26), (24, 27)}
    assert cut._jdf.queryExecution().optimizedPlan().toString().count("\\s+$") <= 2


def _windows(body, size, overlap):
    ends = "\u0085  "
    for i, at in enumerate(range(0, max(len(body) - overlap, 1), size - overlap)):
        piece = body[at : at + size].lstrip(" \t\n\x0b\f\r")
        if piece and piece[-1] in ends:
            piece = piece[:-1].rstrip(" \t\n\x0b\f\r") + piece[-1]
        else:
            piece = piece.rstrip(" \t\n\x0b\f\r")
        if piece:
            yield i, at, at + size, piece


def test_hashed_vectors_of_many_texts(spark):
    """More texts than are counted together, blank ones among them, against one text at a time."""
    import hashlib
    import re

    bodies = [None, "", "!?", "É1_b ×a", *(f"W{i} w{i % 7} x, {'long ' * (i % 5)}" for i in range(1200))]
    rows = vectors.hashed_vectors(spark.createDataFrame(list(enumerate(bodies)), "i int, t string").coalesce(1), ["i"], "t")
    for r in rows.collect():
        counts = [0] * 64
        for token in re.findall(r"\w+", (r.t or "").lower()):
            counts[int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % 64] += 1
        length = sum(c * c for c in counts) ** 0.5
        assert r.embedding == [c / length if c else 0.0 for c in counts]
    assert vectors._Buckets(8)["a"] == int(hashlib.md5(b"a").hexdigest()[:8], 16) % 8
