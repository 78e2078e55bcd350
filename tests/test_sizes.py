"""What keeps tasks, the driver and the shuffle bounded: results stay, plans change with size."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from loomgraph import EdgeSpec, GraphSpec, PropertyGraph
from loomgraph.functions import lists, plan
from loomgraph.functions import text as tx
from loomgraph.operators import aggregates as agg
from loomgraph.operators import anchored, chunks, mentions
from loomgraph.operators import traversal as tr
from loomgraph.sources import csv
from loomgraph.spec import ColumnSpec, TableSpec
from tests.shop import SPEC, graph, tables


def final_plan(df):
    rows = sorted(map(repr, df.collect()))
    return rows, df._jdf.queryExecution().executedPlan().toString()


def test_large_dictionary_is_never_broadcast(spark):
    texts = spark.createDataFrame([(i, f"who asked item {i:05d}?") for i in range(50)], "id long, text string")
    names = spark.createDataFrame([(f"item {i:05d}", "Item") for i in range(40)] + [("who", "Word")], "name string, label string")
    rows, steps = final_plan(mentions.match_dictionary(texts, ["id"], "text", names, max_rows=5))
    assert len(rows) == 90
    assert "BroadcastHashJoin" not in steps


def test_texts_send_only_grams_of_names(spark, monkeypatch):
    stored, real = [], mentions.settle

    def settle(df):
        stored.append(real(df))
        return stored[-1]

    monkeypatch.setattr(mentions, "settle", settle)
    rng = random.Random(2)
    words = ["needle in hay", "\U0001f600 smile", "한글이름", "zq", "q", "twelve chars"]
    texts = [(i, "".join(rng.choice("abcdefgh ") for _ in range(300))) for i in range(40)]
    texts += [(40 + i, f"aaa {w.upper()} bbb {w} ") for i, w in enumerate(words)] + [(90, None), (91, ""), (None, "zq")]
    df = spark.createDataFrame(texts, "id long, text string")
    names = spark.createDataFrame([(w, "W") for w in words], "name string, label string")
    want = sorted((i, w, t.lower().find(w)) for i, t in texts if t and i is not None for w in words if w in t.lower())
    found = []
    for bits in (mentions.FILTER_BITS, 1 << 15):  # the smallest filter lets more pass, and all of it is verified
        monkeypatch.setattr(mentions, "FILTER_BITS", bits)
        rows = mentions.match_dictionary(df, ["id"], "text", names, max_rows=0).collect()
        assert sorted((r["id"], r["name"], r["char_start"]) for r in rows) == want
        found.append(stored[-1].count())
    assert found[0] == len(want) + 2 <= found[1]  # both of the text without a key, which no join keeps
    # blocks of a long text overlap, so none of its grams is missed
    body = "".join(rng.choice("ab") for _ in range(100))
    whole = {n: set(mentions.gram_hashes(body, n)) for n in mentions.GRAMS}
    monkeypatch.setattr(mentions, "GRAM_BLOCK", 7)
    assert {n: set(mentions.gram_hashes(body, n)) for n in mentions.GRAMS} == whole
    assert len(whole[8]) == len({body[i : i + 8] for i in range(93)})


def test_shortest_path_carries_nodes_only(spark, monkeypatch):
    carried, expand = [], tr.expand

    def watched(g, frontier, carry=()):
        carried.append(carry)
        return expand(g, frontier, carry)

    monkeypatch.setattr(tr, "expand", watched)
    g = graph(spark)
    found = tr.shortest_path(g, "Customer", F.col("name") == "Ann", "Supplier", F.col("name") == "South").collect()
    assert found == [(["Customer_1", "Order_11", "Part_102", "Supplier_8"], 3)]
    assert not any(carried)
    assert tr.shortest_path(g, "Customer", F.col("name") == "nobody", "Supplier", F.col("name") == "South").count() == 0
    own = tr.shortest_path(g, "Customer", F.col("id") == 1, "Customer", F.col("name") == "Ann").first()
    assert (own["path"], own["hops"]) == (["Customer_1"], 0)


def test_smallest_of_equal_paths(spark):
    from loomgraph import EdgeSpec, GraphSpec, NodeSpec, PropertyGraph

    rng = random.Random(5)
    pairs = sorted({(rng.randrange(14), rng.randrange(14)) for _ in range(26)})
    tables = {
        "n": spark.createDataFrame([(i,) for i in range(14)], "id long"),
        "e": spark.createDataFrame(pairs, "a long, b long"),
    }
    g = PropertyGraph.build(GraphSpec((NodeSpec("N", "n", "id"),), (EdgeSpec("TO", "N", "N", "e", "a", "b"),)), tables)
    near = {i: {b for a, b in pairs if a == i} | {a for a, b in pairs if b == i} for i in range(14)}

    def brute(start, goal, depth):
        paths = [[f"N_{start}"]]
        for _ in range(depth + 1):
            done = [p for p in paths if p[-1] == f"N_{goal}"]
            if done or not paths:
                return min(done, default=None)
            paths = [[*p, f"N_{b}"] for p in paths for b in near[int(p[-1][2:])] if f"N_{b}" not in p]
        return None

    for start, goal in [(0, 9), (3, 11), (12, 1)]:
        got = tr.shortest_path(g, "N", F.col("id") == start, "N", F.col("id") == goal, 4).first()
        assert (got and got["path"]) == brute(start, goal, 4)


@pytest.mark.parametrize(
    "query",
    [
        lambda g: agg.sources_per_far_value(g, "CONTAINS", "BELONGS_TO", "name"),
        lambda g: agg.category_distribution(g),
        lambda g: agg.degrees(g),
        lambda g: agg.supplier_dependency(g),
        lambda g: anchored.customer_orders(g, F.lit(True)),
    ],
    ids=["far_value", "distribution", "degrees", "dependency", "customer_orders"],
)
def test_tasks_grow_with_rows(spark, monkeypatch, query):
    want, small = final_plan(query(graph(spark)))
    assert "REPARTITION_BY_NUM" not in small
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(plan, "TASK_ROWS", 1)
    monkeypatch.setattr(agg, "HEAD_BLOCK", 2)
    monkeypatch.setattr(anchored, "small_side", lambda df: df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got, steps = final_plan(query(graph(spark)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got == want
    assert "REPARTITION_BY_NUM" in steps


def test_lists_are_a_few_bytes():
    rng = random.Random(4)
    rows = [[], [1], [5, 5, 5], [1 << 62], [0, 1 << 40], *(sorted(rng.randrange(1, 10**n) for _ in range(30)) for n in range(1, 12))]
    for part in (rows, rows[:1], [], rows[1:] + rows[:1]):
        packed = lists.pack(pa.array(part, pa.list_(pa.int64())))
        at, numbers = lists.unpack(packed)
        assert [[int(x) for x in numbers[at == i]] for i in range(len(part))] == part
    dense = lists.pack(pa.array([list(range(1, 3000, 100))], pa.list_(pa.int64())))
    assert len(dense[0].as_py()) == 30  # 240 as numbers
    at, numbers = lists.unpack(pa.concat_arrays([dense, pa.nulls(2, pa.binary()), dense]).slice(1))
    assert set(at) == {2} and len(numbers) == 30


def test_sums_of_orders_in_any_batches(monkeypatch):
    rng = random.Random(6)
    amounts = {o: [rng.choice([None, 7, -3, 1 << 40]) for _ in range(rng.choice([0, 1, 1, 2]))] for o in range(12)}
    listed = [(o, sorted(rng.randrange(1, 9) for _ in range(rng.randrange(5)))) for o in range(12) for _ in range(rng.randrange(5))]
    rows = sorted([(o, None, c) for o, cs in amounts.items() for c in cs] + [(o, h, None) for o, h in listed], key=lambda r: (r[0], r[1] is not None))
    want = {}
    for head in range(1, 9):
        own = [(o, h.count(head)) for o, h in listed if head in h and amounts[o]]
        if own:
            c = {o: max((x for x in amounts[o] if x is not None), default=None) for o, _ in own}
            priced = [x for x in c.values() if x is not None]
            paths = sum(c[o] * n * len(amounts[o]) for o, n in own if c[o] is not None)
            want[head] = (len(c), len(priced), paths, sum(priced))
    for size, most in ((1, 100), (3, 100), (1000, 100), (1, 0), (4, 0)):
        monkeypatch.setattr(agg, "MAX_HEADS", most)
        sums, found = agg._OrderSums(8), {}
        batches = [rows[i : i + size] for i in range(0, len(rows), size)]
        parts = [x for b in batches for x in sums.add(pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in b]), lists.pack(pa.array([r[1] or [] for r in b], pa.list_(pa.int64()))) if all(r[1] is not None for r in b)
            else pa.array([None if r[1] is None else lists.pack(pa.array([r[1]], pa.list_(pa.int64())))[0].as_py() for r in b], pa.binary()),
            pa.array([r[2] for r in b], pa.int64())], ["order", "heads", "c"]))]
        for part in [*parts, *sums.end()]:
            for head, orders, known, hi, lo, hi1, lo1 in zip(*(x.to_pylist() for x in part.columns), strict=True):
                was = found.get(head, (0, 0, 0, 0))
                found[head] = tuple(a + b for a, b in zip(was, (orders, known, (hi << 31) + lo, (hi1 << 31) + lo1), strict=True))
        assert {h: v for h, v in found.items() if v[0]} == want


def test_suppliers_travel_as_numbers(spark):
    t = tables(spark)
    lines = [(1, 10, 100, 7), (2, 10, 101, 7), (3, 11, 100, 8), (4, 99, 102, 8), (5, 11, 999, 7), (6, 12, 103, 9), (7, 12, 103, 55), (8, 13, None, 7), (9, 14, 100, 6)]
    t["items"] = spark.createDataFrame(lines, "line long, order_id long, product_id long, supplier_id long")
    t["suppliers"] = spark.createDataFrame([(6, "South"), (7, "North"), (8, "South"), (9, None)], "id long, name string")
    spec = GraphSpec(SPEC.nodes, tuple(
        EdgeSpec("SUPPLIED_BY", "Part", "Supplier", "items", "product_id", "supplier_id") if e.name == "SUPPLIED_BY"
        else EdgeSpec("CONTAINS", "Order", "Part", "items", "order_id", "product_id") if e.name == "CONTAINS" else e for e in SPEC.edges))
    found, steps = final_plan(agg.supplier_dependency(PropertyGraph.build(spec, t)).select("supplier", "products", "orders", "revenue", "revenue_distinct"))
    # order 99 does not exist, so part 102 counts for nobody; order 11 has part 100 of both keys of South
    assert found == [
        repr(Row(supplier="North", products=2, orders=3, revenue=round(2 * 100 + 50.5 + 5) * 1.0, revenue_distinct=round(100 + 50.5 + 5) * 1.0)),
        repr(Row(supplier="South", products=1, orders=3, revenue=round(2 * (100 + 50.5 + 5)) * 1.0, revenue_distinct=round(100 + 50.5 + 5) * 1.0)),
        repr(Row(supplier="Supplier #9", products=1, orders=1, revenue=30.0, revenue_distinct=30.0)),
    ]
    assert "MapInArrow" in steps


def test_rivals_are_found_by_numbers(spark):
    rng = random.Random(8)
    t = tables(spark)
    parts = [(100 + i, rng.choice(["pen", "ink", "cup", "mug", "jar"]), 1.0, rng.choice([1, 2, 3, 9])) for i in range(12)]
    named = {1: "North", 2: "South", 3: "South", 4: "East", 5: "West"}
    lines = sorted({(rng.randrange(98, 114), rng.choice([1, 1, 2, 3, 4, 5, 77])) for _ in range(16)})
    t["products"] = spark.createDataFrame(parts, "id long, name string, price double, category_id long")
    t["suppliers"] = spark.createDataFrame([*named.items(), (4, "East")], "id long, name string")
    t["offers"] = spark.createDataFrame([(i, 10, p, s) for i, (p, s) in enumerate(lines * 2)], "line long, order_id long, product_id long, supplier_id long")
    spec = GraphSpec(SPEC.nodes, tuple(
        EdgeSpec("SUPPLIED_BY", "Part", "Supplier", "offers", "product_id", "supplier_id") if e.name == "SUPPLIED_BY" else e for e in SPEC.edges))
    brands = {1: "Desk", 2: "Kitchen", 3: "Glass"}
    about = {i: (brands.get(c), n) for i, n, _, c in parts}
    offers = {(about[p][0], named[s], about[p][1]) for p, s in lines if p in about and s in named and about[p][0]}
    want = set()
    for own in ("North", "South"):
        for category in {c for c, s, _ in offers if s == own}:
            rivals = [(s, n) for c, s, n in offers if c == category and s != own]
            want |= {(own, category, "alternative_supplier", s) for s, _ in rivals} | {(own, category, "alternative_product", n) for _, n in rivals}
    g = PropertyGraph.build(spec, t)
    rows = anchored.supplier_alternatives(g, F.col("name").isin("North", "South"))
    found = [tuple(r) for r in rows.select("supplier", "category", "kind", "item").collect()]
    assert sorted(found) == sorted(want) and len(want) > 4
    # a number per part and category travels, not every pair of names
    assert "min(head" in rows._jdf.queryExecution().optimizedPlan().toString()
    supplied = {(r["kind"], r["item"]) for r in anchored.supplier_impact(g, F.col("name") == "South").collect() if r["kind"] == "product"}
    assert supplied == {("product", about[p][1]) for p, s in lines if p in about and named.get(s) == "South"}


def test_values_of_middles_are_folded_in_many_tasks(spark, monkeypatch):
    g = graph(spark)
    monkeypatch.setattr(agg, "sized", lambda df: df)
    mid = agg._values_of_middles(g, "CONTAINS", "BELONGS_TO", agg.prop_of(g, "Brand", "name", "dst", "category"))
    # whatever the estimates say, the few values travel, not the many rows that lead to them
    assert "rightHint=(strategy=broadcast)" in mid._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(plan, "TASK_ROWS", 1)
    numbers = spark.range(100).withColumnRenamed("id", "src")
    assert plan.dealt(numbers, 100, "src").rdd.getNumPartitions() == 100
    # never fewer tasks than a join would deal the rows over once more
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    few = spark.sparkContext.defaultParallelism + 1
    spark.conf.set("spark.sql.shuffle.partitions", few + 5)
    try:
        assert plan.dealt(numbers, few, "src").rdd.getNumPartitions() == few + 5
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    # the sources are looked up in the dealt rows, not before
    steps = agg._targets(g, "CONTAINS")._jdf.queryExecution().optimizedPlan().toString()
    assert steps.index("Join") < steps.index("RepartitionByExpression")


def test_cells_are_trimmed_once(spark):
    spec = TableSpec("t", (ColumnSpec("a", "BIGINT", nullable=False), ColumnSpec("b", "DECIMAL(12,2)"), ColumnSpec("c", "POINT")))
    rows = [(" 1 ", "2.5", "x"), ("", "NULL", " "), ("z", "\t", None), ("3", "no", "y"), (None, "1e3\n", "\u2028"), ("4\u00a0", " ", "")]
    df = spark.createDataFrame(rows, "a string, b string, c string").select(*[F.concat(c, F.lit(" ")).alias(c) for c in "abc"])
    good, bad = csv.coerce(df, spec)
    assert sorted(map(tuple, good.collect())) == [(1, 2.5, "x")]
    assert sorted((r["column"], r["message"]) for r in bad.collect()) == sorted([
        ("a", "empty value for non-nullable column"), ("a", "cannot convert 'z' to integer"), ("b", "cannot convert 'no' to float"),
        ("a", "empty value for non-nullable column"), ("a", "cannot convert '4\u00a0' to integer"),
    ])
    for frame in (good, bad):
        assert frame._jdf.queryExecution().optimizedPlan().toString().count("trim(") == 3


def test_columns_are_trimmed_as_texts_are(spark):
    odd = ["", " ", "a", " a\t", "\n a b \x0b\f\r\n", "a \u2028", "a\u0085", " \u2029 ", "\u2028", "a \u2028\u2028", "\u00a0a\u00a0", "\x1ca\x1c", None]
    both = spark.createDataFrame([(t,) for t in odd], "t string").select(tx.strip(F.col("t")), tx.strip_column("t"))
    assert [r[0] for r in both.collect()] == [r[1] for r in both.collect()]


@pytest.mark.parametrize("size, overlap", [(25, 5), (7, 0), (10, 9)])
def test_long_texts_are_cut_in_blocks(spark, monkeypatch, size, overlap):
    monkeypatch.setattr(chunks, "BLOCK_WINDOWS", 3)
    stride = size - overlap
    bodies = {n: "".join(chr(97 + i % 26) for i in range(n)) for n in {1, size, size + 1, 3 * stride, 3 * stride + overlap, 3 * stride + overlap + 1, 400}}
    df = spark.createDataFrame(list(bodies.items()), "id long, text string")
    want = {(n, *c, len(c[3])) for n, body in bodies.items() for c in chunks.split_text(body, "fixed", size, overlap)}
    assert {tuple(r) for r in chunks.fixed_chunks(df, "text", size, overlap).collect()} == {
        (n, i, s, e, t, k) for n, i, s, e, t, k in want
    }


@pytest.mark.parametrize("strategy", ["sentence", "recursive"])
def test_chunks_leave_python_in_pieces(spark, monkeypatch, strategy):
    monkeypatch.setattr(chunks, "PIECE_CHARS", 40)
    texts = [(i, "x", f"One is {i}. Two is more.\n\nThree ends here. " * i) for i in range(6)] + [(9, None, None)]
    df = spark.createDataFrame(texts, "id long, tag string, text string")
    got = chunks.chunk_documents(df, strategy=strategy, size=60, overlap=20)
    want = [(i, tag, *c, len(c[3])) for i, tag, t in texts for c in chunks.split_text(t, strategy, 60, 20)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
