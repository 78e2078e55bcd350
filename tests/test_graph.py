import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from loomgraph import EdgeSpec, GraphSpec, NodeSpec, PropertyGraph
from loomgraph.operators import aggregates as agg
from loomgraph.operators import anchored, inference
from loomgraph.operators import patterns as pat
from loomgraph.operators import traversal as tr
from loomgraph.operators.maintenance import load_report, read_graph, write_graph
from loomgraph.operators.patterns import back, out
from loomgraph.session import shared_dir
from tests.shop import SPEC, graph, rows_of, tables


@pytest.fixture(scope="module")
def shop(spark):
    return graph(spark)


def test_edges_are_merged_and_checked(shop):
    assert rows_of(shop.edges("CONTAINS"), "src", "dst", "quantity") == [
        (10, 100, 5), (10, 101, 2), (11, 102, 1), (12, 100, 1), (12, 103, 1), (13, 103, 2),
    ]
    # order 14 has an unknown customer
    assert rows_of(shop.edges("PLACED"), "dst") == [(10,), (11,), (12,), (13,)]


def test_names_are_completed(shop):
    assert rows_of(shop.nodes("Customer"), "name") == [("Ann",), ("Bo",), ("Customer #4",), ("Cy",)]
    assert rows_of(shop.nodes("Coupon"), "name") == [("TEN (10%)",)]
    assert ("주문 #10 (done)",) in rows_of(shop.nodes("Order"), "name")


def test_traversals(shop):
    ann = F.col("name") == "Ann"
    assert rows_of(pat.reach(shop, "Customer", ann, [out("PLACED"), out("CONTAINS")], "name"), "result") == [
        ("cup",), ("ink",), ("pen",)
    ]
    assert rows_of(
        pat.reach(shop, "Customer", ann, [out("PLACED"), out("CONTAINS"), out("BELONGS_TO")], "name"), "result"
    ) == [("Desk",), ("Kitchen",)]
    assert rows_of(
        pat.reach(shop, "Part", F.col("name") == "pen", [back("CONTAINS"), back("PLACED")], "name"), "result"
    ) == [("Ann",), ("Bo",)]
    hops = [out("PLACED"), out("CONTAINS")]
    assert rows_of(pat.common_neighbor(shop, "Customer", "name", "Ann", "Bo", hops, "name"), "result") == [("pen",)]
    with pytest.raises(ValueError):
        pat.compare("name", "LIKE", "x")


def test_dangling_rows_do_not_leak_into_walks(spark, shop):
    """Raw rows point at product 999 and customer 9, which do not exist."""
    parts = pat.walk(shop, pat.anchor_ids(shop, "Order", F.lit(True)), [out("CONTAINS")])
    assert 999 not in {r["at"] for r in parts.collect()}
    owners = pat.walk(shop, pat.anchor_ids(shop, "Order", F.lit(True)), [back("PLACED")])
    assert {r["at"] for r in owners.collect()} == {1, 2, 3}


def test_aggregates(shop):
    assert rows_of(agg.coupon_comparison(shop), "coupon_status", "order_count", "avg_amount") == [
        ("unused", 3, 28.58), ("used", 2, 85.0)
    ]
    assert rows_of(agg.product_ratings(shop), "product", "avg_rating", "review_count") == [
        ("mug", 4.5, 1), ("pen", 4.67, 3)
    ]
    assert rows_of(agg.top_far_values(shop, "CONTAINS", "BELONGS_TO", "name", 5), "category", "order_count") == [
        ("Desk", 2), ("Kitchen", 3)
    ]
    assert rows_of(agg.supplier_dependency(shop), "supplier", "products", "orders", "revenue", "revenue_distinct") == [
        ("North", 2, 2, 230.0, 130.0), ("South", 2, 3, 151.0, 151.0)
    ]
    # ratings weigh by orders: pen has two orders, mug two
    assert rows_of(agg.review_quality(shop), "product", "avg_rating", "order_count") == [("mug", 4.5, 2), ("pen", 4.67, 2)]


def test_collaborative(shop):
    rows = anchored.collaborative(shop, "Ann")
    assert rows_of(rows, "recommended_product", "recommender_count", "similar_customer") == [("mug", 1, "Bo")]


@pytest.mark.parametrize("block", [2, 3, 5, 64])
def test_pair_support_splits_large_baskets(spark, block):
    """One basket holds most rows; any block size gives the brute-force counts."""
    names = {k: f"n{k % 5}" for k in range(40)}
    baskets = {1: list(range(30)), 2: [3, 8, 13], 3: [39], 4: list(range(0, 40, 3))}
    spec = GraphSpec(
        (NodeSpec("Order", "o", "id", unique=True), NodeSpec("Part", "p", "id", {"name": "name"}, unique=True)),
        (EdgeSpec("CONTAINS", "Order", "Part", "i", "o", "p"),),
    )
    data = {
        "o": spark.createDataFrame([(b,) for b in baskets], "id long"),
        "p": spark.createDataFrame(list(names.items()), "id long, name string"),
        "i": spark.createDataFrame([(b, p) for b, ps in baskets.items() for p in ps], "o long, p long"),
    }
    expected = Counter(
        (names[a], names[b]) for ps in baskets.values() for a, b in combinations(sorted(ps), 2)
    )
    got = agg.pair_support(PropertyGraph.build(spec, data), block=block).collect()
    assert {(r["product_1"], r["product_2"]): r["co_purchase_count"] for r in got} == expected


def test_neighbourhood_and_paths(shop):
    near = tr.neighbourhood_nodes(shop, "Customer_1", 1).rows
    assert {(r["label"], r["key"]) for r in near.collect()} == {("Customer", "1"), ("Order", "10"), ("Order", "11")}
    # a node without edges has no neighbourhood, not even itself
    assert tr.neighbourhood_nodes(shop, "Customer_4", 2).rows.count() == 0
    with pytest.raises(KeyError):
        tr.neighbourhood(shop, "Customer_77", 1)
    with pytest.raises(ValueError):
        tr.neighbourhood(shop, "Customer_1", 4)
    path = tr.shortest_path(shop, "Customer", F.col("name") == "Ann", "Supplier", F.col("name") == "South").first()
    assert path["path"] == ["Customer_1", "Order_11", "Part_102", "Supplier_8"] and path["hops"] == 3
    far = tr.shortest_path(shop, "Customer", F.col("name") == "Ann", "Supplier", F.col("name") == "South", 2)
    assert far.count() == 0


def test_third_hop_excludes_its_own_first_node(shop):
    hops = tr.hop_lists(shop, "Customer", F.col("name") == "Bo", 3)
    third = {r["id"] for r in hops.where("hop = 3").collect()}
    # order 12 - pen - {order 10, brand, supplier, reviews}, never order 12 over pen or mug alone
    assert "Order_10" in third and "Customer_2" not in third
    assert "Order_12" not in third


def test_closure_walks_trails(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d")], "src string, dst string")
    got = {(r["src"], r["dst"]) for r in inference.closure(edges, 2, 5).collect()}

    def trails(at, used):
        for e in [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d")]:
            if e[0] == at and e not in used:
                yield e[1], used + [e]
                if len(used) < 4:
                    yield from trails(e[1], used + [e])

    expected = {(s, t) for s in "abcd" for t, used in trails(s, []) if len(used) >= 2 and s != t}
    assert got == expected


def test_rules_and_their_removal(shop):
    g = inference.apply_rules(
        shop,
        [
            inference.ClosureRule("PARENT_OF"),
            inference.ChainRule("CUSTOMER_CATEGORY", ("PLACED", "CONTAINS", "BELONGS_TO")),
            inference.InverseRule("PLACED", "PLACED_BY"),
        ],
    )
    assert rows_of(g.edges("PARENT_OF_CLOSURE"), "src", "dst") == [(1, 3)]
    assert (1, 2) in rows_of(g.edges("CUSTOMER_CATEGORY"), "src", "dst")
    kept, counts = inference.drop_inferred(g)
    assert sorted(kept.edge_keys) == sorted(shop.edge_keys)
    assert rows_of(counts, "rel_type", "deleted")[1] == ("PARENT_OF_CLOSURE", 1)
    with pytest.raises(ValueError):
        inference.infer_closure(shop, inference.ClosureRule("PLACED"))


def test_report_and_storage(spark, shop):
    report = {r["name"]: (r["offered"], r["stored"]) for r in load_report(SPEC, tables(spark), shop).collect()}
    assert report["CONTAINS"] == (8, 6) and report["PLACED"] == (5, 4)
    folder = shared_dir(spark, "graph")
    write_graph(shop, folder)
    again = read_graph(spark, SPEC, folder)
    assert agg.graph_stats(again).exceptAll(agg.graph_stats(shop)).isEmpty()
    with pytest.raises(Exception):
        write_graph(shop, folder)


def test_spec_rules():
    with pytest.raises(ValueError):
        NodeSpec("Bad_Label", "t", "id")
    with pytest.raises(KeyError):
        SPEC.edge("NOPE")


def _trails(edges, low, high):
    """(a, b) joined by low..high distinct edges, by brute force."""
    out, edges = set(), sorted(set(edges))

    def go(start, at, used):
        if low <= len(used) <= high and start != at:
            out.add((start, at))
        if len(used) < high:
            for e in edges:
                if e[0] == at and e not in used:
                    go(start, e[1], used | {e})

    for node in {e[0] for e in edges}:
        go(node, node, frozenset())
    return out


@pytest.mark.parametrize("seed", range(6))
def test_closure_follows_trails(spark, seed):
    rng = random.Random(seed)
    nodes, count = [(9, 12), (12, 14), (6, 12), (30, 30), (4, 8), (15, 20)][seed]
    edges = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(count)]  # loops and repeats included
    if seed == 3:
        edges = [(min(e), max(e)) for e in edges if e[0] != e[1]]  # acyclic
    df = spark.createDataFrame(edges, "src long, dst long")
    for low, high in ((2, 5), (1, 3), (2, 2), (1, 1)):
        assert {tuple(r) for r in inference.closure(df, low, high).collect()} == _trails(edges, low, high)


def test_closure_of_hubs_is_linear_in_pairs(spark, monkeypatch):
    """Two layers that meet in hubs: as many stored rows as distinct pairs, however many trails join them."""
    edges = [(s, 100 + h) for s in range(20) for h in range(30)] + [(100 + h, 200 + t) for h in range(30) for t in range(20)]
    edges += [(200 + t, 300) for t in range(20)] + [(300, 301), (301, 302)]
    rows = []
    settle = inference.settle
    monkeypatch.setattr(inference, "settle", lambda df, *k: (lambda out: (rows.append(out.count()), out)[1])(settle(df, *k)))
    found = inference.closure(spark.createDataFrame(edges, "src long, dst long")).count()
    assert found == len(_pairs(edges)) and sum(rows) <= 3 * (found + len(edges))


def _pairs(edges):
    step, level, out = {}, {(a, a) for a, _ in edges}, set()
    for a, b in edges:
        step.setdefault(a, set()).add(b)
    for hops in range(1, 6):
        level = {(a, c) for a, b in level for c in step.get(b, ())}
        if hops > 1:
            out |= level
    return out


def test_cycles_by_brute_force(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(25), rng.randrange(25)) for _ in range(40)]
    step, want = {}, {}
    for a, b in edges:
        if a != b:
            step.setdefault(a, set()).add(b)
    for a in step:
        here = {a}
        for hops in range(1, 6):
            here = {c for b in here for c in step.get(b, ())}
            if a in here and hops >= 2:
                want[a] = hops
                break
    got = inference.cyclic_nodes(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {r.src: r.hops for r in got} == want
