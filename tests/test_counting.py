"""Shared counts against the frames they stand for."""

from collections import Counter

from loomgraph import EdgeSpec, GraphSpec, NodeSpec, PropertyGraph
from loomgraph.operators.counting import element_counts
from loomgraph.operators.maintenance import load_report
from tests.shop import SPEC, graph, tables

AWKWARD = GraphSpec(
    nodes=(
        NodeSpec("Town", "towns", "code", unique=True),
        NodeSpec("Colour", "things", "colour"),
        NodeSpec("Thing", "things", "id", unique=True),
        NodeSpec("Ghost", "ghosts", "id"),
    ),
    edges=(
        EdgeSpec("IN", "Thing", "Town", "things", "id", "town", unique=True),
        EdgeSpec("PAINTED", "Thing", "Colour", "things", "id", "colour", unique=True),
        EdgeSpec("NEAR", "Town", "Town", "roads", "a", "b"),
        EdgeSpec("SENT", "Thing", "Town", "roads", "thing", "a"),
        EdgeSpec("LIKE", "Thing", "Thing", "roads", "thing", "other", unique=True),
        EdgeSpec("HAUNTS", "Ghost", "Town", "ghosts", "id", "town"),
    ),
)


def awkward_tables(spark):
    return {
        "towns": spark.createDataFrame([("", ), ("x",), ("y",), ("0",)], "code string"),
        "things": spark.createDataFrame(
            [(0, "red", "x"), (1, "red", "y"), (2, None, "x"), (3, "blue", "nowhere"), (4, "red", None), (5, "", "")],
            "id int, colour string, town string",
        ),
        "roads": spark.createDataFrame(
            [("x", "y", 1, 2), ("x", "y", 1, 3), ("y", "x", None, 0), ("x", None, 0, 9), ("z", "x", 8, 1), (None, None, 0, 0)],
            "a string, b string, thing long, other string",
        ),
        "ghosts": spark.createDataFrame([], "id long, town string"),
    }


def by_hand(g):
    found = Counter()
    for label in g.labels:
        found["node", label] += g.nodes(label).count()
    for key in g.edge_keys:
        found["edge", key[0]] += g.edges(*key).count()
    return {k: n for k, n in found.items() if n}


def shared(g):
    found = Counter()
    for r in element_counts(g).collect():
        assert r.what == "stored"
        found[r.kind, r.name] += r.n
    return dict(found)


def test_shop_and_awkward_keys(spark):
    awkward = PropertyGraph.build(AWKWARD, awkward_tables(spark))
    assert shared(awkward) == by_hand(awkward)
    assert shared(awkward)["edge", "IN"] == 4 and ("node", "Ghost") not in shared(awkward)
    shop = graph(spark)
    assert shared(shop) == by_hand(shop)


def test_restricted_and_given_frames(spark):
    shop = graph(spark)
    some = shop.restrict(["Customer", "Order", "Part"], [k for k in shop.edge_keys if k[0] in ("PLACED", "CONTAINS")])
    assert shared(some) == by_hand(some)
    spec = EdgeSpec("AGAIN", "Order", "Part", "items", "order_id", "product_id")
    more = shop.with_edges(spec, shop.edges("CONTAINS").limit(2))
    assert shared(more) == by_hand(more) and shared(more)["edge", "AGAIN"] == 2


def test_offered_rows(spark):
    t = awkward_tables(spark)
    report = {r["name"]: (r["offered"], r["stored"]) for r in load_report(AWKWARD, t, PropertyGraph.build(AWKWARD, t)).collect()}
    assert report == {
        "Town": (4, 4), "Colour": (6, 3), "Thing": (6, 6), "IN": (5, 4), "PAINTED": (5, 5), "NEAR": (4, 2), "SENT": (4, 2),
        "LIKE": (5, 3),
    }
    offered = {r["name"]: r["offered"] for r in load_report(SPEC, tables(spark), graph(spark)).collect()}
    assert offered["CONTAINS"] == 8 and offered["Customer"] == 4
