"""Pattern queries: lookups, filters, traversals."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.plan import sized, small_side
from loomgraph.graph import PropertyGraph, node_id

# The comparison operators a caller may name.
COMPARISONS = {
    "=": lambda c, v: c == v,
    "<>": lambda c, v: c != v,
    ">": lambda c, v: c > v,
    "<": lambda c, v: c < v,
    ">=": lambda c, v: c >= v,
    "<=": lambda c, v: c <= v,
    "CONTAINS": lambda c, v: c.contains(v),
    "STARTS WITH": lambda c, v: c.startswith(v),
    "ENDS WITH": lambda c, v: c.endswith(v),
}


def compare(column: str | Column, op: str, value: object) -> Column:
    if op not in COMPARISONS:
        raise ValueError(f"operator not allowed: {op}")
    col = F.col(column) if isinstance(column, str) else column
    return COMPARISONS[op](col, F.lit(value))


def property_lookup(g: PropertyGraph, label: str, match: str, value: object, returns: str) -> DataFrame:
    return g.nodes(label).where(F.col(match) == F.lit(value)).select(F.col(returns).alias("result"))


def one_of(g: PropertyGraph, label: str, prop: str, values: Sequence[object], returns: str) -> DataFrame:
    return g.nodes(label).where(F.col(prop).isin(list(values))).select(F.col(returns).alias("result"))


def text_search(g: PropertyGraph, term: str) -> DataFrame:
    """Case-insensitive substring over display name, id and label; blank finds nothing."""
    v = g.vertices()
    needle = term.lower()
    if not term.strip():
        return v.where(F.lit(False))
    return v.where(
        F.lower("display_name").contains(needle) | F.lower("id").contains(needle) | F.lower("label").contains(needle)
    )


def filter_graph(g: PropertyGraph, labels: Sequence[str], rel_types: Sequence[str]) -> PropertyGraph:
    """Induced subgraph by label and edge type.

    Visibility of an endpoint is decided by its label, so edge types touching a
    hidden label fall away without reading them.
    """
    keep = [k for k in g.edge_keys if k[0] in rel_types and k[1] in labels and k[2] in labels]
    return g.restrict(labels, keep)


def for_tenant(vertices: DataFrame, edges: DataFrame, tenant: str) -> tuple[DataFrame, DataFrame]:
    """Vertices of a tenant; edges only when both ends belong to it."""
    mine = vertices.where(F.col("tenant_id") == tenant)
    ids = mine.select("id")
    kept = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("id", "dst"), "dst", "left_semi"
    )
    return mine, kept.select(*edges.columns)


def resolve_ids(g: PropertyGraph, label: str, prop: str, values: DataFrame) -> DataFrame:
    """Distinct composite ids of the nodes whose ``prop`` occurs in ``values.value``."""
    wanted = values.select(F.col("value").alias(prop)).distinct()
    hits = g.nodes(label).join(wanted, prop, "left_semi")
    return hits.select(node_id(label, F.col("id")).alias("id")).distinct()


# ---- traversal ---------------------------------------------------------------


@dataclass(frozen=True)
class Hop:
    """One step: an edge type, followed forwards or backwards."""

    rel: str
    forward: bool = True
    source: str | None = None
    target: str | None = None


def out(rel: str) -> Hop:
    return Hop(rel)


def back(rel: str) -> Hop:
    return Hop(rel, forward=False)


def anchor_ids(g: PropertyGraph, label: str, condition: Column) -> DataFrame:
    return small_side(g.nodes(label).where(condition).select(F.col("id").alias("at")))


def step(g: PropertyGraph, frontier: DataFrame, hop: Hop, check: bool = True) -> DataFrame:
    """Advance a frontier of ids ``at``; arrivals are distinct.

    Only the returned property is distinct in a pattern query, so arriving at
    one node over many paths adds nothing and is folded at once.  ``check``
    looks arrivals up among the nodes where the edge rows do not prove them.
    """
    here, there = ("src", "dst") if hop.forward else ("dst", "src")
    rows, unchecked = g.links(hop.rel, hop.source, hop.target)
    edges = rows.select(F.col(here).alias("at"), F.col(there).alias("next"))
    arrived = frontier.join(edges, "at").select(F.col("next").alias("at")).distinct()
    arrived = sized(arrived)
    if check and there in unchecked:
        known = g.nodes(unchecked[there]).select(F.col("id").alias("at"))
        arrived = arrived.join(known, "at")
    return arrived


def walk(g: PropertyGraph, frontier: DataFrame, hops: Sequence[Hop], check_last: bool = True) -> DataFrame:
    for i, hop in enumerate(hops):
        if i:
            frontier = sized(frontier)
        frontier = step(g, frontier, hop, check_last or i + 1 < len(hops))
    return frontier


def endpoint_label(g: PropertyGraph, hop: Hop) -> str:
    spec = g.spec.edge(hop.rel, hop.source, hop.target)
    return spec.target if hop.forward else spec.source


def reach(
    g: PropertyGraph,
    label: str,
    condition: Column,
    hops: Sequence[Hop],
    returns: str,
) -> DataFrame:
    """Distinct property of the nodes at the end of a chain of hops.

    One to three hops in any direction cover the one-hop, two-hop, three-hop,
    reverse, filtered and status-filtered patterns.
    """
    arrived = walk(g, anchor_ids(g, label, condition), hops, check_last=False)
    end = g.nodes(endpoint_label(g, hops[-1]))
    return (
        end.join(arrived.withColumnRenamed("at", "id"), "id", "left_semi")
        .select(F.col(returns).alias("result"))
        .distinct()
    )


def common_neighbor(
    g: PropertyGraph, label: str, prop: str, first: object, second: object, hops: Sequence[Hop], returns: str
) -> DataFrame:
    """Distinct property of the nodes both anchors reach."""
    a = walk(g, anchor_ids(g, label, F.col(prop) == F.lit(first)), hops, check_last=False)
    b = walk(g, anchor_ids(g, label, F.col(prop) == F.lit(second)), hops, check_last=False)
    both = a.join(b, "at", "left_semi").withColumnRenamed("at", "id")
    end = g.nodes(endpoint_label(g, hops[-1]))
    return end.join(both, "id", "left_semi").select(F.col(returns).alias("result")).distinct()


def optional_match(g: PropertyGraph, label: str, rel: str, returns: Sequence[str]) -> DataFrame:
    """Every node of ``label`` with a flag telling whether it has an edge ``rel``."""
    has = g.edges(rel).select(F.col("src").alias("id")).distinct().withColumn("_hit", F.lit(True))
    return (
        g.nodes(label)
        .join(has, "id", "left")
        .select("id", *returns, F.coalesce("_hit", F.lit(False)).alias("matched"))
    )


def without_edge(frame: DataFrame, column: str, excluded: DataFrame) -> DataFrame:
    """Anti pattern: rows whose ``column`` is not among ``excluded.at``."""
    return frame.join(excluded.select(F.col("at").alias(column)).distinct(), column, "left_anti")


def edge_property_of_anchor(
    g: PropertyGraph, label: str, condition: Column, first: Hop, rel: str, prop: str
) -> DataFrame:
    """Anchor -> middle, then a property carried by the edge leaving the middle."""
    middle = walk(g, anchor_ids(g, label, condition), [first]).withColumnRenamed("at", "src")
    return (
        g.edges(rel)
        .join(middle, "src", "left_semi")
        .select(F.col("src").alias("order_id"), F.col(prop).alias("result"))
    )


def orders_with_payment(g: PropertyGraph, customer: str) -> DataFrame:
    orders = walk(g, anchor_ids(g, "Customer", F.col("name") == customer), [out("PLACED")])
    paid = g.edges("PAID_BY").join(orders.withColumnRenamed("at", "src"), "src", "left_semi")
    return paid.join(g.nodes("Payment").select(F.col("id").alias("dst"), "method"), "dst").select(
        F.col("src").alias("order_id"), F.col("method").alias("result")
    )


def orders_by_coupon(g: PropertyGraph, code: str) -> DataFrame:
    orders = walk(g, anchor_ids(g, "Coupon", F.col("id") == code), [back("USED_COUPON")])
    return (
        g.nodes("Order")
        .join(orders.withColumnRenamed("at", "id"), "id", "left_semi")
        .select(F.col("id").alias("order_id"), F.col("total_amount").alias("amount"))
    )


def nodes_at(g: PropertyGraph, label: str, rel: str, prop: str, fragment: str, returns: str) -> DataFrame:
    """Property of the nodes whose ``rel`` target contains ``fragment``; not distinct."""
    spec = g.spec.edge(rel)
    places = g.nodes(spec.target).where(F.col(prop).contains(fragment)).select(F.col("id").alias("dst"))
    hits = g.edges(rel).join(small_side(places), "dst").select(F.col("src").alias("id"))
    return g.nodes(label).join(hits, "id").select(F.col(returns).alias("result"))


def evidence_paths(rows: DataFrame, pieces: Sequence[str | Column]) -> DataFrame:
    """One readable path per row from literals and columns."""
    parts = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("?")) for p in pieces]
    return rows.select(F.concat(*parts).alias("path"))
