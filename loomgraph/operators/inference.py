"""Inferred edges: bounded closure, property chains, inverses, cycle reports."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import PropertyGraph, union_all
from loomgraph.operators.ranking import top_k_per
from loomgraph.session import settle
from loomgraph.spec import EdgeSpec

CLOSURE_SUFFIX = "_CLOSURE"


@dataclass(frozen=True)
class ClosureRule:
    rel: str
    min_hops: int = 2
    max_hops: int = 5


@dataclass(frozen=True)
class ChainRule:
    name: str
    rels: tuple[str, ...]


@dataclass(frozen=True)
class InverseRule:
    rel: str
    inverse: str


def _walks(base: DataFrame, longest: int) -> list[DataFrame]:
    """Distinct (src, dst) joined by a walk of exactly 1, 2, ... edges; every length is stored."""
    return [base, *_walks_on(base, base, longest - 1)]


def _closing(levels: Sequence[DataFrame], longest: int) -> DataFrame:
    """(src, dst, hops): pairs joined both ways, by the shortest closed walk through both of at most ``longest`` edges.

    A closed walk is met in the middle: only levels up to half of it are needed.
    """
    met = []
    for hops in range(2, longest + 1):
        there, back = levels[hops // 2 - 1], levels[hops - hops // 2 - 1]
        reverse = back.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
        met.append(there.join(reverse, ["src", "dst"], "left_semi").withColumn("hops", F.lit(hops).cast("long")))
    if not met:
        raise ValueError("a closed walk has at least two edges")
    return union_all(met)


def _repeatable(base: DataFrame, levels: Sequence[DataFrame], max_hops: int) -> DataFrame:
    """Edges a walk of ``max_hops`` edges can use twice: loops, and those whose end reaches their start soon enough."""
    again = [base.where("src = dst")]
    for level in levels[: max(0, max_hops - 2)]:
        reverse = level.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
        again.append(base.join(reverse, ["src", "dst"], "left_semi"))
    return union_all(again).distinct()


def closure(edges: DataFrame, min_hops: int = 2, max_hops: int = 5) -> DataFrame:
    """Distinct (src, dst), src <> dst, joined by a trail of min..max edges.

    A trail never uses an edge twice.  Only an edge on a short cycle can be used
    twice within ``max_hops`` edges, so these are found first.  Where there are
    none, walks are trails, and a level is its distinct pairs.  Otherwise a trail
    carries the edges of short cycles it has used, no others: outside of cycles
    it still folds to its two ends, and inside trails that used the same edges
    fold to one.
    """
    if not 1 <= min_hops <= max_hops:
        raise ValueError("need 1 <= min_hops <= max_hops")
    base = settle(edges.select("src", "dst").distinct())
    levels = _walks(base, max(1, max_hops - 2))
    cyclic = settle(_repeatable(base, levels, max_hops))
    if cyclic.isEmpty():
        levels += _walks_on(levels[-1], base, max_hops - len(levels))
        return union_all(levels[min_hops - 1 : max_hops]).where("src <> dst").distinct()
    step = settle(
        base.join(cyclic.withColumn("_again", F.lit(True)), ["src", "dst"], "left")
        .select(F.col("src").alias("dst"), F.col("dst").alias("_to"), F.coalesce("_again", F.lit(False)).alias("_again"))
    )
    edge = F.struct(F.col("dst").alias("src"), F.col("_to").alias("dst"))
    used = F.when(F.col("_again"), F.array_sort(F.concat("_walked", F.array(edge)))).otherwise(F.col("_walked"))
    nothing = F.array().cast(f"array<struct<src:{base.schema['src'].dataType.simpleString()},dst:{base.schema['dst'].dataType.simpleString()}>>")
    trails = base.select("src", F.col("src").alias("dst")).distinct().withColumn("_walked", nothing)
    found = []
    for length in range(1, max_hops + 1):
        trails = settle(
            trails.join(step, "dst").where(~F.col("_again") | ~F.array_contains("_walked", edge))
            .select("src", F.col("_to").alias("dst"), used.alias("_walked")).distinct()
        )
        if length >= min_hops:
            found.append(trails.select("src", "dst"))
    return union_all(found).where("src <> dst").distinct()


def _walks_on(last: DataFrame, base: DataFrame, more: int) -> list[DataFrame]:
    """The ``more`` levels after ``last``."""
    step = base.select(F.col("src").alias("dst"), F.col("dst").alias("_to"))
    levels = []
    for _ in range(more):
        last = settle(last.join(step, "dst").select("src", F.col("_to").alias("dst")).distinct())
        levels.append(last)
    return levels


def infer_closure(g: PropertyGraph, rule: ClosureRule) -> PropertyGraph:
    """Add ``{rel}_CLOSURE`` edges of a relation from a label to itself."""
    spec = g.spec.edge(rule.rel)
    if spec.source != spec.target:
        raise ValueError(f"{rule.rel} does not lead from a label to itself")
    pairs = closure(g.edges(rule.rel), rule.min_hops, rule.max_hops)
    return _add(g, spec, rule.rel + CLOSURE_SUFFIX, spec.source, spec.target, pairs, "owl_transitive")


def infer_chain(g: PropertyGraph, rule: ChainRule) -> PropertyGraph:
    """Add an edge a -> b for every chain of relations from a to b, a <> b."""
    if len(rule.rels) < 2:
        raise ValueError("a chain needs at least two relations")
    first = g.spec.edge(rule.rels[0])
    pairs, label = g.edges(rule.rels[0]).select("src", "dst"), first.target
    for rel in rule.rels[1:]:
        spec = g.spec.edge(rel)
        if spec.source != label:
            raise ValueError(f"{rel} does not start at {label}")
        following = g.edges(rel).select(F.col("src").alias("dst"), F.col("dst").alias("_to"))
        pairs = pairs.join(following, "dst").select("src", F.col("_to").alias("dst")).distinct()
        label = spec.target
    if first.source == label:
        pairs = pairs.where("src <> dst")
    return _add(g, first, rule.name, first.source, label, pairs, "owl_chain_fallback")


def infer_inverse(g: PropertyGraph, rule: InverseRule) -> PropertyGraph:
    """Add the reversed edges under the inverse name."""
    spec = g.spec.edge(rule.rel)
    pairs = g.edges(rule.rel).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return _add(g, spec, rule.inverse, spec.target, spec.source, pairs, "owl_inverse")


def apply_rules(g: PropertyGraph, rules: Sequence[ClosureRule | ChainRule | InverseRule]) -> PropertyGraph:
    steps = {ClosureRule: infer_closure, ChainRule: infer_chain, InverseRule: infer_inverse}
    for rule in rules:
        g = steps[type(rule)](g, rule)
    return g


def _add(
    g: PropertyGraph, like: EdgeSpec, name: str, source: str, target: str, pairs: DataFrame, derivation: str
) -> PropertyGraph:
    spec = replace(
        like, name=name, source=source, target=target, props={"inferred": "inferred", "derivation": "derivation"},
        merge_order=(), unique=True, derivation=derivation,
    )
    frame = pairs.withColumn("inferred", F.lit(True)).withColumn("derivation", F.lit(derivation))
    return g.with_edges(spec, frame)


def inferred_keys(g: PropertyGraph) -> list[tuple[str, str, str]]:
    return [e.key for e in g.spec.edges if "inferred" in e.props]


def drop_inferred(g: PropertyGraph) -> tuple[PropertyGraph, DataFrame]:
    """The graph without inferred edges, and the number dropped per type."""
    gone = inferred_keys(g)
    counts = union_all([g.edges(*k).where("inferred").select(F.lit(k[0]).alias("rel_type")) for k in gone])
    kept = [k for k in g.edge_keys if k not in gone]
    return g.restrict(g.labels, kept), counts.groupBy("rel_type").agg(F.count(F.lit(1)).alias("deleted"))


def closure_context(g: PropertyGraph, label: str, anchors: DataFrame, per_type: int = 5) -> DataFrame:
    """Up to ``per_type`` closure targets per anchor and closure type.

    ``anchors`` has one column ``src`` of node keys of ``label``.
    """
    frames = []
    for name, source, target in g.edge_keys:
        if name.endswith(CLOSURE_SUFFIX) and source == label:
            hits = g.edges(name, source, target).join(anchors, "src", "left_semi")
            named = hits.join(g.nodes(target).select(F.col("id").alias("dst"), "name"), "dst")
            frames.append(
                named.select("src", F.lit(name).alias("rel"), F.lit(target).alias("label"), "name", "dst")
            )
    if not frames:
        raise ValueError(f"no closure type leaves {label}")
    return top_k_per(union_all(frames), ["src", "rel"], per_type, [F.asc("dst")])


def cyclic_nodes(edges: DataFrame, max_hops: int = 5) -> DataFrame:
    """Nodes that reach themselves in 2..max_hops hops, with the fewest; self-loops are ignored.

    A closed walk is met in the middle: its first half leads from the node to
    where its second half returns from, so pairs are followed over half of
    ``max_hops`` only.
    """
    base = settle(edges.select("src", "dst").where("src <> dst").distinct())
    hits = _closing(_walks(base, -(-max_hops // 2)), max_hops)
    return hits.groupBy("src").agg(F.min("hops").alias("hops"))


def type_cycles(g: PropertyGraph, max_hops: int = 5) -> DataFrame:
    """Labels on a cycle of edge types; one row per label pair, read from the spec."""
    pairs = sorted({(k[1], k[2]) for k in g.edge_keys if k[1] != k[2]})
    spark = g.nodes(g.labels[0]).sparkSession
    return cyclic_nodes(spark.createDataFrame(pairs, "src string, dst string"), max_hops)
