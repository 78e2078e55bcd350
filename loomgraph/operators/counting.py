"""Counts of every label and edge type by shared scans of their source tables.

Measures that need no key are conditional counts: one aggregate per table gives
those of all types bound to it, and no shuffle.  The others (merged labels, edge
types that are merged or have an endpoint to look up) read their own key columns.
Types whose keys have the same types then travel together: they are folded by
(measure, keys) before anything is shuffled, a unique type by the endpoint to look
up alone, and looked up in the keys of all their labels at once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.graph import PropertyGraph, union_all, unchecked_sides
from loomgraph.spec import EdgeSpec, GraphSpec, NodeSpec


@dataclass(frozen=True)
class Measure:
    """What one entry stands for: ``stored`` or ``offered`` elements of a type, and the keys an entry carries.

    ``keys`` are (column, label) pairs; ``check`` tells which of them must be a
    node of that label.  ``merged`` measures count distinct keys, others rows.
    """

    kind: str
    name: str
    what: str
    table: str
    given: tuple[str, ...] = ()
    keys: tuple[tuple[str, str], ...] = ()
    check: tuple[str, ...] = ()
    merged: bool = False


def node_measures(n: NodeSpec) -> list[Measure]:
    offered = Measure("node", n.label, "offered", n.table)
    if n.unique:
        return [offered, Measure("node", n.label, "stored", n.table, (n.key,))]
    return [offered, Measure("node", n.label, "stored", n.table, (n.key,), ((n.key, n.label),), merged=True)]


def edge_measures(e: EdgeSpec, spec: GraphSpec) -> list[Measure]:
    given = (e.source_key, e.target_key)
    ends = {"src": (e.source_key, e.source), "dst": (e.target_key, e.target)}
    sides = unchecked_sides(e, spec)
    # an endpoint that needs a look-up comes first
    keys = tuple(ends[s] for s in sorted(ends, key=lambda s: s not in sides))
    if e.unique:
        keys = keys[: len(sides)]
    check = tuple(ends[s][1] for s in sorted(sides, key=lambda s: keys.index(ends[s])))
    return [
        Measure("edge", e.name, "offered", e.table, given),
        Measure("edge", e.name, "stored", e.table, given, keys, check, merged=not e.unique),
    ]


def _typed(column: Column, kind: T.DataType) -> Column:
    """A key as a number or a string, so that keys of all labels fit in two columns."""
    return column.try_cast("bigint") if isinstance(kind, T.IntegralType) else column.try_cast(kind).cast("string")


def _present(m: Measure) -> Column:
    found = F.lit(True)
    for column in m.given:
        found = found & F.col(column).isNotNull()
    return found


def _plain(measures: Mapping[str, Sequence[tuple[int, Measure]]], tables: Mapping[str, DataFrame]) -> DataFrame:
    """(m, n) of measures without keys, by table: one aggregate over one scan of each table."""
    width = max(map(len, measures.values()))
    frames, numbers = [], []
    for t, (name, group) in enumerate(measures.items()):
        held = [_present(m) for _, m in group] + [F.lit(False)] * (width - len(group))
        frames.append(tables[name].select(F.lit(t).alias("t"), *[c.alias(f"c{j}") for j, c in enumerate(held)]))
        numbers.append(F.array(*[F.lit(i) for i, _ in group] + [F.lit(-1)] * (width - len(group))))
    row = union_all(frames).groupBy("t").agg(*[F.count_if(F.col(f"c{j}")).alias(f"c{j}") for j in range(width)])
    number = F.get(F.array(*numbers), "t")
    pairs = F.array(*[F.struct(F.get(number, F.lit(j)).alias("m"), F.col(f"c{j}").alias("n")) for j in range(width)])
    return row.select(F.explode(pairs).alias("e")).select("e.*").where("n > 0")


def _keyed(
    measures: Sequence[tuple[int, Measure]], spec: GraphSpec, tables: Mapping[str, DataFrame], types: Mapping[str, T.DataType]
) -> DataFrame:
    """(m, n) of measures that agree in the types of their keys and in how many of these are looked up."""
    sample = measures[0][1]
    slots = [f"k{s}" for s in range(len(sample.keys))]
    frames = []
    for i, m in measures:
        keys = [_typed(F.col(c), types[label]).alias(k) for k, (c, label) in zip(slots, m.keys, strict=True)]
        frames.append(tables[m.table].where(_present(m)).select(F.lit(i).alias("m"), *keys))
    rest = union_all(frames).groupBy("m", *slots).agg(F.count(F.lit(1)).alias("n"))
    labels = [n.label for n in spec.nodes]
    for slot in range(len(sample.check)):
        wanted = {m.check[slot] for _, m in measures}
        known = []
        for label in sorted(wanted):
            node = spec.node(label)
            key = _typed(F.col(node.key), types[label]).alias(slots[slot])
            known.append(tables[node.table].select(F.lit(labels.index(label)).alias("label"), key).where(key.isNotNull()))
        by_measure = {i: labels.index(m.check[slot]) for i, m in measures}
        label = F.get(F.array(*[F.lit(by_measure.get(i, -1)) for i in range(max(by_measure) + 1)]), "m")
        rest = rest.withColumn("label", label).join(union_all(known), ["label", slots[slot]], "left_semi").drop("label")
    merged = [i for i, m in measures if m.merged]
    # a merged type counts a row per key, another one the rows behind the key
    return rest.select("m", F.when(F.col("m").isin(merged), F.lit(1)).otherwise(F.col("n")).alias("n"))


def measured(measures: Sequence[Measure], spec: GraphSpec, tables: Mapping[str, DataFrame]) -> DataFrame:
    """kind, name, what and ``n`` of all measures; a measure without any element has no row."""
    types = {n.label: tables[n.table].schema[n.key].dataType for n in spec.nodes if n.table in tables}
    plain: dict[str, list[tuple[int, Measure]]] = {}
    keyed: dict[tuple, list[tuple[int, Measure]]] = {}
    for i, m in enumerate(measures):
        if m.keys:
            alike = (len(m.check), *[isinstance(types[label], T.IntegralType) for _, label in m.keys])
            keyed.setdefault(alike, []).append((i, m))
        else:
            plain.setdefault(m.table, []).append((i, m))
    frames = [_plain(plain, tables)] if plain else []
    frames += [_keyed(group, spec, tables, types) for group in keyed.values()]
    described = F.array(
        *[F.struct(F.lit(m.kind).alias("kind"), F.lit(m.name).alias("name"), F.lit(m.what).alias("what")) for m in measures]
    )
    counted = union_all(frames).groupBy("m").agg(F.sum("n").alias("n"))
    return counted.select(F.get(described, "m").alias("d"), "n").select("d.*", "n")


def element_counts(g: PropertyGraph, tables: Mapping[str, DataFrame] | None = None, offered: bool = False) -> DataFrame:
    """kind, name, what ('stored', and 'offered' if asked) and ``n`` per label and edge type, several rows if a name repeats.

    Types built from tables share their scans; stored or inferred ones are
    counted as they are.  ``offered`` counts source rows, for edges those with
    both endpoints set, and needs ``tables``.
    """
    measures, frames = [], []
    for n in g.spec.nodes:
        if n.label in g.labels:
            both = node_measures(n)
            measures += both[:1] if offered else []
            if g.is_bound(n.label):
                measures += both[1:]
            else:
                frames.append(_tagged(g.nodes(n.label), "node", n.label))
    for e in g.spec.edges:
        if e.key in g.edge_keys:
            whole = e.source in g.labels and e.target in g.labels
            both = edge_measures(e, g.spec) if whole else [Measure("edge", e.name, "offered", e.table, (e.source_key, e.target_key))]
            measures += both[:1] if offered else []
            if whole and g.is_bound(e.key):
                measures += both[1:]
            else:
                frames.append(_tagged(g.edges(*e.key), "edge", e.name))
    if measures:
        frames.append(measured(measures, g.spec, g.tables if tables is None else tables))
    return union_all(frames)


def _tagged(df: DataFrame, kind: str, name: str) -> DataFrame:
    cols = [F.lit(kind).alias("kind"), F.lit(name).alias("name"), F.lit("stored").alias("what")]
    return df.select(*cols).groupBy("kind", "name", "what").agg(F.count(F.lit(1)).alias("n"))
