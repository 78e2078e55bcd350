"""Differences between stored graphs, their impact, and incremental migration."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import PropertyGraph, build_edges, build_nodes, union_all
from loomgraph.spec import EdgeSpec, GraphSpec, NodeSpec


def diff_rows(base: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that were added, removed or modified between two frames.

    Both sides are reduced to key and a digest of the other columns; equal rows
    cancel out in the aggregation.
    """

    def digest(df: DataFrame, side: str) -> DataFrame:
        rest = sorted(c for c in df.columns if c not in keys)
        value = F.xxhash64(F.lit("|".join(rest)), *rest) if rest else F.lit(0).cast("long")
        return df.select(*keys, F.lit(side).alias("_side"), value.alias("_h"))

    both = digest(base, "b").unionByName(digest(target, "t"))
    folded = both.groupBy(*keys).agg(
        F.max(F.when(F.col("_side") == "b", F.col("_h"))).alias("_b"),
        F.max(F.when(F.col("_side") == "t", F.col("_h"))).alias("_t"),
    )
    change = (
        F.when(F.col("_b").isNull(), "added")
        .when(F.col("_t").isNull(), "removed")
        .when(F.col("_b") != F.col("_t"), "modified")
    )
    return folded.withColumn("change", change).where(F.col("change").isNotNull()).drop("_b", "_t")


def diff_graphs(base: PropertyGraph, target: PropertyGraph) -> DataFrame:
    """Row-level changes: (kind, type, id, target, change)."""
    frames = []
    for label in dict.fromkeys([*base.labels, *target.labels]):
        b = base.nodes(label) if label in base.labels else target.nodes(label).limit(0)
        t = target.nodes(label) if label in target.labels else base.nodes(label).limit(0)
        frames.append(
            diff_rows(b, t, ["id"]).select(
                F.lit("node").alias("kind"), F.lit(label).alias("type"), F.col("id").cast("string").alias("id"),
                F.lit(None).cast("string").alias("target"), "change",
            )
        )
    for key in dict.fromkeys([*base.edge_keys, *target.edge_keys]):
        b = base.edges(*key) if key in base.edge_keys else target.edges(*key).limit(0)
        t = target.edges(*key) if key in target.edge_keys else base.edges(*key).limit(0)
        frames.append(
            diff_rows(b, t, ["src", "dst"]).select(
                F.lit("edge").alias("kind"), F.lit(key[0]).alias("type"), F.col("src").cast("string").alias("id"),
                F.col("dst").cast("string").alias("target"), "change",
            )
        )
    return union_all(frames)


def diff_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("kind", "type", "change").agg(F.count(F.lit(1)).alias("cnt"))


# ---- types ----------------------------------------------------------------------


def type_table(g: PropertyGraph) -> DataFrame:
    """Live shape of a graph: one row per type in use and per property that occurs.

    Every type is scanned whole, so a property carried by few elements counts;
    the driver sees schemas, never rows.
    """
    shapes = [("node", label, "", "", g.nodes(label)) for label in g.labels]
    shapes += [("edge", *key, g.edges(*key)) for key in g.edge_keys]
    frames = []
    for kind, name, source, target, df in shapes:
        props = [(c, t) for c, t in df.dtypes if not (kind == "edge" and c in ("src", "dst"))]
        counted = df.agg(F.count(F.lit(1)).alias("_all"), *[F.count(c).alias(c) for c, _ in props])
        entries = [("", "", "_all"), *[(c, t, c) for c, t in props]]
        rows = F.array(
            *[
                F.struct(F.lit(p).alias("property"), F.lit(t).alias("data_type"), F.col(c).alias("present"))
                for p, t, c in entries
            ]
        )
        frames.append(
            counted.select(F.explode(rows).alias("r")).select(
                F.lit(kind).alias("kind"), F.lit(name).alias("name"), F.lit(source).alias("source"),
                F.lit(target).alias("target"), "r.*",
            )
        )
    return union_all(frames).where("present > 0").drop("present")


def diff_types(base: DataFrame, target: DataFrame) -> DataFrame:
    """Changed types and properties between two type tables.

    Edge types are keyed by (name, source, target).  A name that loses one
    endpoint pair and gains another is an endpoint change, which breaks readers
    just as a removal does.
    """
    keys = ["kind", "name", "source", "target", "property"]
    joined = (
        base.select(*keys, F.col("data_type").alias("old_type"))
        .join(target.select(*keys, F.col("data_type").alias("new_type")), keys, "full_outer")
    )
    change = (
        F.when(F.col("old_type").isNull(), "added")
        .when(F.col("new_type").isNull(), "removed")
        .when(F.col("old_type") != F.col("new_type"), "modified")
    )
    changed = joined.withColumn("change", change).where(F.col("change").isNotNull())
    # endpoint change: the same edge name both removed and added as a type
    moved = (
        changed.where("kind = 'edge' AND property = ''")
        .groupBy("kind", "name")
        .agg(F.count_distinct("change").alias("n"))
        .where("n = 2")
        .select("kind", "name", F.lit(True).alias("endpoint_changed"))
    )
    out = changed.join(moved, ["kind", "name"], "left").withColumn(
        "endpoint_changed", F.coalesce("endpoint_changed", F.lit(False))
    )
    breaking = (F.col("property") == "") & ((F.col("change") == "removed") | F.col("endpoint_changed"))
    return out.withColumn("breaking", breaking)


def changed_types(diff: DataFrame) -> DataFrame:
    """One row per changed type with its overall change."""
    whole = F.max(F.when(F.col("property") == "", F.col("change")))
    return diff.groupBy("kind", "name", "source", "target").agg(
        F.coalesce(whole, F.lit("modified")).alias("change"), F.max("endpoint_changed").alias("endpoint_changed"),
        F.max("breaking").alias("breaking"),
    )


def diff_summary(diff: DataFrame) -> DataFrame:
    """One row: ``nodes +1, rels ~2`` and the breaking flag."""
    types = changed_types(diff)
    change = F.when(F.col("endpoint_changed"), "modified").otherwise(F.col("change"))
    # an endpoint change is one modification of the name, not a removal plus an addition
    named = types.select("kind", "name", change.alias("change"), "breaking",
                         F.when(F.col("endpoint_changed"), "").otherwise(F.concat_ws(">", "source", "target")).alias("k"))
    once = named.groupBy("kind", "name", "k", "change").agg(F.max("breaking").alias("breaking"))
    parts, counts = [], []
    for kind, word in (("node", "nodes"), ("edge", "rels")):
        for change_name, sign in (("added", "+"), ("removed", "-"), ("modified", "~")):
            col = f"{word}_{change_name}"
            counts.append(
                F.count_if((F.col("kind") == kind) & (F.col("change") == change_name)).alias(col)
            )
            parts.append(F.when(F.col(col) > 0, F.concat(F.lit(f"{word} {sign}"), F.col(col).cast("string"))))
    row = once.agg(*counts, F.coalesce(F.max("breaking"), F.lit(False)).alias("is_breaking"))
    text = F.concat_ws(", ", *parts)
    return row.select(F.when(text == "", "No changes").otherwise(text).alias("summary"), "is_breaking")


def impact(base: PropertyGraph, diff: DataFrame) -> DataFrame:
    """Stored elements of removed or modified types: (kind, name, affected, seconds).

    Types without elements are left out.  The estimate is 1 ms per node and
    2 ms per edge.
    """
    rows = [base.nodes(l).select(F.lit("node").alias("kind"), F.lit(l).alias("name"), F.lit("").alias("source"),
                                 F.lit("").alias("target")) for l in base.labels]
    rows += [
        base.edges(*k).select(F.lit("edge").alias("kind"), F.lit(k[0]).alias("name"), F.lit(k[1]).alias("source"),
                              F.lit(k[2]).alias("target"))
        for k in base.edge_keys
    ]
    stored = union_all(rows).groupBy("kind", "name", "source", "target").agg(F.count(F.lit(1)).alias("affected"))
    hit = changed_types(diff).where("change IN ('removed', 'modified')")
    millis = F.when(F.col("kind") == "node", F.col("affected")).otherwise(F.col("affected") * 2)
    return stored.join(hit, ["kind", "name", "source", "target"], "left_semi").select(
        "kind", "name", "affected", F.round(millis / 1000, 2).alias("estimated_seconds")
    )


def dangling_references(diff: DataFrame, target_types: DataFrame) -> DataFrame:
    """Edge types of the target whose source or target label does not exist there."""
    labels = target_types.where("kind = 'node'").select(F.col("name").alias("label")).distinct()
    edges = target_types.where("kind = 'edge'").select("name", "source", "target").distinct()
    frames = []
    for side in ("source", "target"):
        lost = edges.withColumnRenamed(side, "label").join(labels, "label", "left_anti")
        frames.append(lost.select("name", F.lit(side).alias("side"), F.col("label").alias("missing")))
    return union_all(frames)


def _digest(value) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()


def node_fingerprints(spec: NodeSpec, types: Mapping[str, str]) -> tuple[str, str]:
    """(identity, content) of a label: which nodes there are, and what they hold.

    ``types``: the type of ``id`` and of every property.
    """
    identity = [spec.table, spec.key, types.get("id")]
    content = [identity, dict(spec.props), list(spec.merge_order), spec.unique, spec.name_template, spec.named, {p: types.get(p) for p in spec.props}]
    return _digest(identity), _digest(content)


def edge_fingerprint(spec: EdgeSpec, types: Mapping[str, str]) -> str:
    return _digest(
        [spec.table, spec.source_key, spec.target_key, dict(spec.props), list(spec.merge_order), spec.unique,
         {p: types.get(p) for p in ("src", "dst", *spec.props)}]
    )


def _source_types(table: DataFrame, columns: Mapping[str, str]) -> dict[str, str]:
    """Types the columns have in the source, by the names they get."""
    return {name: table.schema[column].dataType.simpleString() for name, column in columns.items()}


def migration_plan(base: PropertyGraph, target_spec: GraphSpec, tables: Mapping[str, DataFrame]) -> dict[str, list]:
    """The types of each step, found by fingerprints.

    Types of columns count: those of the stored frames against those the source
    tables have now.  An edge type also has to be rebuilt (``edges_dependent``)
    when the nodes of an end are chosen anew, and goes when the target has no such
    label, so no edge is left without its ends.
    """
    labels = {n.label: n for n in target_spec.nodes}
    old_edges = {e.key: e for e in base.spec.edges if e.key in base.edge_keys}
    new_edges = {e.key: e for e in target_spec.edges if e.source in labels and e.target in labels}
    before, now = {}, {}
    for n in base.spec.nodes:
        if n.label in labels and n.label in base.labels:
            before[n.label] = node_fingerprints(n, dict(base.nodes(n.label).dtypes))
    for label, n in labels.items():
        types = _source_types(tables[n.table], {"id": n.key, **n.props})
        if "name" in types and not n.named:
            types["name"] = "string"  # as the build makes it
        now[label] = node_fingerprints(n, types)
    moved = {label for label in before if before[label][0] != now[label][0]}
    gone_or_new = (set(now) - set(before)) | ({n.label for n in base.spec.nodes} - set(now))
    modified, dependent = [], []
    for key, e in new_edges.items():
        if key not in old_edges:
            continue
        types = _source_types(tables[e.table], {"src": e.source_key, "dst": e.target_key, **e.props})
        if edge_fingerprint(old_edges[key], dict(base.edges(*key).dtypes)) != edge_fingerprint(e, types):
            modified.append(key)
        elif {e.source, e.target} & (moved | gone_or_new):
            dependent.append(key)
    return {
        "edges_removed": [k for k in old_edges if k not in new_edges],
        "nodes_removed": [n.label for n in base.spec.nodes if n.label not in labels],
        "nodes_modified": [label for label in labels if label in before and before[label] != now[label]],
        "nodes_added": [label for label in labels if label not in before],
        "edges_added": [k for k in new_edges if k not in old_edges],
        "edges_modified": modified,
        "edges_dependent": dependent,
    }


def migrate(
    base: PropertyGraph, target_spec: GraphSpec, tables: Mapping[str, DataFrame], dry_run: bool = False
) -> tuple[PropertyGraph, dict[str, list]]:
    """Bring a stored graph to ``target_spec``, rebuilding only what changed.

    Untouched types keep their frames.  What changed by its fingerprint is rebuilt
    from the source table, with the edge types that depend on it.  The second
    result names the types of each step; ``migration_counts`` counts.
    """
    plan = migration_plan(base, target_spec, tables)
    if dry_run or not any(plan.values()):
        return base, plan
    rebuilt = set(plan["nodes_added"]) | set(plan["nodes_modified"])
    nodes = {
        n.label: build_nodes(n, tables[n.table]) if n.label in rebuilt else base.nodes(n.label) for n in target_spec.nodes
    }
    remade = set(plan["edges_added"]) | set(plan["edges_modified"]) | set(plan["edges_dependent"])
    kept = tuple(e for e in target_spec.edges if e.source in nodes and e.target in nodes)
    edges = {
        e.key: build_edges(e, tables[e.table], target_spec, tables) if e.key in remade else base.edges(*e.key) for e in kept
    }
    return PropertyGraph(GraphSpec(target_spec.nodes, kept), nodes, edges), plan


def migration_counts(base: PropertyGraph, migrated: PropertyGraph, plan: Mapping[str, list]) -> DataFrame:
    """Elements behind each migration step, in one job: (step, cnt)."""
    frames = []

    def tag(step: str, df: DataFrame) -> None:
        frames.append(df.select(F.lit(step).alias("step")))

    for key in plan["edges_removed"]:
        tag("relationships_removed", base.edges(*key))
    for label in plan["nodes_removed"]:
        tag("nodes_removed", base.nodes(label))
    for label in plan["nodes_added"]:
        tag("nodes_added", migrated.nodes(label))
    for key in plan["edges_added"]:
        tag("relationships_added", migrated.edges(*key))
    for label in plan["nodes_modified"]:
        tag("nodes_modified", migrated.nodes(label))
    for key in plan["edges_modified"]:
        tag("relationships_modified", migrated.edges(*key))
    for key in plan.get("edges_dependent", ()):
        tag("relationships_rebuilt", migrated.edges(*key))
    return union_all(frames).groupBy("step").agg(F.count(F.lit(1)).alias("cnt"))


