"""Label-agnostic neighbourhoods and paths.

Frontiers are expanded edge type by edge type on the typed keys.  The labels a
frontier can hold are tracked on the driver, so edge types that cannot be
incident to it are not read at all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import PropertyGraph, node_id, union_all
from loomgraph.operators.ranking import top_k, top_k_per
from loomgraph.session import settle

MAX_NEIGHBOURHOOD_DEPTH = 3
MAX_PATH_DEPTH = 10


@dataclass(frozen=True)
class Frontier:
    """Rows with ``label`` and ``key`` (text), plus the labels that may occur."""

    rows: DataFrame
    labels: frozenset[str]

    def settled(self) -> Frontier:
        """The same rows as a stored table, split by label.

        The next expansion then reads, per edge type, just the rows of one
        label, with their true size known to the planner; labels that did not
        occur are dropped.
        """
        rows = settle(self.rows, "label")
        present = [r["label"] for r in rows.select("label").distinct().collect()]  # at most one per label
        return Frontier(rows, frozenset(present))


def split_id(composite: str) -> tuple[str, str]:
    label, sep, key = composite.partition("_")
    if not sep:
        raise ValueError("node id must look like Label_key")
    return label, key


def start_at(g: PropertyGraph, label: str, condition: Column) -> Frontier:
    rows = g.nodes(label).where(condition).select(
        F.lit(label).alias("label"), F.col("id").cast("string").alias("key")
    )
    return Frontier(rows, frozenset([label]))


def expand(g: PropertyGraph, frontier: Frontier, carry: tuple[str, ...] = ()) -> Frontier:
    """Undirected neighbours of every frontier row.

    Result rows: ``from_label``, ``from_key``, ``label``, ``key``, ``rel`` and the
    carried columns of the frontier row.
    """
    frames, labels = [], set()
    for name, source, target in g.edge_keys:
        if source not in frontier.labels and target not in frontier.labels:
            continue
        edges, unchecked = g.links(name, source, target)
        for here, near, there, far in (("src", source, "dst", target), ("dst", target, "src", source)):
            if near not in frontier.labels:
                continue
            labels.add(far)
            at = frontier.rows.where(F.col("label") == near).select(
                F.col("key").try_cast(edges.schema[here].dataType).alias(here),
                F.col("label").alias("from_label"),
                F.col("key").alias("from_key"),
                *carry,
            )
            reached = edges.join(at, here).select("from_label", "from_key", there, *carry).distinct()
            if there in unchecked:
                reached = reached.join(g.nodes(far).select(F.col("id").alias(there)), there)
            frames.append(
                reached.select(
                    "from_label",
                    "from_key",
                    F.lit(far).alias("label"),
                    F.col(there).cast("string").alias("key"),
                    F.lit(name).alias("rel"),
                    *carry,
                )
            )
    if not frames:
        raise ValueError(f"no edge type touches {sorted(frontier.labels)}")
    return Frontier(union_all(frames), frozenset(labels))


def composite(label: str = "label", key: str = "key") -> Column:
    return F.concat_ws("_", F.col(label), F.col(key))


def key_is(df: DataFrame, column: str, key: str) -> Column:
    """``column`` equals the text ``key``, with the literal cast to the column's type so that scans can prune."""
    kind = df.schema[column].dataType
    if kind.simpleString() == "string":
        return F.col(column) == key
    value = F.lit(key).try_cast(kind)
    return (F.col(column) == value) & (value.cast("string") == key)


def neighbourhood_nodes(g: PropertyGraph, composite_id: str, depth: int = 1) -> Frontier:
    """Nodes within ``depth`` undirected hops, the anchor included.

    Nodes come from paths of at least one edge, so an anchor without edges
    yields nothing; an anchor that does not exist is an error.
    """
    if not 1 <= depth <= MAX_NEIGHBOURHOOD_DEPTH:
        raise ValueError("depth must be 1, 2 or 3")
    label, key = split_id(composite_id)
    if label not in g.labels:
        raise KeyError(f"unknown label: {label}")
    anchor = start_at(g, label, key_is(g.nodes(label), "id", key))
    if anchor.rows.isEmpty():
        raise KeyError(f"node not found: {composite_id}")
    level, levels = anchor, []
    for _ in range(depth):
        if not level.labels:
            break
        reached = expand(g, level)
        nodes = reached.rows.select("label", "key")
        if not levels:
            # the anchor belongs to the result once it has a neighbour
            own = reached.rows.select(F.col("from_label").alias("label"), F.col("from_key").alias("key"))
            nodes, labels = nodes.unionByName(own), reached.labels | anchor.labels
        else:
            labels = reached.labels
        nodes = nodes.distinct()
        for seen in levels:
            nodes = nodes.join(seen.rows, ["label", "key"], "left_anti")
        level = Frontier(nodes, labels).settled()
        levels.append(level)
    return Frontier(
        union_all([l.rows for l in levels]), frozenset().union(*[l.labels for l in levels])
    )


def induced_edges(g: PropertyGraph, nodes: Frontier) -> DataFrame:
    """Edges with both ends among ``nodes``, as composite ids."""
    frames = []
    for name, source, target in g.edge_keys:
        if source not in nodes.labels or target not in nodes.labels:
            continue
        # both ends are known nodes: filter the raw rows first, fold what is left
        edges, _ = g.links(name, source, target)
        for side, label in (("src", source), ("dst", target)):
            keys = nodes.rows.where(F.col("label") == label).select(
                F.col("key").try_cast(edges.schema[side].dataType).alias(side)
            )
            edges = edges.join(keys, side, "left_semi")
        frames.append(
            edges.distinct().select(
                node_id(source, F.col("src")).alias("src"),
                node_id(target, F.col("dst")).alias("dst"),
                F.lit(name).alias("rel_type"),
            )
        )
    if not frames:
        nothing = nodes.rows.where(F.lit(False))
        return nothing.select(composite().alias("src"), composite().alias("dst"), F.lit("").alias("rel_type"))
    return union_all(frames)


def full_sample(g: PropertyGraph, limit: int = 500) -> DataFrame:
    """The first ``limit`` nodes by id, the edges among them, and the totals.

    One row per node and edge, plus three rows ``total_nodes``, ``total_edges``
    and ``truncated`` that carry their number in ``value``.
    """
    if not 1 <= limit <= 5000:
        raise ValueError("limit must be between 1 and 5000")
    picked = g.vertices().select("id", "label").orderBy("id").limit(limit)
    key = F.expr("substring(id, length(label) + 2)")
    shown = Frontier(picked.select("label", key.alias("key")), frozenset(g.labels)).settled()
    # no columns are read for the totals
    counted = union_all(
        [g.nodes(l).select(F.lit("total_nodes").alias("kind")) for l in g.labels]
        + [g.edges(*k).select(F.lit("total_edges").alias("kind")) for k in g.edge_keys]
    )
    totals = settle(counted.groupBy("kind").agg(F.count(F.lit(1)).alias("value")))
    cut = totals.where("kind = 'total_nodes'").select(
        F.lit("truncated").alias("kind"), (F.col("value") > limit).cast("long").alias("value")
    )
    return union_all([listing(shown, induced_edges(g, shown)), totals, cut])


def listing(nodes: Frontier, edges: DataFrame) -> DataFrame:
    """Nodes and edges in one frame: (kind, id, type, target)."""
    return union_all(
        [
            nodes.rows.select(F.lit("node").alias("kind"), composite().alias("id"), F.col("label").alias("type")),
            edges.select(
                F.lit("edge").alias("kind"),
                F.col("src").alias("id"),
                F.col("rel_type").alias("type"),
                F.col("dst").alias("target"),
            ),
        ]
    )


def neighbourhood(g: PropertyGraph, composite_id: str, depth: int = 1) -> DataFrame:
    """Nodes and induced edges as one listing: (kind, id, type, target)."""
    nodes = neighbourhood_nodes(g, composite_id, depth)
    return listing(nodes, induced_edges(g, nodes))


def merge_view(current: DataFrame, found: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Union of the current view with newly found rows; known rows stay."""
    fresh = found.join(current.select(*keys), list(keys), "left_anti").dropDuplicates(list(keys))
    return current.unionByName(fresh)


def hop_lists(g: PropertyGraph, label: str, condition: Column, depth: int = 2) -> DataFrame:
    """Distinct (hop, id, label, rel) around the anchors, ``depth`` 1 to 3.

    Hop 2 leaves out the anchor, hop 3 leaves out the anchor and the first node
    of its own path.  One row per neighbour: lists are of any length.
    """
    if not 1 <= depth <= MAX_NEIGHBOURHOOD_DEPTH:
        raise ValueError("depth must be 1, 2 or 3")
    return hop_lists_from(g, start_at(g, label, condition), depth)


def hop_lists_from(g: PropertyGraph, start: Frontier, depth: int = 1) -> DataFrame:
    """``hop_lists`` around given (label, key) rows."""
    start = Frontier(start.rows.withColumn("anchor", composite()), start.labels).settled()
    if not start.labels:
        return start.rows.select("anchor", F.lit(1).alias("hop"), composite().alias("id"), "label", F.lit("").alias("rel"))
    one = expand(g, start, ("anchor",))
    one = Frontier(one.rows.select("anchor", "label", "key", "rel").distinct(), one.labels).settled()
    first = one.rows
    out = [first.select("anchor", F.lit(1).alias("hop"), composite().alias("id"), "label", "rel")]
    if depth >= 2:
        level1 = Frontier(first.select("anchor", "label", "key").distinct(), one.labels)
        two = expand(g, level1, ("anchor",))
        pairs = two.rows.where(composite() != F.col("anchor")).distinct()
        two = Frontier(pairs, two.labels)
        if depth >= 3:
            two = two.settled()
            pairs = two.rows
        second = pairs.select("anchor", "label", "key", "rel").distinct()
        out.append(second.select("anchor", F.lit(2).alias("hop"), composite().alias("id"), "label", "rel"))
    if depth >= 3:
        # a third node qualifies if the second one has some parent other than it
        parents = pairs.groupBy("anchor", "label", "key").agg(
            F.min(composite("from_label", "from_key")).alias("p_min"),
            F.max(composite("from_label", "from_key")).alias("p_max"),
        )
        three = expand(g, Frontier(parents, two.labels).settled(), ("anchor", "p_min", "p_max"))
        third = three.rows.where(
            (composite() != F.col("anchor")) & ((composite() != F.col("p_min")) | (composite() != F.col("p_max")))
        )
        third = third.select("anchor", "label", "key", "rel").distinct()
        out.append(third.select("anchor", F.lit(3).alias("hop"), composite().alias("id"), "label", "rel"))
    return union_all(out)


def with_names(g: PropertyGraph, rows: DataFrame, labels: frozenset[str] | None = None) -> DataFrame:
    """Add the stored name of composite ids in column ``id``."""
    frames, rows = [], settle(rows, "label")
    for label in labels or g.labels:
        part = rows.where(F.col("label") == label)
        names = g.nodes(label).select(node_id(label, F.col("id")).alias("id"), F.col("name"))
        frames.append(part.join(names, "id", "left"))
    return union_all(frames).withColumn("name", F.coalesce("name", "id"))


def budgeted(hops: DataFrame, max_nodes: int = 50) -> DataFrame:
    """Keep ``max_nodes`` rows per anchor: nearer hops first, then by id and relation."""
    order = [F.asc("hop"), F.asc("id"), F.asc("rel")]
    return top_k_per(hops, ["anchor"], max_nodes, order, "position")


def ego_network(g: PropertyGraph, composite_id: str) -> DataFrame:
    """The centre, its neighbours and only the edges that touch the centre."""
    label, key = split_id(composite_id)
    frames = []
    for name, source, target in g.edge_keys:
        if label not in (source, target):
            continue
        rows = g.edges(name, source, target)
        touches = F.lit(False)
        if source == label:
            touches = touches | key_is(rows, "src", key)
        if target == label:
            touches = touches | key_is(rows, "dst", key)
        frames.append(
            rows.where(touches).select(
                node_id(source, F.col("src")).alias("src"),
                node_id(target, F.col("dst")).alias("dst"),
                F.lit(name).alias("rel_type"),
            )
        )
    edges = union_all(frames)
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    centre = start_at(g, label, key_is(g.nodes(label), "id", key)).rows.select(composite().alias("id"))
    nodes = ids.unionByName(centre).distinct()
    return union_all(
        [
            nodes.select(F.lit("node").alias("kind"), "id"),
            edges.select(
                F.lit("edge").alias("kind"), F.col("src").alias("id"), F.col("rel_type").alias("type"),
                F.col("dst").alias("target"),
            ),
        ]
    )


def hub_ego(g: PropertyGraph) -> DataFrame:
    """Ego network of the highest-degree node."""
    from loomgraph.operators.aggregates import hub

    centre = hub(g).first()  # one row
    return ego_network(g, centre["id"])


def shortest_path(
    g: PropertyGraph,
    from_label: str,
    from_condition: Column,
    to_label: str,
    to_condition: Column,
    max_depth: int = 10,
) -> DataFrame:
    """One shortest undirected path as node ids; the smallest id sequence on ties.

    Breadth-first from both ends: the smaller frontier is expanded, level by
    level, until the two meet.  Levels are stored as tables and hold nodes, not
    paths.  Going back from the meeting nodes leaves the nodes that lie on a
    shortest path; the smallest one of each step is the path, one row a step.
    """
    if not 1 <= max_depth <= MAX_PATH_DEPTH:
        raise ValueError("max_depth must be between 1 and 10")
    ahead = [start_at(g, from_label, from_condition).settled()]
    back = [start_at(g, to_label, to_condition).settled()]
    common = _common(ahead[-1], back[-1])
    while common is None and len(ahead) + len(back) - 2 < max_depth:
        if not ahead[-1].labels or not back[-1].labels:
            break
        side = ahead if ahead[-1].rows.count() <= back[-1].rows.count() else back
        nodes = expand(g, side[-1])
        fresh = nodes.rows.select("label", "key").distinct()
        for seen in side:
            fresh = fresh.join(seen.rows, ["label", "key"], "left_anti")
        side.append(Frontier(fresh, nodes.labels).settled())
        common = _common(ahead[-1], back[-1])
    path: list[str] = []
    if common is not None:
        steps = [common]
        for level in reversed(ahead[:-1]):
            steps.insert(0, _common(level, _around(g, steps[0])))
        at, path = _smallest(steps[0])
        for level in [*steps[1:], *reversed(back[:-1])]:
            at, found = _smallest(Frontier(_around(g, at).rows.join(level.rows, ["label", "key"], "left_semi"), level.labels))
            path += found
    rows = [(path, len(path) - 1)] if path else []
    return g.nodes(from_label).sparkSession.createDataFrame(rows, "path array<string>, hops long")


def _around(g: PropertyGraph, nodes: Frontier) -> Frontier:
    """The neighbours of ``nodes``, without where they were reached from."""
    reached = expand(g, nodes)
    return Frontier(reached.rows.select("label", "key"), reached.labels)


def _common(level: Frontier, other: Frontier) -> Frontier | None:
    """The nodes of ``level`` that are also in ``other``, stored; None if there are none."""
    labels = level.labels & other.labels
    if not labels:
        return None
    both = Frontier(level.rows.join(other.rows, ["label", "key"], "left_semi"), labels).settled()
    return both if both.labels else None


def _smallest(nodes: Frontier) -> tuple[Frontier, list[str]]:
    """The node of smallest id as a frontier of one row, and that id."""
    rows = nodes.rows.select("label", "key", composite().alias("id"))
    first = top_k(rows, 1, F.asc("id")).first()
    one = nodes.rows.sparkSession.createDataFrame([(first["label"], first["key"])], "label string, key string")
    return Frontier(one, frozenset([first["label"]])), [first["id"]]


def path_names(g: PropertyGraph, paths: DataFrame) -> DataFrame:
    """Replace the ids of a path by ``Label(name)``, one row per step."""
    steps = paths.select(F.posexplode("path").alias("step", "id")).withColumn(
        "label", F.substring_index("id", "_", 1)
    )
    named = with_names(g, steps)
    return named.select("step", F.concat("label", F.lit("("), "name", F.lit(")")).alias("node"))
