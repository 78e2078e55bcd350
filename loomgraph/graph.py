"""A property graph held as one typed DataFrame per label and per edge type.

Typed frames keep column pruning and filter pushdown.  The label-agnostic
``vertices`` / ``connections`` views are unions built on demand and carry
property maps only when asked.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.plan import auto_broadcast_bytes, dealt, estimated_bytes
from loomgraph.functions.strings import display_name, name_template, render
from loomgraph.spec import EdgeSpec, GraphSpec, NodeSpec


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns missing from a frame become null."""
    if not frames:
        raise ValueError("nothing to union")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def merge_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], values: Sequence[str], tags: Sequence[str] = ()
) -> DataFrame:
    """One row per key: the values of the row that is last along ``order``.

    An aggregate, not a window: each task folds its rows before the shuffle,
    so a key that repeats in a third of the input costs one row per task.
    """
    if not values:
        return df.select(*keys).distinct()
    payload = F.struct(*values)
    # the values themselves settle ties, so a rebuild always keeps the same row
    ranking = F.struct(*order, payload) if order else payload
    return df.groupBy(*keys).agg(F.max_by(payload, ranking).alias("_kept")).select(*keys, "_kept.*")


def build_nodes(spec: NodeSpec, table: DataFrame) -> DataFrame:
    """Nodes of one label: ``id``, the declared properties and ``name``."""
    source = table.where(F.col(spec.key).isNotNull())
    projected = source.select(
        F.col(spec.key).alias("id"),
        *[F.col(c).alias(p) for p, c in spec.props.items()],
        *[F.col(c).alias(f"_o{i}") for i, c in enumerate(spec.merge_order)],
    )
    if not spec.unique:
        order = [F.col(f"_o{i}") for i in range(len(spec.merge_order))]
        projected = merge_rows(projected, ["id"], order, list(spec.props))
    projected = projected.select("id", *spec.props)
    return projected if spec.named else ensure_name(projected, spec.label, spec.name_template)


def ensure_name(df: DataFrame, label: str, template: str | None = None) -> DataFrame:
    """Add or complete the ``name`` column of a node frame."""
    template = template or name_template(label, [c for c in df.columns if c != "id"])
    rendered = render(template, lambda p: F.col(p) if p in df.columns else None)
    if "name" not in df.columns:
        return df.withColumn("name", rendered)
    if template == "{name}":
        rendered = F.concat(F.lit(f"{label} #"), F.col("id").cast("string"))
    return df.withColumn("name", F.coalesce(F.col("name").cast("string"), rendered))


def project_edges(spec: EdgeSpec, table: DataFrame) -> DataFrame:
    """Rows of one edge type before merging: both endpoints are present."""
    return table.where(F.col(spec.source_key).isNotNull() & F.col(spec.target_key).isNotNull()).select(
        F.col(spec.source_key).alias("src"),
        F.col(spec.target_key).alias("dst"),
        *[F.col(c).alias(p) for p, c in spec.props.items()],
        *[F.col(c).alias(f"_o{i}") for i, c in enumerate(spec.merge_order)],
    )


def unchecked_sides(spec: EdgeSpec, graph_spec: GraphSpec) -> dict[str, str]:
    """Endpoints (side -> label) that rows of the edge's table do not prove to exist."""
    sides = {"src": (spec.source, spec.source_key), "dst": (spec.target, spec.target_key)}
    out = {}
    for side, (label, column) in sides.items():
        node = graph_spec.node(label)
        if not (node.table == spec.table and node.key == column):
            out[side] = label
    return out


def build_edges(spec: EdgeSpec, table: DataFrame, graph_spec: GraphSpec, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Edges of one type: merged to one row per (src, dst), endpoints must exist.

    Merging comes first: it is spread over the pair and shrinks the input of
    the endpoint checks.  An endpoint that is the key column of the edge's own
    table exists by construction and is not checked again.
    """
    rows = project_edges(spec, table)
    props = list(spec.props)
    if not spec.unique:
        order = [F.col(f"_o{i}") for i in range(len(spec.merge_order))]
        rows = merge_rows(dealt(rows, table.count(), "src", "dst"), ["src", "dst"], order, props)
    rows = rows.select("src", "dst", *props)
    for side, label in unchecked_sides(spec, graph_spec).items():
        node = graph_spec.node(label)
        keys = tables[node.table].select(F.col(node.key).alias(side)).where(F.col(side).isNotNull())
        if estimated_bytes(keys) > auto_broadcast_bytes(keys):
            rows = dealt(rows, table.count(), side)
        rows = rows.join(keys, side, "left_semi").select("src", "dst", *props)
    return rows


def _build_nodes_of(spec: NodeSpec, tables: Mapping[str, DataFrame]) -> DataFrame:
    return build_nodes(spec, tables[spec.table])


def _build_edges_of(spec: EdgeSpec, graph_spec: GraphSpec, tables: Mapping[str, DataFrame]) -> DataFrame:
    return build_edges(spec, tables[spec.table], graph_spec, tables)


class PropertyGraph:
    """Frames may be given as functions; they are then built when first used."""

    def __init__(
        self,
        spec: GraphSpec,
        nodes: Mapping[str, DataFrame | Callable[[], DataFrame]],
        edges: Mapping[tuple[str, str, str], DataFrame | Callable[[], DataFrame]],
        tables: Mapping[str, DataFrame] | None = None,
    ) -> None:
        self.spec = spec
        self._nodes = dict(nodes)
        self._edges = dict(edges)
        self._tables = tables
        self._opened: dict[object, DataFrame] = {}
        self._sizes: dict[object, int] = {}

    def _frame(self, kind: Mapping, key) -> DataFrame:
        """The frame of a label or edge key, built once if it was given as a function."""
        frame = kind[key]
        if isinstance(frame, DataFrame):
            return frame
        if key not in self._opened:
            self._opened[key] = frame()
        return self._opened[key]

    @staticmethod
    def build(spec: GraphSpec, tables: Mapping[str, DataFrame]) -> PropertyGraph:
        """Lazy build; nothing runs until a frame is used."""
        nodes = {
            n.label: partial(_build_nodes_of, n, tables) for n in spec.nodes if n.table in tables
        }
        edges = {
            e.key: partial(_build_edges_of, e, spec, tables)
            for e in spec.edges
            if e.table in tables and e.source in nodes and e.target in nodes
        }
        return PropertyGraph(spec, nodes, edges, tables)

    @property
    def labels(self) -> list[str]:
        return list(self._nodes)

    @property
    def edge_keys(self) -> list[tuple[str, str, str]]:
        return list(self._edges)

    @property
    def tables(self) -> Mapping[str, DataFrame] | None:
        """The tables the graph was built from; None for a stored one."""
        return self._tables

    def is_bound(self, key: str | tuple[str, str, str]) -> bool:
        """True if a label or edge key is built from its table, not given as a frame."""
        kind = self._nodes if isinstance(key, str) else self._edges
        return self._tables is not None and not isinstance(kind[key], DataFrame)

    def nodes(self, label: str) -> DataFrame:
        return self._frame(self._nodes, label)

    def edges(self, name: str, source: str | None = None, target: str | None = None) -> DataFrame:
        return self._frame(self._edges, self.spec.edge(name, source, target).key)

    def links(self, name: str, source: str | None = None, target: str | None = None) -> tuple[DataFrame, dict[str, str]]:
        """(src, dst) rows for a traversal, and the endpoints still to be checked.

        A traversal starts from few nodes and folds what it reaches, so it
        reads the rows of the edge's table as they are: pairs may repeat, and
        only the nodes reached need to be looked up.  Stored or inferred edges
        are returned as they are.
        """
        spec = self.spec.edge(name, source, target)
        if self._tables is None or isinstance(self._edges[spec.key], DataFrame):
            return self.edges(*spec.key).select("src", "dst"), {}
        rows = project_edges(spec, self._tables[spec.table]).select("src", "dst")
        return rows, unchecked_sides(spec, self.spec)

    def source_rows(self, name: str, source: str | None = None, target: str | None = None) -> int:
        """How many rows an edge type is made of: those of its table, which a file's footer tells, or its own."""
        spec = self.spec.edge(name, source, target)
        if spec.key not in self._sizes:
            frame = self._tables[spec.table] if self.is_bound(spec.key) else self.edges(*spec.key)
            self._sizes[spec.key] = frame.count()
        return self._sizes[spec.key]

    def node_rows(self, label: str) -> int:
        """How many rows the nodes of a label are made of."""
        if label not in self._sizes:
            frame = self._tables[self.spec.node(label).table] if self.is_bound(label) else self.nodes(label)
            self._sizes[label] = frame.count()
        return self._sizes[label]

    def with_edges(self, spec: EdgeSpec, frame: DataFrame) -> PropertyGraph:
        """A graph with one more edge type (or a replaced one)."""
        kept = tuple(e for e in self.spec.edges if e.key != spec.key)
        return PropertyGraph(
            GraphSpec(self.spec.nodes, (*kept, spec)), self._nodes, {**self._edges, spec.key: frame}, self._tables
        )

    def restrict(self, labels: Sequence[str], edge_keys: Sequence[tuple[str, str, str]]) -> PropertyGraph:
        return PropertyGraph(
            GraphSpec(
                tuple(n for n in self.spec.nodes if n.label in labels),
                tuple(e for e in self.spec.edges if e.key in edge_keys),
            ),
            {k: v for k, v in self._nodes.items() if k in labels},
            {k: v for k, v in self._edges.items() if k in edge_keys},
            self._tables,
        )

    # ---- label-agnostic views -------------------------------------------------

    def vertices(self, with_props: bool = False, labels: Sequence[str] | None = None) -> DataFrame:
        """``id`` (``Label_key``), ``label``, ``display_name`` and optionally ``props``."""
        frames = []
        for label in labels or self.labels:
            df = self.nodes(label)
            has = set(df.columns)
            shown = display_name(
                lambda p, has=has: F.col(p) if p in has else F.lit(None).cast("string"), label, F.col("id")
            )
            cols = [
                node_id(label, F.col("id")).alias("id"),
                F.lit(label).alias("label"),
                shown.alias("display_name"),
            ]
            if with_props:
                cols.append(property_map(df.columns).alias("props"))
            frames.append(df.select(*cols))
        return union_all(frames)

    def connections(
        self, with_props: bool = False, keys: Sequence[tuple[str, str, str]] | None = None
    ) -> DataFrame:
        """``src``, ``dst`` (composite ids), ``rel_type`` and optionally ``props``."""
        frames = []
        for key in keys or self.edge_keys:
            name, source, target = key
            df = self.edges(*key)
            cols = [
                node_id(source, F.col("src")).alias("src"),
                node_id(target, F.col("dst")).alias("dst"),
                F.lit(name).alias("rel_type"),
            ]
            if with_props:
                props = [c for c in df.columns if c not in ("src", "dst")]
                cols.append(property_map(props).alias("props"))
            frames.append(df.select(*cols))
        return union_all(frames)


def node_id(label: str, key: Column) -> Column:
    return F.concat(F.lit(f"{label}_"), key.cast("string"))


def property_map(columns: Sequence[str]) -> Column:
    """Map of the non-null properties, values as strings."""
    if not columns:
        return F.create_map().cast("map<string,string>")
    entries = [F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in columns]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))
