"""Driver-side descriptions of tables and graphs.  No data lives here."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import types as T

# Base SQL type name -> kind.
SQL_KINDS = {
    "SERIAL": "integer",
    "BIGSERIAL": "integer",
    "INT": "integer",
    "INTEGER": "integer",
    "BIGINT": "integer",
    "SMALLINT": "integer",
    "DECIMAL": "float",
    "NUMERIC": "float",
    "FLOAT": "float",
    "DOUBLE": "float",
    "REAL": "float",
    "BOOLEAN": "boolean",
    "BOOL": "boolean",
    "DATE": "date",
    "TIMESTAMP": "timestamp",
}
SPARK_TYPES = {
    "integer": T.LongType(),
    "float": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "string": T.StringType(),
}


def sql_kind(sql_type: str) -> str:
    """Kind of a declared SQL type, decided by its base name alone.

    ``POINT`` and ``INTERVAL`` are strings, although they contain ``INT``.
    """
    base = re.match(r"\s*([A-Za-z]+)", sql_type)
    return SQL_KINDS.get(base.group(1).upper(), "string") if base else "string"


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    sql_type: str = "VARCHAR"
    nullable: bool = True

    @property
    def kind(self) -> str:
        return sql_kind(self.sql_type)

    @property
    def spark_type(self) -> T.DataType:
        return SPARK_TYPES[self.kind]


@dataclass(frozen=True)
class ForeignKey:
    column: str
    ref_table: str
    ref_column: str


@dataclass(frozen=True)
class TableSpec:
    name: str
    columns: tuple[ColumnSpec, ...]
    primary_key: str | None = None
    foreign_keys: tuple[ForeignKey, ...] = ()

    def column(self, name: str) -> ColumnSpec | None:
        return next((c for c in self.columns if c.name.lower() == name.lower()), None)


@dataclass(frozen=True)
class NodeSpec:
    """One label.  ``props`` maps property name to source column.

    ``unique`` declares that the key column is a primary key of the table, so
    the upsert needs no shuffle; ``key_violations`` is the check for the claim.
    ``named`` declares that the ``name`` property is never null, so filters on
    it reach the scan instead of stopping at the name enrichment.
    """

    label: str
    table: str
    key: str
    props: Mapping[str, str] = field(default_factory=dict)
    merge_order: tuple[str, ...] = ()
    unique: bool = False
    name_template: str | None = None
    named: bool = False

    def __post_init__(self) -> None:
        if "_" in self.label:
            raise ValueError(f"label must not contain '_': {self.label}")


@dataclass(frozen=True)
class EdgeSpec:
    """One edge type.  ``unique`` declares that no (source, target) pair repeats."""

    name: str
    source: str
    target: str
    table: str
    source_key: str
    target_key: str
    props: Mapping[str, str] = field(default_factory=dict)
    merge_order: tuple[str, ...] = ()
    unique: bool = False
    derivation: str = "fk_direct"

    @property
    def key(self) -> tuple[str, str, str]:
        return (self.name, self.source, self.target)


@dataclass(frozen=True)
class GraphSpec:
    nodes: tuple[NodeSpec, ...]
    edges: tuple[EdgeSpec, ...]

    def node(self, label: str) -> NodeSpec:
        for n in self.nodes:
            if n.label == label:
                return n
        raise KeyError(f"unknown label: {label}")

    def edge(self, name: str, source: str | None = None, target: str | None = None) -> EdgeSpec:
        hits = [
            e
            for e in self.edges
            if e.name == name and source in (None, e.source) and target in (None, e.target)
        ]
        if len(hits) != 1:
            raise KeyError(f"{len(hits)} edge types match {name} ({source} -> {target})")
        return hits[0]

    @staticmethod
    def from_mapping(config: Mapping | str) -> GraphSpec:
        """Build from a triples-map / relationship-map document.

        Accepts a mapping, JSON text or, where PyYAML is installed, YAML text.
        """
        if isinstance(config, str):
            try:
                config = json.loads(config)
            except json.JSONDecodeError:
                import yaml  # optional

                config = yaml.safe_load(config)
        nodes, by_id = [], {}
        for entry in config.get("triples_maps", []):
            props = list(entry.get("properties", []))
            keys = [p["column"] for p in props if p.get("is_key")]
            template = entry["subject_map"].get("template", "{id}")
            key = keys[0] if keys else template.strip("{}")
            node = NodeSpec(
                label=entry["subject_map"]["class"],
                table=entry["logical_table"]["table_name"],
                key=key,
                props={p["name"]: p["column"] for p in props if p["column"] != key},
            )
            nodes.append(node)
            by_id[entry["id"]] = node
        edges = [
            EdgeSpec(
                name=entry["type"],
                source=by_id[entry["source_triples_map"]].label,
                target=by_id[entry["target_triples_map"]].label,
                table=entry["logical_table"]["table_name"],
                source_key=entry["join_condition"]["source_column"],
                target_key=entry["join_condition"]["target_column"],
                props={p["name"]: p["column"] for p in entry.get("properties", [])},
                derivation=entry.get("derivation", "fk_direct"),
            )
            for entry in config.get("relationship_maps", [])
        ]
        return GraphSpec(tuple(nodes), tuple(edges))
