"""Property-graph and retrieval analytics on Spark DataFrames."""

from loomgraph.graph import PropertyGraph
from loomgraph.spec import ColumnSpec, EdgeSpec, ForeignKey, GraphSpec, NodeSpec, TableSpec

__all__ = [
    "ColumnSpec",
    "EdgeSpec",
    "ForeignKey",
    "GraphSpec",
    "NodeSpec",
    "PropertyGraph",
    "TableSpec",
]
