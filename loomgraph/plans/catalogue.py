"""Loads every module of the catalogue."""

from loomgraph.plans import (  # noqa: F401
    graph_queries,
    stream_queries,
    text_queries,
    traversal_queries,
    upkeep_queries,
)
from loomgraph.plans.registry import CATALOGUE, callables, sql_texts

__all__ = ["CATALOGUE", "callables", "sql_texts"]
