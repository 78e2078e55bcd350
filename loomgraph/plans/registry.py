"""Registries: named pattern queries for users, and the catalogue of checked queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from loomgraph.graph import PropertyGraph
from loomgraph.sources.binding import Workspace

PatternQuery = Callable[..., DataFrame]


class PatternRegistry:
    """User-defined pattern queries: ``(PropertyGraph, **params) -> DataFrame``."""

    def __init__(self) -> None:
        self._queries: dict[str, PatternQuery] = {}

    def register(self, name: str, fn: PatternQuery) -> PatternQuery:
        if name in self._queries:
            raise ValueError(f"already registered: {name}")
        self._queries[name] = fn
        return fn

    def names(self) -> list[str]:
        return sorted(self._queries)

    def run(self, graph: PropertyGraph, name: str, **params: object) -> DataFrame:
        return self._queries[name](graph, **params)


@dataclass(frozen=True)
class CheckedQuery:
    name: str
    build: Callable[[Workspace], DataFrame]
    sql: str | None


CATALOGUE: dict[str, CheckedQuery] = {}


def checked(name: str, sql: str | None = None):
    """Add a query over the bound tables and, where SQL can say it, its equivalent."""

    def add(fn: Callable[[Workspace], DataFrame]):
        if name in CATALOGUE:
            raise ValueError(f"already in the catalogue: {name}")
        CATALOGUE[name] = CheckedQuery(name, fn, sql)
        return fn

    return add


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(q: CheckedQuery):
        return lambda spark, folder: q.build(Workspace(spark, folder))

    return {name: bind(q) for name, q in CATALOGUE.items()}


def sql_texts() -> dict[str, str]:
    return {name: q.sql for name, q in CATALOGUE.items() if q.sql}
