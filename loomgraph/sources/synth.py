"""Foreign-key-consistent generated tables, distributed and repeatable."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.spec import ColumnSpec, TableSpec

# Small value pools by a word in the column name.
POOLS = {
    "name": ("Alpha", "Bravo", "Carol", "Delta", "Echo", "Fox", "Golf", "Hotel"),
    "city": ("Seoul", "Busan", "Incheon", "Daegu"),
    "status": ("pending", "active", "done"),
    "email": ("a@example.com", "b@example.com", "c@example.com"),
}


def parents_first(specs: Sequence[TableSpec]) -> list[str]:
    """Table names ordered so that referenced tables come before their children."""
    known = {s.name for s in specs}
    deps = {
        s.name: {f.ref_table for f in s.foreign_keys if f.ref_table in known and f.ref_table != s.name}
        for s in specs
    }
    return list(TopologicalSorter(deps).static_order())


def _draw(seed: int, column: str, n: Column | int) -> Column:
    return F.pmod(F.xxhash64(F.col("_i"), F.lit(seed), F.lit(column)), F.lit(n) if isinstance(n, int) else n)


def _value(column: ColumnSpec, seed: int) -> Column:
    low = column.name.lower()
    for word, pool in POOLS.items():
        if word in low and column.kind == "string":
            return F.element_at(F.array(*map(F.lit, pool)), (F.pmod(F.col("_i"), F.lit(len(pool))) + 1).cast("int"))
    if column.kind == "integer":
        return (F.col("_i") + 1) * 10
    if column.kind == "float":
        return (_draw(seed, column.name, 990_001) + 10_000) / 100.0
    if column.kind == "boolean":
        return F.pmod(F.col("_i"), F.lit(2)) == 0
    if column.kind in ("date", "timestamp"):
        day = F.date_add(F.lit("2024-01-01").cast("date"), _draw(seed, column.name, 365).cast("int"))
        return day.cast(column.spark_type)
    return F.concat(F.lit(f"{column.name}_"), F.col("_i") + 1)


def generate(
    spark: SparkSession, specs: Sequence[TableSpec], rows: Mapping[str, int], seed: int = 42
) -> dict[str, DataFrame]:
    """Tables with keys 1..n whose foreign keys always hit an existing parent.

    Every value is a function of the row number and the seed, so any partition
    can be recomputed alone.  A self-reference is null in the first two rows and
    points to an earlier row after that; the last row leaves nullable references
    empty.
    """
    by_name = {s.name: s for s in specs}
    out = {}
    for name in parents_first(specs):
        spec, n = by_name[name], rows[name]
        fks = {f.column: f for f in spec.foreign_keys}
        columns = []
        for column in spec.columns:
            if column.name == spec.primary_key:
                value = F.col("_i") + 1
            elif column.name in fks:
                parent = fks[column.name].ref_table
                if parent == name:
                    value = F.when(F.col("_i") >= 2, _draw(seed, column.name, F.col("_i")) + 1)
                elif rows.get(parent, 0) > 0:
                    value = _draw(seed, column.name, rows[parent]) + 1
                    if column.nullable:
                        value = F.when(F.col("_i") < n - 1, value)
                else:
                    value = F.lit(None).cast("bigint")
            else:
                value = _value(column, seed)
            columns.append(value.alias(column.name))
        out[name] = spark.range(n).withColumnRenamed("id", "_i").select(*columns)
    return out
