"""Integrity, shape and profile checks over tables and graphs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import PropertyGraph, node_id, union_all
from loomgraph.spec import TableSpec


def fk_violations(tables: Mapping[str, DataFrame], specs: Sequence[TableSpec]) -> DataFrame:
    """Child values that are set but absent from the referenced column.

    One row per distinct (foreign key, value) with the number of child rows.
    Values are counted before the anti-join, so a hot value is one row.
    """
    frames = []
    for spec in specs:
        for fk in spec.foreign_keys:
            if spec.name not in tables or fk.ref_table not in tables:
                continue
            values = (
                tables[spec.name].where(F.col(fk.column).isNotNull())
                .groupBy(F.col(fk.column).alias("v")).agg(F.count(F.lit(1)).alias("child_rows"))
            )
            parents = tables[fk.ref_table].select(F.col(fk.ref_column).alias("v"))
            frames.append(
                values.join(parents, "v", "left_anti").select(
                    F.lit(f"{spec.name}.{fk.column}").alias("column"),
                    F.col("v").cast("string").alias("value"),
                    F.lit(f"{fk.ref_table}.{fk.ref_column}").alias("target"),
                    "child_rows",
                )
            )
    return union_all(frames)


def key_violations(df: DataFrame, key: str) -> DataFrame:
    """Key values that repeat, and a row for null keys: (value, problem, rows)."""
    counted = df.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("rows"))
    problem = F.when(F.col("k").isNull(), "null").when(F.col("rows") > 1, "duplicate")
    return (
        counted.select(F.col("k").cast("string").alias("value"), problem.alias("problem"), "rows")
        .where(F.col("problem").isNotNull())
    )


def dangling_edges(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges with a missing end: (src, dst, missing).  ``sources``/``targets`` have ``id``."""
    no_source = edges.join(sources.select(F.col("id").alias("src")), "src", "left_anti")
    no_target = edges.join(targets.select(F.col("id").alias("dst")), "dst", "left_anti")
    return union_all(
        [
            no_source.select("src", "dst", F.lit("source").alias("missing")),
            no_target.select("src", "dst", F.lit("target").alias("missing")),
        ]
    )


def orphan_nodes(g: PropertyGraph) -> DataFrame:
    """Nodes without any incident edge, label by label on typed keys."""
    frames = []
    for label in g.labels:
        ends = [
            g.edges(*key).select(F.col(side).alias("id")).distinct()
            for key in g.edge_keys
            for side, at in (("src", key[1]), ("dst", key[2]))
            if at == label
        ]
        lonely = g.nodes(label).select("id", "name")
        for end in ends:
            lonely = lonely.join(end, "id", "left_anti")
        frames.append(lonely.select(node_id(label, F.col("id")).alias("id"), F.lit(label).alias("label"), "name"))
    return union_all(frames)


def name_collisions(vertices: DataFrame, label: str = "label", name: str = "display_name") -> DataFrame:
    """Lower-cased names carried by several nodes of one label."""
    return (
        vertices.where(F.col(name).isNotNull())
        .groupBy(label, F.lower(name).alias("folded_name"))
        .agg(F.count(F.lit(1)).alias("nodes"))
        .where("nodes > 1")
    )


def quality_score(issues: DataFrame) -> DataFrame:
    """``max(0, 1 - 0.2 * errors - 0.05 * warnings)``; ``issues`` has ``severity``."""
    counts = issues.agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
    )
    # whole hundredths: exact at two decimals
    score = F.greatest(F.lit(0), 100 - 20 * F.col("errors") - 5 * F.col("warnings")) / 100.0
    return counts.select("errors", "warnings", score.alias("score"))


# ---- shapes ------------------------------------------------------------------


@dataclass(frozen=True)
class Shape:
    """A row rule of one label: ``valid`` must hold for every node."""

    label: str
    path: str
    rule: str
    valid: Column


def datatype(label: str, prop: str, sql_type: str) -> Shape:
    col = F.col(prop)
    return Shape(label, prop, f"datatype {sql_type}", col.isNull() | col.cast("string").try_cast(sql_type).isNotNull())


def required(label: str, prop: str) -> Shape:
    return Shape(label, prop, "min 1", F.col(prop).isNotNull())


def at_most_one(g: PropertyGraph, rel: str) -> DataFrame:
    """Sources with more than one target over ``rel``."""
    spec = g.spec.edge(rel)
    many = g.edges(rel).groupBy("src").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return many.select(
        node_id(spec.source, F.col("src")).alias("id"), F.lit(rel).alias("path"), F.lit("max 1").alias("rule")
    )


def target_class(edges: DataFrame, rel: str, source: str, targets: DataFrame) -> DataFrame:
    """Edges whose target is not a node of the declared class."""
    wrong = edges.join(targets.select(F.col("id").alias("dst")), "dst", "left_anti")
    return wrong.select(
        node_id(source, F.col("src")).alias("id"), F.lit(rel).alias("path"), F.lit("class").alias("rule")
    )


def shape_violations(g: PropertyGraph, shapes: Sequence[Shape]) -> DataFrame:
    """All broken row rules in one pass per label: (id, path, rule)."""
    frames = []
    for label in dict.fromkeys(s.label for s in shapes):
        rules = [s for s in shapes if s.label == label]
        broken = F.array_compact(
            F.array(
                *[
                    F.when(~F.coalesce(s.valid, F.lit(False)), F.struct(F.lit(s.path).alias("path"), F.lit(s.rule).alias("rule")))
                    for s in rules
                ]
            )
        )
        frames.append(
            g.nodes(label).select(node_id(label, F.col("id")).alias("id"), F.explode(broken).alias("r")).select("id", "r.*")
        )
    return union_all(frames)


# ---- discovery ----------------------------------------------------------------


def discover_fks(
    tables: Mapping[str, DataFrame], min_ratio: float = 1.0, integer_only: bool = True
) -> DataFrame:
    """Foreign keys proposed from containment of distinct values.

    A parent column must be unique and not null.  Every column is reduced to
    its distinct values in one scan of its table; the containment of all column pairs then comes
    from one aggregation over the values: for each value, the set of columns it
    occurs in (bounded by the number of columns).
    """
    kinds = ("bigint", "int", "smallint") if integer_only else ("bigint", "int", "smallint", "string")
    values = []
    for table, df in sorted(tables.items()):
        columns = [c for c, kind in df.dtypes if kind in kinds]
        if not columns:
            continue
        cells = F.array(*(F.struct(F.lit(f"{table}.{c}").alias("c"), F.col(c).cast("string").alias("v")) for c in columns))
        rows = df.select(F.explode(cells).alias("x")).select("x.c", "x.v").where("v IS NOT NULL")
        values.append(rows.groupBy("v", "c").agg(F.count(F.lit(1)).alias("n")))
    every = union_all(values)
    profile = every.groupBy("c").agg(
        F.count(F.lit(1)).alias("distinct_values"), (F.max("n") == 1).alias("is_unique")
    )
    by_value = every.groupBy("v").agg(F.collect_set("c").alias("cs"))
    # fold equal column sets first: their number is small, values are many
    by_set = by_value.groupBy(F.array_sort("cs").alias("cs")).agg(F.count(F.lit(1)).alias("n"))
    pairs = (
        by_set.select("cs", "n", F.explode("cs").alias("child"))
        .select("n", "child", F.explode("cs").alias("parent"))
        .where(F.substring_index("child", ".", 1) != F.substring_index("parent", ".", 1))
        .groupBy("child", "parent")
        .agg(F.sum("n").alias("contained"))
    )
    child = profile.select(F.col("c").alias("child"), F.col("distinct_values").alias("child_values"))
    parent = profile.where("is_unique").select(
        F.col("c").alias("parent"), F.col("distinct_values").alias("parent_values")
    )
    ratio = F.round(F.col("contained") / F.col("child_values"), 4)
    return (
        pairs.join(F.broadcast(child), "child")  # one row per column
        .join(F.broadcast(parent), "parent")
        .withColumn("ratio", ratio)
        .where(F.col("contained") >= F.lit(min_ratio) * F.col("child_values"))
        .select("child", "parent", "child_values", "parent_values", "ratio")
    )


def bridge_profile(df: DataFrame, fk1: str, fk2: str) -> DataFrame:
    """Fan-out and pair duplication of a candidate bridge table, as one row."""
    pairs = df.where(F.col(fk1).isNotNull() & F.col(fk2).isNotNull()).groupBy(fk1, fk2).agg(
        F.count(F.lit(1)).alias("n")
    )
    totals = pairs.agg(
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("pairs"),
        F.sum(F.col("n") - 1).alias("duplicate_rows"),
    )
    sides = []
    for column, name in ((fk1, "first"), (fk2, "second")):
        fan = pairs.groupBy(column).agg(F.count(F.lit(1)).alias("f"))
        sides.append(fan.agg(F.count(F.lit(1)).alias(f"{name}_keys"), F.max("f").alias(f"{name}_max_fanout")))
    out = totals.withColumn("_one", F.lit(1))
    for side in sides:
        out = out.join(side.withColumn("_one", F.lit(1)), "_one")  # single rows
    return out.drop("_one").withColumn("extra_columns", F.lit(len(df.columns) - 2).cast("long"))
