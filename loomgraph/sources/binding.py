"""Binding of the TPC-H-like test tables to a graph."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.graph import PropertyGraph
from loomgraph.spec import ColumnSpec, EdgeSpec, ForeignKey, GraphSpec, NodeSpec, TableSpec

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()

SALES_GRAPH = GraphSpec(
    nodes=(
        NodeSpec("Region", "region", "r_regionkey", {"name": "r_name"}, unique=True, named=True),
        NodeSpec("Nation", "nation", "n_nationkey", {"name": "n_name"}, unique=True, named=True),
        NodeSpec(
            "Customer",
            "customer",
            "c_custkey",
            {"name": "c_name", "acctbal": "c_acctbal", "segment": "c_mktsegment"},
            unique=True,
            named=True,
        ),
        NodeSpec(
            "Supplier", "supplier", "s_suppkey", {"name": "s_name", "acctbal": "s_acctbal"}, unique=True, named=True
        ),
        NodeSpec(
            "Part",
            "part",
            "p_partkey",
            {"name": "p_name", "type": "p_type", "size": "p_size", "price": "p_retailprice"},
            unique=True,
            named=True,
        ),
        NodeSpec("Brand", "part", "p_brand", name_template="{id}"),
        NodeSpec(
            "Order",
            "orders",
            "o_orderkey",
            {"status": "o_orderstatus", "total_amount": "o_totalprice", "ordered_at": "o_orderdate"},
            unique=True,
        ),
        NodeSpec(
            "Payment", "orders", "o_orderkey", {"method": "o_orderpriority", "amount": "o_totalprice"}, unique=True
        ),
        NodeSpec("Coupon", "coupon_use", "code", name_template="{id}"),
        NodeSpec("Event", "event_reviews", "event_id", {"rating": "value", "type": "event_type"}, unique=True),
        NodeSpec("Turn", "turns", "turn_id", {"role": "role"}, unique=True),
    ),
    edges=(
        EdgeSpec("IN_REGION", "Nation", "Region", "nation", "n_nationkey", "n_regionkey", unique=True),
        EdgeSpec("LIVES_AT", "Customer", "Nation", "customer", "c_custkey", "c_nationkey", unique=True),
        EdgeSpec("LOCATED_IN", "Supplier", "Nation", "supplier", "s_suppkey", "s_nationkey", unique=True),
        EdgeSpec("PLACED", "Customer", "Order", "orders", "o_custkey", "o_orderkey", unique=True),
        EdgeSpec(
            "CONTAINS",
            "Order",
            "Part",
            "lineitem",
            "l_orderkey",
            "l_partkey",
            {"status": "l_linestatus", "quantity": "l_quantity", "price": "l_extendedprice"},
            merge_order=("l_linenumber", "l_extendedprice"),
            derivation="fk_join_table",
        ),
        EdgeSpec("BELONGS_TO", "Part", "Brand", "part", "p_partkey", "p_brand", unique=True),
        EdgeSpec(
            "SUPPLIED_BY", "Part", "Supplier", "lineitem", "l_partkey", "l_suppkey", derivation="fk_join_table"
        ),
        EdgeSpec("PAID_BY", "Order", "Payment", "orders", "o_orderkey", "o_orderkey", unique=True),
        EdgeSpec("USED_COUPON", "Order", "Coupon", "coupon_use", "l_orderkey", "code"),
        EdgeSpec("WROTE", "Customer", "Event", "event_reviews", "user_id", "event_id", unique=True),
        EdgeSpec("REVIEWS", "Event", "Part", "event_reviews", "event_id", "part_key", unique=True),
        EdgeSpec("NEXT_TURN", "Turn", "Turn", "turns", "turn_id", "next_id", unique=True),
    ),
)


def _table(name: str, pk: str, columns: str, *fks: ForeignKey) -> TableSpec:
    specs = []
    for item in columns.split(","):
        col, sql_type = item.strip().split(" ", 1)
        specs.append(ColumnSpec(col, sql_type, nullable=col != pk))
    return TableSpec(name, tuple(specs), pk, fks)


SALES_TABLES: dict[str, TableSpec] = {
    t.name: t
    for t in (
        _table("region", "r_regionkey", "r_regionkey INT, r_name VARCHAR(25)"),
        _table(
            "nation",
            "n_nationkey",
            "n_nationkey INT, n_name VARCHAR(25), n_regionkey INT",
            ForeignKey("n_regionkey", "region", "r_regionkey"),
        ),
        _table(
            "customer",
            "c_custkey",
            "c_custkey BIGINT, c_name VARCHAR(25), c_nationkey INT, c_acctbal DOUBLE, c_mktsegment VARCHAR(10)",
            ForeignKey("c_nationkey", "nation", "n_nationkey"),
        ),
        _table(
            "supplier",
            "s_suppkey",
            "s_suppkey BIGINT, s_name VARCHAR(25), s_nationkey INT, s_acctbal DOUBLE",
            ForeignKey("s_nationkey", "nation", "n_nationkey"),
        ),
        _table(
            "part",
            "p_partkey",
            "p_partkey BIGINT, p_name VARCHAR(55), p_brand VARCHAR(10), p_type VARCHAR(25), p_size INT, "
            "p_retailprice DOUBLE",
        ),
        _table(
            "orders",
            "o_orderkey",
            "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus CHAR(1), o_totalprice DOUBLE, "
            "o_orderdate TIMESTAMP, o_orderpriority VARCHAR(15)",
            ForeignKey("o_custkey", "customer", "c_custkey"),
        ),
        _table(
            "lineitem",
            "",
            "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
            "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag CHAR(1), l_linestatus CHAR(1), "
            "l_shipdate TIMESTAMP",
            ForeignKey("l_orderkey", "orders", "o_orderkey"),
            ForeignKey("l_partkey", "part", "p_partkey"),
            ForeignKey("l_suppkey", "supplier", "s_suppkey"),
        ),
    )
}


def coupon_use(lineitem: DataFrame) -> DataFrame:
    """Deeply discounted lines stand for coupon use."""
    code = F.concat(F.lit("DISC"), F.round(F.col("l_discount") * 100).cast("long"))
    return lineitem.where("l_discount >= 0.10").select("l_orderkey", code.alias("code"))


def event_reviews(events: DataFrame) -> DataFrame:
    return events.withColumn("part_key", F.get_json_object("props", "$.k").try_cast("long"))


def turns(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        "conv_id",
        "turn",
        F.concat_ws(":", "conv_id", "turn").alias("turn_id"),
        F.concat_ws(":", F.col("conv_id"), F.col("turn") + 1).alias("next_id"),
        "role",
        "text",
    )


DERIVED = {
    "coupon_use": ("lineitem", coupon_use),
    "event_reviews": ("events", event_reviews),
    "turns": ("conversations", turns),
}


class SalesTables(Mapping):
    """Base and derived tables of one folder by name, opened when first used."""

    def __init__(self, open_table) -> None:
        self._open = open_table
        self._known: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._known:
            if name in DERIVED:
                base, derive = DERIVED[name]
                self._known[name] = derive(self[base])
            elif name in TABLES:
                self._known[name] = self._open(name)
            else:
                raise KeyError(name)
        return self._known[name]

    def __iter__(self):
        return iter([*TABLES, *DERIVED])

    def __len__(self) -> int:
        return len(TABLES) + len(DERIVED)

    def __contains__(self, name: object) -> bool:
        return name in TABLES or name in DERIVED


class Workspace:
    """Tables of one folder and the graph built from them, all lazy."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.tables = SalesTables(lambda name: spark.read.parquet(self.path(name)))
        self._graph: PropertyGraph | None = None

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def t(self, name: str) -> DataFrame:
        return self.tables[name]

    @property
    def graph(self) -> PropertyGraph:
        if self._graph is None:
            self._graph = PropertyGraph.build(SALES_GRAPH, self.tables)
        return self._graph
