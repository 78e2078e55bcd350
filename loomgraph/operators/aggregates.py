"""Aggregates over a property graph.

Groups are formed by property value, so nodes sharing a name merge; pass
``group_by="id"`` where a function offers it to keep them apart.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomgraph.functions.exact import avg_2dp, avg_whole, cents
from loomgraph.functions.lists import distinct, pack, unpack
from loomgraph.functions.plan import auto_broadcast_bytes, counted_side, dealt, estimated_bytes, number_rows, running_total, sized, small_side
from loomgraph.graph import PropertyGraph, union_all
from loomgraph.operators.counting import element_counts
from loomgraph.operators.patterns import anchor_ids, out, walk
from loomgraph.operators.ranking import top_k
from loomgraph.session import settle, tidy


def prop_of(g: PropertyGraph, label: str, prop: str, key: str, alias: str) -> DataFrame:
    """Two columns: node key and one property."""
    return g.nodes(label).select(F.col("id").alias(key), F.col(prop).alias(alias))


def edges_per_target(g: PropertyGraph, rel: str, prop: str) -> DataFrame:
    """``category``, ``cnt``: edges per property value of the target.

    Edges are counted per target id first, so the join sees one row per node
    however hot the node is.
    """
    spec = g.spec.edge(rel)
    per_id = g.edges(rel).groupBy("dst").agg(F.count(F.lit(1)).alias("n"))
    named = per_id.join(prop_of(g, spec.target, prop, "dst", "category"), "dst")
    return named.groupBy("category").agg(F.sum("n").alias("cnt"))


def top_by_neighbors(g: PropertyGraph, rel: str, prop: str, limit: int) -> DataFrame:
    return top_k(edges_per_target(g, rel, prop), limit, F.desc("cnt"), F.asc("category"))


def edges_per_source(g: PropertyGraph, rel: str, prop: str) -> DataFrame:
    spec = g.spec.edge(rel)
    per_id = g.edges(rel).groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    named = per_id.join(prop_of(g, spec.source, prop, "src", "category"), "src")
    return named.groupBy("category").agg(F.sum("n").alias("cnt"))


def sources_per_far_value(
    g: PropertyGraph, rel1: str, rel2: str, prop: str, count_name: str = "order_count", keep: Column | None = None
) -> DataFrame:
    """Distinct starting nodes per property value two hops away."""
    far = g.spec.edge(rel2).target
    values = prop_of(g, far, prop, "dst", "category")
    if keep is not None:
        values = values.where(keep)
    pairs = _sources_of_values(g, rel1, _values_of_middles(g, rel1, rel2, values))
    return pairs.groupBy("category").agg(F.count(F.lit(1)).alias(count_name))


def _values_of_middles(g: PropertyGraph, rel1: str, rel2: str, values: DataFrame) -> DataFrame:
    """Distinct (mid, category): targets of ``rel1`` and the ``values`` (dst, category) they lead to by ``rel2``.

    Folded in tasks of bounded rows before it meets the edges, and stored, so
    that join is planned on its true size.
    """
    rows = g.edges(rel2).join(counted_side(values), "dst").select(F.col("src").alias("mid"), "category")
    mid = dealt(rows, g.source_rows(rel2), "mid").distinct()
    _, unchecked = g.links(rel1)
    if "dst" in unchecked:
        mid = mid.join(g.nodes(g.spec.edge(rel1).target).select(F.col("id").alias("mid")), "mid", "left_semi")
    return sized(mid)


def _sources_of_values(g: PropertyGraph, rel: str, mid: DataFrame) -> DataFrame:
    """Distinct (src, category) of an edge type whose targets have a category in ``mid``.

    The raw rows are dealt by source, folded there and only then looked up: one
    shuffle, in tasks of bounded rows.  A ``mid`` too large for a broadcast
    takes one more, by target.
    """
    spec = g.spec.edge(rel)
    rows, unchecked = g.links(rel)
    rows = rows.select("src", "dst")
    if estimated_bytes(mid) > auto_broadcast_bytes(mid):
        rows = dealt(rows, g.source_rows(rel), "dst")
    rows = rows.withColumnRenamed("dst", "mid").join(mid, "mid")
    pairs = dealt(rows.select("src", "category"), g.source_rows(rel), "src").distinct()
    if "src" in unchecked:
        pairs = pairs.join(g.nodes(spec.source).select(F.col("id").alias("src")), "src", "left_semi")
    return pairs


def _targets(g: PropertyGraph, rel: str) -> DataFrame:
    """Distinct targets of an edge type's rows whose source exists; that the targets exist is not checked."""
    spec = g.spec.edge(rel)
    rows, unchecked = g.links(rel)
    rows = rows.select("src", "dst")
    if "src" in unchecked:
        # not a semi join: that would be carried out before the rows are dealt
        rows = dealt(rows, g.source_rows(rel), "src").join(g.nodes(spec.source).select(F.col("id").alias("src")), "src")
    return rows.select("dst").distinct()


def top_far_values(g: PropertyGraph, rel1: str, rel2: str, prop: str, limit: int) -> DataFrame:
    return top_k(sources_per_far_value(g, rel1, rel2, prop), limit, F.desc("order_count"), F.asc("category"))


def count_nodes(g: PropertyGraph, label: str) -> DataFrame:
    return g.nodes(label).agg(F.count(F.lit(1)).alias("total"))


def extreme(g: PropertyGraph, label: str, returns: str, sort: str, largest: bool = True) -> DataFrame:
    """The node with the largest (or smallest) property; nulls last, then by name and id."""
    order = F.col("value").desc_nulls_last() if largest else F.col("value").asc_nulls_last()
    rows = g.nodes(label).select(F.col(returns).alias("name"), F.col(sort).alias("value"), "id")
    return top_k(rows, 1, order, F.asc("name"), F.asc("id")).select("name", "value")


def average(g: PropertyGraph, label: str, prop: str) -> DataFrame:
    return g.nodes(label).agg(avg_2dp(prop).alias("average"))


def rating_per_target(g: PropertyGraph, rel: str, label: str, rating: str) -> DataFrame:
    """Per target id: rating sum in hundredths and review count."""
    rows = g.edges(rel).join(prop_of(g, label, rating, "src", "_r"), "src")
    c = cents("_r")
    return rows.groupBy("dst").agg(F.sum(c).alias("r_sum"), F.count(c).alias("r_n"))


def product_ratings(g: PropertyGraph) -> DataFrame:
    """Mean rating (2 dp) and review count per product name."""
    per_part = rating_per_target(g, "REVIEWS", "Event", "rating")
    named = per_part.join(prop_of(g, "Part", "name", "dst", "product"), "dst")
    return named.groupBy("product").agg(
        (F.round(F.sum("r_sum") / F.sum("r_n")) / 100.0).alias("avg_rating"),
        F.sum("r_n").alias("review_count"),
    )


def top_rated(g: PropertyGraph, limit: int) -> DataFrame:
    rows = product_ratings(g).select("product", "avg_rating")
    return top_k(rows, limit, F.desc("avg_rating"), F.asc("product"))


def edge_property_counts(g: PropertyGraph, rel: str, prop: str) -> DataFrame:
    return g.edges(rel).groupBy(F.col(prop).alias("group_key")).agg(F.count(F.lit(1)).alias("cnt"))


def node_property_counts(g: PropertyGraph, label: str, prop: str) -> DataFrame:
    return g.nodes(label).groupBy(F.col(prop).alias("group_key")).agg(F.count(F.lit(1)).alias("cnt"))


def supplier_products(g: PropertyGraph, names: Sequence[str]) -> DataFrame:
    """Products of the named suppliers with the product count of each.

    One row per (supplier, product name, copies): the list of one supplier may
    be of any length and is never folded into a single cell.
    """
    chosen = prop_of(g, "Supplier", "name", "dst", "supplier").where(F.col("supplier").isin(list(names)))
    rows = (
        g.edges("SUPPLIED_BY")
        .join(small_side(chosen), "dst")
        .join(prop_of(g, "Part", "name", "src", "product"), "src")
        .groupBy("supplier", "product")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    sizes = rows.groupBy("supplier").agg(F.sum("copies").alias("product_count"))
    return rows.join(F.broadcast(sizes), "supplier")  # one row per named supplier


def same_category_top_rated(g: PropertyGraph, customer: str, limit: int) -> DataFrame:
    """Best-rated products in the categories the customer has bought from."""
    start = anchor_ids(g, "Customer", F.col("name") == customer)
    brands = walk(g, start, [out("PLACED"), out("CONTAINS"), out("BELONGS_TO")])
    in_brand = g.edges("BELONGS_TO").join(
        small_side(brands).withColumnRenamed("at", "dst"), "dst", "left_semi"
    ).select(F.col("src").alias("part"), F.col("dst").alias("brand"))
    ratings = rating_per_target(g, "REVIEWS", "Event", "rating").withColumnRenamed("dst", "part")
    rows = (
        in_brand.join(ratings, "part")
        .join(prop_of(g, "Part", "name", "part", "product"), "part")
        .join(prop_of(g, "Brand", "name", "brand", "category"), "brand")
        .groupBy("product", "category")
        .agg((F.round(F.sum("r_sum") / F.sum("r_n")) / 100.0).alias("avg_rating"))
    )
    return top_k(rows, limit, F.desc("avg_rating"), F.asc("product"), F.asc("category"))


def coupon_comparison(g: PropertyGraph, whole: bool = False) -> DataFrame:
    """Order count and mean amount of orders with and without a coupon."""
    used = g.edges("USED_COUPON").select(F.col("src").alias("id")).distinct().withColumn("_u", F.lit("used"))
    rows = g.nodes("Order").join(used, "id", "left")
    mean = avg_whole("total_amount") if whole else avg_2dp("total_amount")
    return rows.groupBy(F.coalesce("_u", F.lit("unused")).alias("coupon_status")).agg(
        F.count(F.lit(1)).alias("order_count"), mean.alias("avg_amount")
    )


def order_amount(g: PropertyGraph) -> DataFrame:
    return g.nodes("Order").agg(
        avg_whole("total_amount").alias("avg_amount"), F.count(F.lit(1)).alias("total_orders")
    )


def payment_summary(g: PropertyGraph) -> DataFrame:
    return g.nodes("Payment").groupBy("method").agg(
        F.count(F.lit(1)).alias("count"), avg_whole("amount").alias("avg_amount")
    )


def endpoint_summary(g: PropertyGraph, rel: str, limit: int | None = None) -> DataFrame:
    """Edges of one type by (source label, target label); with ``limit`` only the most frequent pairs."""
    frames = [
        g.edges(*key).select(F.lit(key[1]).alias("source_type"), F.lit(key[2]).alias("target_type"))
        for key in g.edge_keys
        if key[0] == rel
    ]
    counted = union_all(frames).groupBy("source_type", "target_type").agg(F.count(F.lit(1)).alias("count"))
    return counted if limit is None else top_k(counted, limit, F.desc("count"), F.asc("source_type"), F.asc("target_type"))


def customer_segments(g: PropertyGraph, vip: float = 5_000_000, regular: float = 2_000_000) -> DataFrame:
    orders = g.nodes("Order").select(F.col("id").alias("dst"), cents("total_amount").alias("_c"))
    per_id = (
        g.edges("PLACED").join(orders, "dst").groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.sum("_c").alias("c"))
    )
    per_name = (
        per_id.join(prop_of(g, "Customer", "name", "src", "customer"), "src")
        .groupBy("customer")
        .agg(F.sum("n").alias("orders"), F.sum("c").alias("c"))
    )
    return per_name.select(
        "customer",
        "orders",
        F.round(F.col("c") / 100).alias("total_spent"),
        F.when(F.col("c") > vip * 100, "VIP").when(F.col("c") > regular * 100, "Regular").otherwise("Light").alias(
            "segment"
        ),
    )


def category_distribution(g: PropertyGraph) -> DataFrame:
    """Distinct orders and distinct products per category.

    Each distinct count is its own two-step aggregate; joining the two small
    results avoids expanding every row once per distinct column.
    """
    mid = _values_of_middles(g, "CONTAINS", "BELONGS_TO", prop_of(g, "Brand", "name", "dst", "category"))
    orders = _sources_of_values(g, "CONTAINS", mid).groupBy("category").agg(F.count(F.lit(1)).alias("order_count"))
    contains, unchecked = dealt_edges(g, "CONTAINS", "dst")
    contains = contains.select(F.col("src").alias("order"), F.col("dst").alias("part"))
    parts = _contained(g, contains, "src" in unchecked).withColumnRenamed("part", "mid")
    products = mid.join(parts, "mid", "left_semi").groupBy("category").agg(F.count(F.lit(1)).alias("product_count"))
    return orders.join(products, "category")


HEAD_BLOCK = 64
ORDER_TASK_ROWS = 1_600_000
MAX_HEADS = 1_000_000


def dealt_edges(g: PropertyGraph, rel: str, side: str) -> tuple[DataFrame, dict[str, str]]:
    """(src, dst) of an edge type, dealt by one side and merged there; and the endpoints still to be checked.

    Columns are renamed by the caller: two analyses in one plan then share the shuffle.
    """
    spec = g.spec.edge(rel)
    rows, unchecked = g.links(rel)
    rows = dealt(rows.select("src", "dst"), g.source_rows(rel), side)
    return (rows.distinct() if g.is_bound(spec.key) and not spec.unique else rows), unchecked


def numbered_suppliers(g: PropertyGraph) -> tuple[DataFrame, DataFrame]:
    """(supplier, head): a dense number per name, from 1; (dst, head): that of every supplier with a name."""
    suppliers = prop_of(g, "Supplier", "name", "dst", "supplier").where("supplier IS NOT NULL")
    heads = number_rows(suppliers.select("supplier").distinct(), [F.col("supplier")], "head")
    return heads, counted_side(suppliers.join(heads, "supplier").select("dst", "head"), MAX_HEADS)


def _packed(lists: DataFrame) -> DataFrame:
    """(part, heads) with the heads as bytes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pack(batch.column(1))], ["part", "heads"])

    schema = T.StructType([lists.schema["part"], T.StructField("heads", T.BinaryType())])
    return lists.select("part", "heads").mapInArrow(tidy(scan), schema)


_NONE = np.iinfo(np.int64).min
_SUMS = ("head", "orders", "known", "hi", "lo", "hi_distinct", "lo_distinct")


class _OrderSums:
    """Sums per head over orders that arrive in order, the rows with their amounts before those with their heads.

    Amounts are added in two halves, so no sum of a task leaves 64 bits.  Up to
    ``MAX_HEADS`` heads, sums are kept until the end; of more, those of a batch are handed on.
    """

    def __init__(self, heads: int) -> None:
        self.kept = np.zeros((len(_SUMS) - 1, heads + 1), np.int64) if heads <= MAX_HEADS else None
        self.order, self.copies, self.amount, self.seen = None, 0, None, np.empty(0, np.int64)

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        coded = batch.column(0).dictionary_encode()
        of_row = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        keys = coded.dictionary
        first, final = keys[0].as_py() == self.order, len(keys) - 1
        amounts = batch.column(2).fill_null(_NONE).to_numpy(zero_copy_only=False)
        is_order = batch.column(1).is_null().to_numpy(zero_copy_only=False)
        copies = np.bincount(of_row[is_order], minlength=len(keys))
        amount = np.full(len(keys), _NONE, np.int64)
        np.maximum.at(amount, of_row[is_order], amounts[is_order])
        if first:
            copies[0] += self.copies
            amount[0] = max(amount[0], self.amount)
        row, head = unpack(batch.column(1))
        of_pair = of_row[row]
        there = copies[of_pair] > 0
        of_pair, head = of_pair[there], head[there]
        # all paths of an order to a head, then the order once
        pairs = new = _distinct(of_pair, head)
        if first and len(self.seen):
            new = [x[(pairs[0] > 0) | ~np.isin(pairs[1], self.seen)] for x in pairs]
        seen = pairs[1][pairs[0] == final]
        self.seen = distinct(np.concatenate([self.seen, seen])) if first and final == 0 else seen
        self.order, self.copies, self.amount = keys[final].as_py(), copies[final], amount[final]
        yield from self._sum(of_pair, head, *new, copies, amount)

    def _sum(self, of_pair, head, of_new, new, copies, amount) -> Iterator[pa.RecordBatch]:
        if self.kept is None:
            ids = distinct(head)
            at, at_new = np.searchsorted(ids, head), np.searchsorted(ids, new)
            into = np.zeros((len(_SUMS) - 1, len(ids)), np.int64)
        else:
            ids, at, at_new, into = None, head, new, self.kept
        priced = amount != _NONE
        hi, lo = np.where(priced, amount >> 31, 0), np.where(priced, amount & 0x7FFFFFFF, 0)
        for i, where, value in (
            (0, at_new, np.ones(len(copies), np.int64)[of_new]), (1, at_new, priced[of_new].astype(np.int64)),
            (2, at, (hi * copies)[of_pair]), (3, at, (lo * copies)[of_pair]), (4, at_new, hi[of_new]), (5, at_new, lo[of_new]),
        ):
            np.add.at(into[i], where, value)
        if ids is not None:
            yield from self._rows(ids, into)

    def _rows(self, ids: np.ndarray, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, *sums)], list(_SUMS))

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.kept is not None:
            ids = np.flatnonzero(self.kept[0])
            yield from self._rows(ids, self.kept[:, ids])


def _distinct(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """The distinct pairs of two columns of numbers from 0."""
    width = int(b.max(initial=0)) + 1
    both = distinct(a * width + b)
    return [both // width, both % width]


def _sums_by_head(lines: DataFrame, orders: DataFrame, heads: int, rows: int) -> DataFrame:
    """Orders and money of every head, from (order, heads) and (order, c).

    All rows of an order have to meet in one task, so they are dealt here and
    not by a join, whose large partitions may be split.  A task gives a row per
    head at most; it takes many orders, so that these are few.
    """
    both = union_all([orders.select("order", F.lit(None).cast("binary").alias("heads"), "c"), lines.select("order", "heads")])
    tasks = -(-rows // ORDER_TASK_ROWS)
    parallel = lines.sparkSession.sparkContext.defaultParallelism
    both = both.repartition(tasks, "order") if tasks > parallel else both.repartition("order")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _OrderSums(heads)
        for batch in batches:
            if batch.num_rows:
                yield from sums.add(batch)
        yield from sums.end()

    schema = T.StructType([T.StructField(c, T.LongType()) for c in _SUMS])
    parts = both.sortWithinPartitions("order", F.col("heads").isNotNull()).mapInArrow(tidy(scan), schema)

    def whole(kind: str) -> Column:
        total = F.sum(f"hi{kind}") * F.lit(1 << 31) + F.sum(f"lo{kind}")
        return F.when(F.sum("known") > 0, F.round(total / 100))

    return parts.groupBy("head").agg(
        F.sum("orders").alias("orders"), whole("").alias("revenue"), whole("_distinct").alias("revenue_distinct")
    )


def supplier_dependency(g: PropertyGraph) -> DataFrame:
    """Products, orders and revenue behind each supplier.

    ``revenue`` counts an order once per product of the supplier it contains
    (the fan-out figure); ``revenue_distinct`` counts it once per supplier.
    Suppliers sharing a name count as one and get one number; the numbers are
    dense, so the suppliers of a part travel to its orders in a few bytes each.
    """
    heads, numbers = numbered_suppliers(g)
    rows, unchecked = dealt_edges(g, "SUPPLIED_BY", "src")
    rows = rows.withColumnRenamed("src", "part")
    contains, unsure = dealt_edges(g, "CONTAINS", "dst")
    contains = contains.select(F.col("src").alias("order"), F.col("dst").alias("part"))
    if "src" in unchecked or "dst" in unsure:
        parts = g.nodes("Part").select(F.col("id").alias("part"))
        # not a semi join: that may be carried out before the rows are dealt
        rows = rows.join(parts.distinct(), "part")
    supply = rows.join(numbers, "dst").select("part", "head")
    # orders get their parts' suppliers in lists of about HEAD_BLOCK; only there are these unfolded
    slot = F.pmod(F.xxhash64("head"), F.ceil(F.col("k") / HEAD_BLOCK))
    counted = supply.join(supply.groupBy("part").agg(F.count(F.lit(1)).alias("k")), "part")
    lists = counted.groupBy("part", slot.alias("slot")).agg(F.sort_array(F.collect_list("head")).alias("heads"))
    lines = contains.join(_packed(lists), "part").select("order", "heads")
    amounts = g.nodes("Order").select(F.col("id").alias("order"), cents("total_amount").alias("c"))
    sums = _sums_by_head(lines, amounts, heads.count(), g.source_rows("CONTAINS") + g.node_rows("Order"))
    products = (
        supply.distinct().join(_contained(g, contains, "src" in unsure), "part", "left_semi")
        .groupBy("head").agg(F.count(F.lit(1)).alias("products"))
    )
    return sums.join(products, "head").join(heads, "head").drop("head")


def _contained(g: PropertyGraph, contains: DataFrame, check: bool) -> DataFrame:
    """Parts of orders that exist.  One order of each part is looked up, the others only where that one is missing."""
    if not check:
        return contains.select("part")
    known = g.nodes("Order").select(F.col("id").alias("order"))
    one = contains.groupBy("part").agg(F.min("order").alias("order"))
    missing = one.join(known, "order", "left_anti").select("part")
    others = contains.join(missing, "part", "left_semi").join(known, "order", "left_semi").select("part")
    return one.join(known, "order", "left_semi").select("part").unionByName(others)


def review_quality(g: PropertyGraph) -> DataFrame:
    """Mean rating and distinct order count per product name.

    The pattern pairs every review of a product with every order containing it,
    so a part's ratings weigh by its order count.  Both sides are aggregated
    per part first and multiplied, which gives the same mean without pairing.
    """
    contains = g.edges("CONTAINS").select(F.col("src").alias("order"), "dst")
    per_part = contains.groupBy("dst").agg(F.count(F.lit(1)).alias("o_n"))
    ratings = rating_per_target(g, "REVIEWS", "Event", "rating")
    names = prop_of(g, "Part", "name", "dst", "product")
    weighed = (
        per_part.join(ratings, "dst").join(names, "dst").groupBy("product")
        .agg(
            F.sum(F.col("r_sum") * F.col("o_n")).alias("s"),
            F.sum(F.col("r_n") * F.col("o_n")).alias("n"),
        )
        .select("product", (F.round(F.col("s") / F.col("n")) / 100.0).alias("avg_rating"))
    )
    rated = names.join(ratings.select("dst"), "dst", "left_semi")
    orders = (
        contains.join(rated, "dst").select("order", "product").distinct()
        .groupBy("product").agg(F.count(F.lit(1)).alias("order_count"))
    )
    return weighed.join(orders, "product")


# ---- pair support ------------------------------------------------------------

PAIR_BLOCK = 64
GRID_SALTS = 32


def pair_support(g: PropertyGraph, block: int = PAIR_BLOCK) -> DataFrame:
    """How many orders contain both of two product names, lower product key first.

    Baskets of at most ``block`` products are paired inside the basket.  A
    larger basket is cut, along the product key, into blocks of exactly
    ``block`` products: only products of one block meet directly.  Across
    blocks only counts per product name meet, so a basket of n products and v
    names costs about n * v, never n * n.
    """
    names = prop_of(g, "Part", "name", "dst", "name")
    # the smallest key stands for a name, so pairs are pairs of numbers
    heads = names.groupBy("name").agg(F.min("dst").alias("item"))
    coded = names.join(heads, "name").select("dst", "item")
    # read several times below: stored once instead of being merged again
    items = settle(g.edges("CONTAINS").select("src", "dst").join(coded, "dst").select("src", "dst", "item"))
    large = settle(items.groupBy("src").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block).select("src"))
    if large.isEmpty():
        parts = [_pairs_within(items, ["src"])]
    else:
        ranked = running_total(items.join(large, "src", "left_semi"), ["src"], "dst", F.lit(1), "_rank")
        blocked = settle(ranked.select("src", "dst", "item", F.floor(F.col("_rank") / block).alias("blk")))
        parts = [
            _pairs_within(items.join(large, "src", "left_anti"), ["src"]),
            _pairs_within(blocked, ["src", "blk"]),
            _pairs_across(blocked),
        ]
    support = union_all(parts).groupBy("product_1", "product_2").agg(F.sum("n").alias("co_purchase_count"))
    for side in ("product_1", "product_2"):
        spelled = heads.select(F.col("item").alias(side), F.col("name").alias("_name"))
        support = support.join(spelled, side).drop(side).withColumnRenamed("_name", side)
    return support.select("product_1", "product_2", "co_purchase_count")


def _pairs_within(items: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs inside groups of at most ``PAIR_BLOCK`` products, folded at once.

    A group fits one small array, so it is gathered once instead of joined
    with itself.
    """
    packed = items.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("dst", "item"))).alias("l"))
    pairs = F.flatten(
        F.transform(
            "l",
            lambda x, i: F.transform(
                F.slice("l", i + 2, F.size("l")),
                lambda y: F.struct(x["item"].alias("product_1"), y["item"].alias("product_2")),
            ),
        )
    )
    return packed.select(F.explode(pairs).alias("p")).groupBy("p.product_1", "p.product_2").agg(
        F.count(F.lit(1)).alias("n")
    )


def _pairs_across(blocked: DataFrame) -> DataFrame:
    """Pairs whose products lie in different blocks of a basket, from counts alone.

    For each block and name: how many products of that name lie in earlier
    blocks.  A block's own names then meet those running counts.
    """
    counts = settle(blocked.groupBy("src", "blk", "item").agg(F.count(F.lit(1)).alias("c")))
    # salted: the names and blocks of one huge basket meet in many tasks
    salts = F.array(*map(F.lit, range(GRID_SALTS)))
    names = counts.select("src", "item").distinct().withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(GRID_SALTS)).cast("int"))
    blocks = counts.select("src", "blk").distinct().withColumn("salt", F.explode(salts))
    grid = names.join(blocks, ["src", "salt"]).drop("salt")
    earlier = Window.partitionBy("src", "item").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        grid.join(counts, ["src", "blk", "item"], "left")
        .withColumn("seen", F.sum("c").over(earlier))
        .where(F.col("seen") > 0)
        .select("src", "blk", F.col("item").alias("product_1"), "seen")
    )
    here = counts.select("src", "blk", F.col("item").alias("product_2"), "c")
    return (
        before.join(here, ["src", "blk"])
        .groupBy("product_1", "product_2")
        .agg(F.sum(F.col("seen") * F.col("c")).alias("n"))
    )


def co_purchase(g: PropertyGraph, limit: int = 10) -> DataFrame:
    return top_k(
        pair_support(g), limit, F.desc("co_purchase_count"), F.asc("product_1"), F.asc("product_2")
    )


# ---- whole-graph statistics ----------------------------------------------------


def graph_stats(g: PropertyGraph) -> DataFrame:
    """Counts by label and by edge type, and both totals, in one job."""
    return (
        element_counts(g)
        .rollup("kind", "name")
        .agg(F.sum("n").alias("cnt"))
        .where(F.col("kind").isNotNull())
        .select("kind", F.coalesce("name", F.lit("(total)")).alias("name"), "cnt")
    )


def stats_dashboard(g: PropertyGraph, k: int = 10) -> DataFrame:
    """Top labels, top edge types, type counts and density, as (metric, name, value)."""
    # one row per label and edge type
    stats = graph_stats(g)
    named = stats.where(F.col("name") != "(total)")
    top = union_all(
        [
            top_k(named.where(F.col("kind") == kind), k, F.desc("cnt"), F.asc("name")).select(
                F.lit(f"top_{kind}").alias("metric"), "name", F.col("cnt").cast("double").alias("value")
            )
            for kind in ("node", "edge")
        ]
    )
    summary = named.agg(
        F.count_if(F.col("kind") == "node").cast("double").alias("label_count"),
        F.count_if(F.col("kind") == "edge").cast("double").alias("edge_type_count"),
        F.sum(F.when(F.col("kind") == "edge", F.col("cnt")).otherwise(0)).alias("_e"),
        F.sum(F.when(F.col("kind") == "node", F.col("cnt")).otherwise(0)).alias("_n"),
    ).withColumn("density", F.when(F.col("_n") > 0, F.round(F.col("_e") / F.col("_n"), 2)).otherwise(0.0))
    single = summary.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(m).alias("metric"), F.lit("").alias("name"), F.col(m).alias("value"))
                    for m in ("label_count", "edge_type_count", "density")
                ]
            )
        ).alias("r")
    ).select("r.*")
    return top.unionByName(single)


def live_schema(g: PropertyGraph) -> DataFrame:
    """Labels and edge types with the properties that occur, and how often.

    A full scan per type: a property carried by few nodes is still reported.
    """
    frames = []
    for kind, name, df in [("node", label, g.nodes(label)) for label in g.labels] + [
        ("edge", key[0], g.edges(*key)) for key in g.edge_keys
    ]:
        skip = ("src", "dst") if kind == "edge" else ()
        props = [c for c in df.columns if c not in skip]
        if not props:
            continue
        counted = df.agg(*[F.count(p).alias(p) for p in props])
        frames.append(
            counted.select(
                F.explode(
                    F.array(*[F.struct(F.lit(p).alias("property"), F.col(p).alias("present")) for p in props])
                ).alias("r")
            ).select(F.lit(kind).alias("kind"), F.lit(name).alias("name"), "r.*")
        )
    return union_all(frames).where(F.col("present") > 0)


def degrees(g: PropertyGraph) -> DataFrame:
    """In plus out degree per composite id; isolated nodes have degree 0.

    Endpoint counts are folded per typed key before ids become strings.
    """
    frames = []
    for key in g.edge_keys:
        _, source, target = key
        for column, label in (("src", source), ("dst", target)):
            rows = dealt(g.edges(*key).select(column), g.source_rows(*key), column)
            per_id = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
            frames.append(
                per_id.select(F.concat(F.lit(f"{label}_"), F.col(column).cast("string")).alias("id"), "n")
            )
    zero = g.vertices().select("id", F.lit(0).cast("long").alias("n"))
    every = dealt(union_all([*frames, zero]), sum(g.node_rows(label) for label in g.labels), "id")
    return every.groupBy("id").agg(F.sum("n").alias("degree"))


def hub(g: PropertyGraph) -> DataFrame:
    """The node of highest degree; the smallest id wins ties."""
    return top_k(degrees(g), 1, F.desc("degree"), F.asc("id"))


