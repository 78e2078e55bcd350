"""Analyses anchored at entities, and their text forms.

Each takes a condition on the anchor label, so one job answers one entity or
many.  Result lists are rows, not arrays: a supplier or a product may have any
number of members, and no list is ever gathered into one cell.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.exact import cents
from loomgraph.functions.plan import dealt, number_rows, small_side
from loomgraph.graph import PropertyGraph, union_all
from loomgraph.operators import aggregates as agg
from loomgraph.operators.aggregates import prop_of
from loomgraph.operators.ranking import ranked_top, top_k


def _anchors(g: PropertyGraph, label: str, condition: Column, key: str, name: str) -> DataFrame:
    return g.nodes(label).where(condition).select(F.col("id").alias(key), F.col("name").alias(name))


def _part_brand(g: PropertyGraph) -> DataFrame:
    return (
        g.edges("BELONGS_TO")
        .join(prop_of(g, "Brand", "name", "dst", "category"), "dst")
        .select(F.col("src").alias("part"), "category")
    )


def _customer_parts(g: PropertyGraph, condition: Column) -> DataFrame:
    """(customer, order, part) of the anchored customers; name and key of the customer."""
    who = small_side(_anchors(g, "Customer", condition, "src", "customer"))
    placed, _ = g.links("PLACED")  # one row per order
    orders = placed.join(who, "src").select(F.col("src").alias("customer_id"), "customer", F.col("dst").alias("order"))
    few = small_side(orders)
    rows, unchecked = g.links("CONTAINS")
    contains = rows.select(F.col("src").alias("order"), F.col("dst").alias("part"))
    # anchored first, merged after: the fold sees only the anchors' rows
    if few is orders:  # not known to be few: every order's rows meet in tasks of bounded rows
        contains = dealt(contains, g.source_rows("CONTAINS"), "order")
    found = contains.join(few, "order").distinct()
    if "dst" in unchecked:
        found = found.join(g.nodes(unchecked["dst"]).select(F.col("id").alias("part")), "part", "left_semi")
    return found


def customer_orders(g: PropertyGraph, condition: Column) -> DataFrame:
    """Order, whole amount, product and category; one row per product of an order."""
    amounts = g.nodes("Order").select(
        F.col("id").alias("order"), F.round(cents("total_amount") / 100).alias("amount")
    )
    return (
        _customer_parts(g, condition)
        .join(amounts, "order")
        .join(prop_of(g, "Part", "name", "part", "product"), "part")
        .join(_part_brand(g), "part")
        .select("customer", F.col("order").alias("order_id"), "amount", "product", "category")
    )


def customer_reviews(g: PropertyGraph, condition: Column) -> DataFrame:
    who = small_side(_anchors(g, "Customer", condition, "src", "customer"))
    wrote = g.edges("WROTE").join(who, "src").select("customer", F.col("dst").alias("event"))
    reviewed = g.edges("REVIEWS").select(F.col("src").alias("event"), F.col("dst").alias("part"))
    facts = g.nodes("Event").select(F.col("id").alias("event"), "rating", F.col("type").alias("comment"))
    return (
        wrote.join(reviewed, "event")
        .join(facts, "event")
        .join(prop_of(g, "Part", "name", "part", "product"), "part")
        .select("customer", "product", "rating", "comment")
    )


def _tagged(rows: DataFrame, who: str, kind: str, column: str) -> DataFrame:
    return rows.select(who, F.lit(kind).alias("kind"), F.col(column).alias("item")).distinct()


def _measure(rows: DataFrame, who: str, kind: str, value: Column) -> DataFrame:
    return rows.groupBy(who).agg(value.cast("double").alias("value")).select(
        who, F.lit(kind).alias("kind"), "value"
    )


def customer_profile(g: PropertyGraph, condition: Column) -> DataFrame:
    """Products, suppliers, categories, order count and spending of customers.

    Rows (customer, kind, item, value).  ``total_spent`` counts an order once
    per product and supplier path, as the two-hop pattern does;
    ``total_spent_distinct`` counts every order once.
    """
    parts = _customer_parts(g, condition)
    named = parts.join(prop_of(g, "Part", "name", "part", "product"), "part")
    brands = parts.join(_part_brand(g), "part")
    # suppliers are folded per (customer, part) first: a part repeats over orders
    who_part = parts.select("customer", "part").distinct()
    supply = g.edges("SUPPLIED_BY").select(F.col("src").alias("part"), F.col("dst").alias("supplier_id"))
    suppliers = (
        supply.join(small_side(who_part), "part").select("customer", "supplier_id").distinct()
        .join(prop_of(g, "Supplier", "name", "supplier_id", "supplier"), "supplier_id")
    )
    ways = supply.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    amounts = g.nodes("Order").select(F.col("id").alias("order"), cents("total_amount").alias("c"))
    fanned = (
        parts.join(ways, "part", "left")
        .groupBy("customer", "order")
        .agg(F.sum(F.coalesce("n", F.lit(1))).alias("paths"))
        .join(amounts, "order")
    )
    return union_all(
        [
            _tagged(named, "customer", "product", "product"),
            _tagged(suppliers, "customer", "supplier", "supplier"),
            _tagged(brands, "customer", "category", "category"),
            _measure(fanned, "customer", "order_count", F.count(F.lit(1))),
            _measure(fanned, "customer", "total_spent", F.sum(F.col("c") * F.col("paths")) / 100),
            _measure(fanned, "customer", "total_spent_distinct", F.sum("c") / 100),
        ]
    )


def _supplied_parts(g: PropertyGraph, who: DataFrame) -> DataFrame:
    """(part, supplier) of the anchored suppliers ``who`` (dst, supplier)."""
    few = small_side(who)
    spec = g.spec.edge("SUPPLIED_BY")
    rows, unchecked = g.links("SUPPLIED_BY")
    # anchored first, merged after: the fold sees only the anchors' rows
    if few is who:  # not known to be few
        rows = dealt(rows, g.source_rows("SUPPLIED_BY"), "src")
    rows = rows.select("src", "dst").join(few.select("dst"), "dst", "left_semi")
    if g.is_bound(spec.key) and not spec.unique:
        rows = rows.distinct()
    if "src" in unchecked:
        rows = rows.join(g.nodes(unchecked["src"]).select(F.col("id").alias("src")), "src", "left_semi")
    return rows.join(few, "dst").select(F.col("src").alias("part"), "supplier")


def supplier_impact(g: PropertyGraph, condition: Column) -> DataFrame:
    """What depends on suppliers: rows (supplier, kind, item, value)."""
    parts = _supplied_parts(g, _anchors(g, "Supplier", condition, "dst", "supplier"))
    named = parts.join(prop_of(g, "Part", "name", "part", "product"), "part")
    orders = (
        g.edges("CONTAINS").select(F.col("src").alias("order"), F.col("dst").alias("part"))
        .join(small_side(parts), "part")
        .groupBy("supplier", "order")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    amounts = g.nodes("Order").select(F.col("id").alias("order"), cents("total_amount").alias("c"))
    priced = orders.join(amounts, "order")
    buyers = (
        g.edges("PLACED").select(F.col("src").alias("customer_id"), F.col("dst").alias("order"))
        .join(orders, "order")
        .select("supplier", "customer_id")
        .distinct()
        .join(prop_of(g, "Customer", "name", "customer_id", "customer"), "customer_id")
    )
    return union_all(
        [
            _tagged(named, "supplier", "product", "product"),
            _tagged(buyers, "supplier", "affected_customer", "customer"),
            _measure(priced, "supplier", "affected_orders", F.count(F.lit(1))),
            _measure(priced, "supplier", "at_risk_revenue", F.round(F.sum(F.col("c") * F.col("n")) / 100)),
            _measure(priced, "supplier", "at_risk_revenue_distinct", F.round(F.sum("c") / 100)),
        ]
    )


def supplier_alternatives(g: PropertyGraph, condition: Column) -> DataFrame:
    """Other suppliers, and their products, in each category of the anchored suppliers.

    Rows (supplier, category, kind, item).  Suppliers go by the number of their
    name; a product has another supplier than the anchor unless its smallest and
    its largest number are both the anchor's.
    """
    who = _anchors(g, "Supplier", condition, "dst", "supplier")
    heads, numbers = agg.numbered_suppliers(g)
    about = _part_brand(g).join(prop_of(g, "Part", "name", "part", "product"), "part")
    # the anchor's categories are few where the anchor is, and need none of its parts' names
    categories = _supplied_parts(g, who).join(_part_brand(g), "part").select("supplier", "category").distinct()
    categories = small_side(categories.join(heads, "supplier").withColumnRenamed("head", "own"))
    rows, _ = agg.dealt_edges(g, "SUPPLIED_BY", "src")
    supply = rows.withColumnRenamed("src", "part").join(numbers, "dst").select("part", "head")
    others = (
        supply.join(about.select("part", "category"), "part").select("category", "head").distinct()
        .join(categories, "category").where("head <> own")
        .join(heads.withColumnRenamed("supplier", "item"), "head")
    )
    ends = supply.groupBy("part").agg(F.min("head").alias("low"), F.max("head").alias("high"))
    products = (
        ends.join(about, "part").groupBy("category", "product").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        .join(categories, "category").where("low <> own OR high <> own")
    )
    return union_all(
        [
            others.select("supplier", "category", F.lit("alternative_supplier").alias("kind"), "item"),
            products.select("supplier", "category", F.lit("alternative_product").alias("kind"), F.col("product").alias("item")),
        ]
    ).distinct()


def collaborative(g: PropertyGraph, customer: str, limit: int = 5) -> DataFrame:
    """Products bought by customers who share a product with the target.

    Top products by distinct recommenders, with one row per recommender name.
    """
    target = small_side(_anchors(g, "Customer", F.col("name") == customer, "customer_id", "_n"))
    bought_by = (
        g.edges("CONTAINS").select(F.col("src").alias("order"), F.col("dst").alias("part"))
        .join(g.edges("PLACED").select(F.col("src").alias("customer_id"), F.col("dst").alias("order")), "order")
        .select("customer_id", "part")
        .distinct()
    )
    own = bought_by.join(target.select("customer_id"), "customer_id", "left_semi").select("part").distinct()
    peers = (
        bought_by.join(small_side(own), "part", "left_semi").select("customer_id").distinct()
        .join(target.select("customer_id"), "customer_id", "left_anti")
    )
    picks = (
        bought_by.join(peers, "customer_id", "left_semi")
        .join(small_side(own), "part", "left_anti")
        .join(prop_of(g, "Part", "name", "part", "recommended_product"), "part")
        .select("recommended_product", "customer_id")
        .distinct()
    )
    ranked = picks.groupBy("recommended_product").agg(F.count(F.lit(1)).alias("recommender_count"))
    best = top_k(ranked, limit, F.desc("recommender_count"), F.asc("recommended_product"))
    return (
        picks.join(F.broadcast(best), "recommended_product")  # ``limit`` rows
        .join(prop_of(g, "Customer", "name", "customer_id", "similar_customer"), "customer_id")
        .select("recommended_product", "recommender_count", "similar_customer")
        .distinct()
    )


# ---- intent packs --------------------------------------------------------------

GLOBAL_QUERIES: dict[str, Callable[[PropertyGraph], DataFrame]] = {
    "customer_segments": agg.customer_segments,
    "category_distribution": agg.category_distribution,
    "co_purchase": agg.co_purchase,
    "supplier_dependency": agg.supplier_dependency,
    "review_quality": agg.review_quality,
    "coupon_impact": lambda g: agg.coupon_comparison(g, whole=True),
    "payment_methods": agg.payment_summary,
}

# The queries behind each intent; other intents run all of them.
INTENT_QUERIES = {
    "pattern": "customer_segments category_distribution co_purchase supplier_dependency review_quality".split(),
    "causal": "review_quality coupon_impact category_distribution customer_segments".split(),
    "recommendation": "customer_segments co_purchase review_quality".split(),
    "what_if": "supplier_dependency category_distribution customer_segments".split(),
    "dikw_trace": list(GLOBAL_QUERIES),
}
INTENT_ENTITY_QUERIES = {
    "recommendation": "customer_graph_2hop customer_orders recommendation_collab".split(),
    "what_if": "supplier_impact supplier_alternatives".split(),
    "dikw_trace": "customer_graph_2hop customer_orders customer_reviews".split(),
}


def entity_query(g: PropertyGraph, name: str, entity: str) -> DataFrame:
    here = F.col("name") == entity
    queries: Mapping[str, Callable[[], DataFrame]] = {
        "customer_graph_2hop": lambda: customer_profile(g, here),
        "customer_orders": lambda: customer_orders(g, here),
        "customer_reviews": lambda: customer_reviews(g, here),
        "supplier_impact": lambda: supplier_impact(g, here),
        "supplier_alternatives": lambda: supplier_alternatives(g, here),
        "recommendation_collab": lambda: collaborative(g, entity),
    }
    return queries[name]()


def intent_pack(g: PropertyGraph, intent: str, entity: str | None = None) -> dict[str, DataFrame]:
    """The lazily built queries that answer an intent, by query name."""
    pack = {q: GLOBAL_QUERIES[q](g) for q in INTENT_QUERIES.get(intent, list(GLOBAL_QUERIES))}
    if entity:
        for q in INTENT_ENTITY_QUERIES.get(intent, ["customer_graph_2hop"]):
            pack[q] = entity_query(g, q, entity)
    return pack


# ---- text forms ----------------------------------------------------------------


def record_line(columns: Sequence[str], position: str = "position") -> Column:
    """``  3. a=1, b=x``: the non-null columns of a row after its position."""
    pairs = [
        F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in columns
    ]
    return F.concat(F.lit("  "), F.col(position).cast("string"), F.lit(". "), F.concat_ws(", ", *pairs))


def context_lines(
    title: str, records: DataFrame, order: Sequence[Column], top: int | None = None
) -> DataFrame:
    """Numbered ``k=v`` lines of one section: (section, position, line).

    Position 0 is the heading; a section without records has no rows.  With
    ``top`` the section is bounded and numbered directly, otherwise positions
    are assigned over a range-partitioned sort.
    """
    columns = records.columns
    if top is not None:
        numbered = ranked_top(records, top, order, "position")
    else:
        numbered = number_rows(records, order, "position")
    body = numbered.select(
        F.lit(title).alias("section"), F.col("position").cast("long").alias("position"),
        record_line(columns).alias("line"),
    )
    heading = body.where("position = 1").select(
        "section", F.lit(0).cast("long").alias("position"), F.lit(f"=== {title} ===").alias("line")
    )
    return heading.unionByName(body)


def subgraph_lines(hops: DataFrame) -> DataFrame:
    """``  -REL-> Label(name)`` lines, deduplicated by (hop, label, name, relation).

    ``hops`` is a budgeted, named hop listing: rows per anchor are bounded.
    """
    once = hops.groupBy("anchor", "hop", "label", "name", "rel").agg(F.min("position").alias("position"))
    return once.select(
        "anchor",
        "hop",
        "position",
        F.concat(F.lit("  -"), "rel", F.lit("-> "), "label", F.lit("("), "name", F.lit(")")).alias("line"),
    )


def subgraph_text(hops: DataFrame) -> DataFrame:
    """One text per anchor from its bounded lines."""
    lines = subgraph_lines(hops)
    titles = {1: "[1홉 연결]", 2: "[2홉 연결]", 3: "[3홉 연결]"}
    headed = lines.select("anchor", F.col("hop"), F.col("position"), "line").unionByName(
        lines.select("anchor", "hop").distinct().select(
            "anchor",
            "hop",
            F.lit(0).alias("position"),
            F.coalesce(*[F.when(F.col("hop") == h, F.lit(t)) for h, t in titles.items()]).alias("line"),
        )
    )
    gathered = headed.groupBy("anchor").agg(
        F.sort_array(F.collect_list(F.struct("hop", "position", "line"))).alias("_l")
    )
    return gathered.select(
        "anchor",
        F.concat_ws(
            "\n",
            F.concat(
                F.lit("[앵커 노드] "), F.substring_index("anchor", "_", 1), F.lit(": "),
                F.expr("substring(anchor, instr(anchor, '_') + 1)"),
            ),
            F.array_join(F.transform("_l", lambda s: s["line"]), "\n"),
        ).alias("text"),
    )
