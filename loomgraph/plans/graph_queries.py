"""Catalogue: pattern queries, aggregates, anchored analyses, ranking, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.graph import node_id, union_all
from loomgraph.operators import aggregates as agg
from loomgraph.operators import anchored, ranking, setops
from loomgraph.operators import patterns as pat
from loomgraph.operators import traversal as tr
from loomgraph.operators.patterns import back, out
from loomgraph.plans import sqlparts as q
from loomgraph.plans.registry import checked

CUSTOMER_A = "Customer#000000007"
CUSTOMER_B = "Customer#000000100"
SUPPLIER_A = "Supplier#000000003"
SUPPLIER_B = "Supplier#000000005"
BRAND_A, BRAND_B = "Brand#2", "Brand#17"


# ---- lookups and filters ---------------------------------------------------------


@checked(
    "p1_property_lookup", f"SELECT c_acctbal AS result FROM customer WHERE c_name = '{CUSTOMER_A}'"
)
def _p1(w):
    return pat.property_lookup(w.graph, "Customer", "name", CUSTOMER_A, "acctbal")


_P2 = [("=", "status", "F"), ("<>", "status", "F"), (">", "total_amount", 250000.0), ("<", "total_amount", 250000.0),
       (">=", "total_amount", 250000.0), ("<=", "total_amount", 250000.0), ("CONTAINS", "name", "#12"),
       ("STARTS WITH", "name", "주문 #1"), ("ENDS WITH", "name", "(O)")]


@checked(
    "p2_whitelisted_comparison",
    " UNION ALL ".join(
        f"SELECT '{op}' AS op, count(*) AS cnt FROM (SELECT o_orderstatus AS status, o_totalprice AS total_amount, "
        f"'주문 #' || o_orderkey || ' (' || o_orderstatus || ')' AS name FROM orders) WHERE "
        + {
            "CONTAINS": f"contains({c}, '{v}')",
            "STARTS WITH": f"starts_with({c}, '{v}')",
            "ENDS WITH": f"ends_with({c}, '{v}')",
        }.get(op, f"{c} {op} {v!r}")
        for op, c, v in _P2
    ),
)
def _p2(w):
    orders = w.graph.nodes("Order")
    # one scan for all operators
    hits = F.array(*[F.when(pat.compare(c, op, v), F.lit(op)) for op, c, v in _P2])
    return (
        orders.select(F.explode(F.array_compact(hits)).alias("op")).groupBy("op").agg(F.count(F.lit(1)).alias("cnt"))
    )


@checked("p3_set_membership", f"SELECT p_name AS result FROM part WHERE p_brand IN ('{BRAND_A}', '{BRAND_B}')")
def _p3(w):
    parts = w.graph.nodes("Part")
    brand = w.graph.edges("BELONGS_TO").where(F.col("dst").isin(BRAND_A, BRAND_B)).select(F.col("src").alias("id"))
    return parts.join(brand, "id", "left_semi").select(F.col("name").alias("result"))


@checked("p4_substring_filter", "SELECT p_name AS result FROM part WHERE contains(p_name, 'ring')")
def _p4(w):
    return w.graph.nodes("Part").where(pat.compare("name", "CONTAINS", "ring")).select(F.col("name").alias("result"))


@checked(
    "p5_node_text_search",
    f"""SELECT id, label, display_name FROM {q.NODES} v WHERE contains(lower(display_name), 'urgent')
        OR contains(lower(id), 'urgent') OR contains(lower(label), 'urgent')""",
)
def _p5(w):
    return pat.text_search(w.graph, "URGent")


@checked(
    "p6_filter_graph",
    f"""SELECT 'node' AS kind, label AS type, count(*) AS cnt FROM {q.NODES} v
        WHERE label IN ('Customer', 'Order', 'Part') GROUP BY label
        UNION ALL SELECT 'edge', rel_type, count(*) FROM {q.EDGES} e
        WHERE rel_type IN ('PLACED', 'CONTAINS', 'SUPPLIED_BY') AND split_part(src, '_', 1) IN ('Customer','Order','Part')
          AND split_part(dst, '_', 1) IN ('Customer', 'Order', 'Part') GROUP BY rel_type""",
)
def _p6(w):
    sub = pat.filter_graph(w.graph, ["Customer", "Order", "Part"], ["PLACED", "CONTAINS", "SUPPLIED_BY"])
    return agg.graph_stats(sub).where(F.col("name") != "(total)").select("kind", F.col("name").alias("type"), "cnt")


_TENANTS = """(SELECT 'Customer_' || c_custkey AS id, c_mktsegment AS tenant_id FROM customer
  UNION ALL SELECT 'Order_' || o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT 'Nation_' || n_nationkey, '_default_' FROM nation)"""


def _tenant_graph(w):
    """Customers and orders owned by the market segment; nations by the default tenant."""
    g = w.graph
    who = g.nodes("Customer").select("id", F.col("segment").alias("tenant_id"))
    customers = who.select(node_id("Customer", F.col("id")).alias("id"), "tenant_id")
    orders = g.edges("PLACED").join(who.withColumnRenamed("id", "src"), "src").select(
        node_id("Order", F.col("dst")).alias("id"), "tenant_id"
    )
    nations = g.nodes("Nation").select(
        node_id("Nation", F.col("id")).alias("id"), F.lit("_default_").alias("tenant_id")
    )
    keys = [k for k in g.edge_keys if k[0] in ("PLACED", "LIVES_AT")]
    return union_all([customers, orders, nations]), g.connections(keys=keys)


@checked(
    "p7_tenant_filter",
    f"""WITH v AS (SELECT * FROM {_TENANTS} x WHERE tenant_id = 'BUILDING')
        SELECT 'node' AS kind, count(*) AS cnt FROM v
        UNION ALL SELECT 'edge', count(*) FROM {q.EDGES} e WHERE rel_type IN ('PLACED', 'LIVES_AT')
          AND src IN (SELECT id FROM v) AND dst IN (SELECT id FROM v)""",
)
def _p7(w):
    nodes, edges = pat.for_tenant(*_tenant_graph(w), "BUILDING")
    rows = nodes.select(F.lit("node").alias("kind")).unionByName(edges.select(F.lit("edge").alias("kind")))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("cnt"))


@checked("p8_display_name", f"SELECT id, label, display_name FROM {q.NODES} v")
def _p8(w):
    return w.graph.vertices()


@checked(
    "p9_id_resolution",
    "SELECT DISTINCT 'Part_' || p_partkey AS id FROM part WHERE p_name IN (SELECT p_name FROM part WHERE p_size > 45)",
)
def _p9(w):
    values = w.graph.nodes("Part").where("size > 45").select(F.col("name").alias("value"))
    return pat.resolve_ids(w.graph, "Part", "name", values)


# ---- traversals -------------------------------------------------------------------


@checked(
    "j1_one_hop_out",
    f"SELECT DISTINCT n_name AS result FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_name = '{CUSTOMER_A}'",
)
def _j1(w):
    return pat.reach(w.graph, "Customer", F.col("name") == CUSTOMER_A, [out("LIVES_AT")], "name")


@checked(
    "j2_one_hop_in",
    f"""SELECT DISTINCT p_name AS result FROM {q.SUPPLIED} e JOIN supplier ON dst = s_suppkey
        JOIN part ON src = p_partkey WHERE s_name = '{SUPPLIER_A}'""",
)
def _j2(w):
    return pat.reach(w.graph, "Supplier", F.col("name") == SUPPLIER_A, [back("SUPPLIED_BY")], "name")


@checked(
    "j3_two_hop",
    f"""SELECT DISTINCT p_name AS result FROM customer JOIN orders ON o_custkey = c_custkey
        JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE c_name = '{CUSTOMER_A}'""",
)
def _j3(w):
    return pat.reach(w.graph, "Customer", F.col("name") == CUSTOMER_A, [out("PLACED"), out("CONTAINS")], "name")


@checked(
    "j4_three_hop",
    f"""SELECT DISTINCT p_brand AS result FROM customer JOIN orders ON o_custkey = c_custkey
        JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE c_name = '{CUSTOMER_A}'""",
)
def _j4(w):
    hops = [out("PLACED"), out("CONTAINS"), out("BELONGS_TO")]
    return pat.reach(w.graph, "Customer", F.col("name") == CUSTOMER_A, hops, "name")


@checked(
    "j5_reverse_two_hop",
    """SELECT DISTINCT c_name AS result FROM part JOIN lineitem ON l_partkey = p_partkey
       JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE p_name = 'small ring'""",
)
def _j5(w):
    return pat.reach(w.graph, "Part", F.col("name") == "small ring", [back("CONTAINS"), back("PLACED")], "name")


@checked(
    "j6_filtered_traversal",
    """SELECT DISTINCT n_name AS result FROM customer JOIN nation ON c_nationkey = n_nationkey
       WHERE c_mktsegment = 'BUILDING'""",
)
def _j6(w):
    return pat.reach(w.graph, "Customer", F.col("segment") == "BUILDING", [out("LIVES_AT")], "name")


@checked(
    "j7_status_filter",
    """SELECT DISTINCT p_name AS result FROM orders JOIN lineitem ON l_orderkey = o_orderkey
       JOIN part ON p_partkey = l_partkey WHERE o_totalprice >= 499000""",
)
def _j7(w):
    return pat.reach(w.graph, "Order", pat.compare("total_amount", ">=", 499000.0), [out("CONTAINS")], "name")


_BOUGHT = "SELECT l_partkey FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey"


@checked(
    "j8_common_neighbor",
    f"""SELECT DISTINCT s_name AS result FROM supplier WHERE s_suppkey IN (
          SELECT dst FROM {q.SUPPLIED} e JOIN part ON p_partkey = src WHERE p_name = 'small ring')
        AND s_suppkey IN (SELECT dst FROM {q.SUPPLIED} e JOIN part ON p_partkey = src WHERE p_name = 'red widget')""",
)
def _j8(w):
    return pat.common_neighbor(w.graph, "Part", "name", "small ring", "red widget", [out("SUPPLIED_BY")], "name")


@checked(
    "j9_common_purchases",
    f"""SELECT DISTINCT p_name AS product FROM part WHERE p_partkey IN ({_BOUGHT} WHERE c_mktsegment = 'BUILDING')
        AND p_partkey IN ({_BOUGHT} WHERE c_name = '{CUSTOMER_B}')""",
)
def _j9(w):
    g, hops = w.graph, [out("PLACED"), out("CONTAINS")]
    first = pat.walk(g, pat.anchor_ids(g, "Customer", F.col("segment") == "BUILDING"), hops)
    second = pat.walk(g, pat.anchor_ids(g, "Customer", F.col("name") == CUSTOMER_B), hops)
    both = first.join(second, "at", "left_semi").withColumnRenamed("at", "id")
    return g.nodes("Part").join(both, "id", "left_semi").select(F.col("name").alias("product")).distinct()


@checked(
    "j10_optional_match",
    f"""SELECT o_orderkey AS id, o_totalprice AS total_amount, o_orderkey IN (SELECT src FROM {q.COUPON} c) AS matched
        FROM orders""",
)
def _j10(w):
    return pat.optional_match(w.graph, "Order", "USED_COUPON", ["total_amount"])


@checked(
    "j11_anti_pattern",
    f"""SELECT p_partkey AS id, p_name AS name FROM part
        WHERE p_partkey NOT IN ({_BOUGHT} WHERE c_mktsegment = 'BUILDING')""",
)
def _j11(w):
    g = w.graph
    bought = pat.walk(
        g, pat.anchor_ids(g, "Customer", F.col("segment") == "BUILDING"), [out("PLACED"), out("CONTAINS")]
    )
    return pat.without_edge(g.nodes("Part").select("id", "name"), "id", bought)


_PAIRS = f"""SELECT p1.p_name AS product_1, p2.p_name AS product_2, count(*) AS co_purchase_count
  FROM {q.CONTAINS} a JOIN {q.CONTAINS} b ON a.src = b.src AND a.dst < b.dst
  JOIN part p1 ON p1.p_partkey = a.dst JOIN part p2 ON p2.p_partkey = b.dst GROUP BY ALL"""


@checked("j12_pair_self_join", _PAIRS)
def _j12(w):
    return agg.pair_support(w.graph)


@checked(
    "j13_order_shipping",
    f"""SELECT e.src AS order_id, e.status AS result FROM {q.CONTAINS_PROPS} e JOIN orders ON o_orderkey = e.src
        JOIN customer ON c_custkey = o_custkey WHERE c_name = '{CUSTOMER_A}'""",
)
def _j13(w):
    return pat.edge_property_of_anchor(
        w.graph, "Customer", F.col("name") == CUSTOMER_A, out("PLACED"), "CONTAINS", "status"
    )


@checked(
    "j14_order_payment",
    f"""SELECT o_orderkey AS order_id, o_orderpriority AS result FROM orders JOIN customer ON c_custkey = o_custkey
        WHERE c_name = '{CUSTOMER_A}'""",
)
def _j14(w):
    return pat.orders_with_payment(w.graph, CUSTOMER_A)


@checked(
    "j15_coupon_orders",
    f"""SELECT o_orderkey AS order_id, o_totalprice AS amount FROM orders
        WHERE o_orderkey IN (SELECT src FROM {q.COUPON} c WHERE dst = 'DISC10')""",
)
def _j15(w):
    return pat.orders_by_coupon(w.graph, "DISC10")


@checked(
    "j16_city_customers",
    "SELECT c_name AS result FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE contains(n_name, 'NATION_1')",
)
def _j16(w):
    return pat.nodes_at(w.graph, "Customer", "LIVES_AT", "name", "NATION_1", "name")


@checked(
    "j17_full_graph_sample",
    f"""WITH v AS (SELECT * FROM {q.NODES} x), e AS (SELECT * FROM {q.EDGES} y),
        p AS (SELECT id, label FROM v ORDER BY id LIMIT 500)
        SELECT 'node' AS kind, id, label AS type, CAST(NULL AS VARCHAR) AS target, CAST(NULL AS BIGINT) AS value FROM p
        UNION ALL SELECT 'edge', src, rel_type, dst, NULL FROM e
          WHERE src IN (SELECT id FROM p) AND dst IN (SELECT id FROM p)
        UNION ALL SELECT 'total_nodes', NULL, NULL, NULL, count(*) FROM v
        UNION ALL SELECT 'total_edges', NULL, NULL, NULL, count(*) FROM e
        UNION ALL SELECT 'truncated', NULL, NULL, NULL, CAST(count(*) > 500 AS BIGINT) FROM v""",
)
def _j17(w):
    return tr.full_sample(w.graph, 500)


# ---- aggregates ---------------------------------------------------------------------

_CAT_ORDERS = f"""SELECT p_brand AS category, count(DISTINCT src) AS order_count FROM {q.CONTAINS} e
  JOIN part ON p_partkey = dst"""


@checked(
    "a1_top_n",
    f"""SELECT p_name AS category, count(*) AS cnt FROM {q.CONTAINS} e JOIN part ON p_partkey = dst GROUP BY p_name
        ORDER BY cnt DESC, category LIMIT 10""",
)
def _a1(w):
    return agg.top_by_neighbors(w.graph, "CONTAINS", "name", 10)


@checked("a2_agg_with_rel", f"{_CAT_ORDERS} GROUP BY p_brand ORDER BY order_count DESC, category LIMIT 3")
def a2(w):
    return agg.top_far_values(w.graph, "CONTAINS", "BELONGS_TO", "name", 3)


@checked("a3_count_all", "SELECT count(*) AS total FROM customer")
def _a3(w):
    return agg.count_nodes(w.graph, "Customer")


@checked(
    "a4_group_count",
    "SELECT c_name AS category, count(*) AS cnt FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_name",
)
def _a4(w):
    return agg.edges_per_source(w.graph, "PLACED", "name")


@checked(
    "a5_max_property",
    """(SELECT 'max' AS which, p_name AS name, p_retailprice AS value FROM part
        ORDER BY p_retailprice DESC NULLS LAST, p_name, p_partkey LIMIT 1)
       UNION ALL (SELECT 'min', p_name, p_retailprice FROM part
        ORDER BY p_retailprice ASC NULLS LAST, p_name, p_partkey LIMIT 1)""",
)
def _a5(w):
    top = agg.extreme(w.graph, "Part", "name", "price")
    low = agg.extreme(w.graph, "Part", "name", "price", largest=False)
    return top.withColumn("which", F.lit("max")).unionByName(low.withColumn("which", F.lit("min")))


@checked("a6_average_property", f"SELECT {q.avg_2dp('o_totalprice')} AS average FROM orders")
def _a6(w):
    return agg.average(w.graph, "Order", "total_amount")


_RATED = f"""SELECT p_name AS product, {q.avg_2dp('rating')} AS avg_rating, count(*) AS review_count
  FROM {q.REVIEW} r JOIN part ON p_partkey = part GROUP BY p_name"""


@checked(
    "a7_review_top_n",
    f"SELECT product, avg_rating FROM ({_RATED}) ORDER BY avg_rating DESC, product LIMIT 5",
)
def _a7(w):
    return agg.top_rated(w.graph, 5)


@checked(
    "a8_shipping_stats", f"SELECT status AS group_key, count(*) AS cnt FROM {q.CONTAINS_PROPS} e GROUP BY status"
)
def _a8(w):
    return agg.edge_property_counts(w.graph, "CONTAINS", "status")


@checked("a9_payment_stats", "SELECT o_orderpriority AS group_key, count(*) AS cnt FROM orders GROUP BY 1")
def _a9(w):
    return agg.node_property_counts(w.graph, "Payment", "method")


@checked("a10_category_compare", f"{_CAT_ORDERS} WHERE p_brand IN ('{BRAND_A}', '{BRAND_B}') GROUP BY p_brand")
def _a10(w):
    keep = F.col("category").isin(BRAND_A, BRAND_B)
    return agg.sources_per_far_value(w.graph, "CONTAINS", "BELONGS_TO", "name", keep=keep)


@checked(
    "a11_supplier_compare",
    f"""WITH r AS (SELECT s_name AS supplier, p_name AS product, count(*) AS copies FROM {q.SUPPLIED} e
          JOIN supplier ON s_suppkey = dst JOIN part ON p_partkey = src
          WHERE s_name IN ('{SUPPLIER_A}', '{SUPPLIER_B}') GROUP BY ALL)
        SELECT supplier, product, copies, CAST(sum(copies) OVER (PARTITION BY supplier) AS BIGINT) AS product_count
        FROM r""",
)
def _a11(w):
    return agg.supplier_products(w.graph, [SUPPLIER_A, SUPPLIER_B])


@checked(
    "a12_same_category_top_rated",
    f"""SELECT p_name AS product, p_brand AS category, {q.avg_2dp('rating')} AS avg_rating
        FROM part JOIN {q.REVIEW} r ON part = p_partkey
        WHERE p_brand IN (SELECT p_brand FROM part WHERE p_partkey IN ({_BOUGHT} WHERE c_name = '{CUSTOMER_A}'))
        GROUP BY ALL ORDER BY avg_rating DESC, product, category LIMIT 3""",
)
def _a12(w):
    return agg.same_category_top_rated(w.graph, CUSTOMER_A, 3)


_COUPON_STATUS = f"""(SELECT CASE WHEN o_orderkey IN (SELECT src FROM {q.COUPON} c) THEN 'used' ELSE 'unused' END
  AS coupon_status, o_totalprice FROM orders)"""


@checked(
    "a13_coupon_comparison",
    f"""SELECT coupon_status, count(*) AS order_count, {q.avg_2dp('o_totalprice')} AS avg_amount
        FROM {_COUPON_STATUS} s GROUP BY 1""",
)
def _a13(w):
    return agg.coupon_comparison(w.graph)


@checked("a14_category_order_count", f"{_CAT_ORDERS} GROUP BY p_brand")
def _a14(w):
    return agg.sources_per_far_value(w.graph, "CONTAINS", "BELONGS_TO", "name")


@checked(
    "a15_customer_order_count",
    "SELECT c_name AS customer, count(*) AS order_count FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1",
)
def _a15(w):
    return agg.edges_per_source(w.graph, "PLACED", "name").select(
        F.col("category").alias("customer"), F.col("cnt").alias("order_count")
    )


@checked(
    "a16_average_order_amount",
    f"SELECT {q.avg_whole('o_totalprice')} AS avg_amount, count(*) AS total_orders FROM orders",
)
def _a16(w):
    return agg.order_amount(w.graph)


@checked("a17_product_review_avg", _RATED)
def _a17(w):
    return agg.product_ratings(w.graph)


@checked(
    "a18_payment_summary",
    f"""SELECT o_orderpriority AS method, count(*) AS count, {q.avg_whole('o_totalprice')} AS avg_amount
        FROM orders GROUP BY 1""",
)
def _a18(w):
    return agg.payment_summary(w.graph)


@checked(
    "a19_endpoint_summary",
    f"""SELECT split_part(src, '_', 1) AS source_type, split_part(dst, '_', 1) AS target_type, count(*) AS count
        FROM {q.EDGES} e WHERE rel_type = 'CONTAINS' GROUP BY 1, 2""",
)
def _a19(w):
    return agg.endpoint_summary(w.graph, "CONTAINS")


@checked(
    "a20_customer_segments",
    f"""WITH s AS (SELECT c_name AS customer, count(*) AS orders, {q.sum_cents('o_totalprice')} AS c FROM customer
          JOIN orders ON o_custkey = c_custkey GROUP BY 1)
        SELECT customer, orders, round(c / 100) AS total_spent,
          CASE WHEN c > 3000000 * 100.0 THEN 'VIP' WHEN c > 2000000 * 100.0 THEN 'Regular' ELSE 'Light' END AS segment
        FROM s""",
)
def _a20(w):
    return agg.customer_segments(w.graph, vip=3_000_000, regular=2_000_000)


_CAT_DIST = f"""SELECT p_brand AS category, count(DISTINCT src) AS order_count, count(DISTINCT dst) AS product_count
  FROM {q.CONTAINS} e JOIN part ON p_partkey = dst GROUP BY p_brand"""


@checked("a21_category_distribution", _CAT_DIST)
def _a21(w):
    return agg.category_distribution(w.graph)


@checked(
    "a22_co_purchase", f"{_PAIRS} ORDER BY co_purchase_count DESC, product_1, product_2 LIMIT 10"
)
def _a22(w):
    return agg.co_purchase(w.graph)


@checked(
    "a23_supplier_dependency",
    f"""WITH f AS (SELECT s_name AS supplier, p.src AS part, c.src AS ord, {q.cents('o_totalprice')} AS c
          FROM {q.SUPPLIED} p JOIN supplier ON s_suppkey = p.dst JOIN {q.CONTAINS} c ON c.dst = p.src
          JOIN orders ON o_orderkey = c.src),
        d AS (SELECT supplier, round(CAST(sum(c) AS DOUBLE) / 100) AS revenue_distinct
          FROM (SELECT DISTINCT supplier, ord, c FROM f) GROUP BY 1)
        SELECT supplier, count(DISTINCT part) AS products, count(DISTINCT ord) AS orders,
          round(CAST(sum(c) AS DOUBLE) / 100) AS revenue, any_value(revenue_distinct) AS revenue_distinct
        FROM f JOIN d USING (supplier) GROUP BY supplier""",
)
def _a23(w):
    return agg.supplier_dependency(w.graph)


@checked(
    "a24_review_quality",
    f"""WITH o AS (SELECT dst AS part, count(*) AS o_n FROM {q.CONTAINS} c GROUP BY 1),
        r AS (SELECT part, sum({q.cents('rating')}) AS s, count(*) AS n FROM {q.REVIEW} x GROUP BY 1),
        m AS (SELECT p_name AS product, round(CAST(sum(s * o_n) AS DOUBLE) / sum(n * o_n)) / 100.0 AS avg_rating
          FROM o JOIN r USING (part) JOIN part ON p_partkey = part GROUP BY 1),
        k AS (SELECT p_name AS product, count(DISTINCT c.src) AS order_count FROM {q.CONTAINS} c
          JOIN part ON p_partkey = c.dst WHERE c.dst IN (SELECT part FROM r) GROUP BY 1)
        SELECT product, avg_rating, order_count FROM m JOIN k USING (product)""",
)
def _a24(w):
    return agg.review_quality(w.graph)


_STATS = f"""SELECT 'node' AS kind, label AS name, count(*) AS cnt FROM {q.NODES} v GROUP BY label
  UNION ALL SELECT 'edge', rel_type, count(*) FROM {q.EDGES} e GROUP BY rel_type"""


@checked(
    "a25_graph_stats",
    f"""WITH s AS ({_STATS}) SELECT kind, name, cnt FROM s
        UNION ALL SELECT kind, '(total)', CAST(sum(cnt) AS BIGINT) FROM s GROUP BY kind""",
)
def _a25(w):
    return agg.graph_stats(w.graph)


@checked(
    "a26_stats_dashboard",
    f"""WITH s AS ({_STATS}),
        t AS (SELECT 'top_' || kind AS metric, name, CAST(cnt AS DOUBLE) AS value FROM s
          QUALIFY row_number() OVER (PARTITION BY kind ORDER BY cnt DESC, name) <= 10)
        SELECT * FROM t
        UNION ALL SELECT 'label_count', '', CAST(count(*) AS DOUBLE) FROM s WHERE kind = 'node'
        UNION ALL SELECT 'edge_type_count', '', CAST(count(*) AS DOUBLE) FROM s WHERE kind = 'edge'
        UNION ALL SELECT 'density', '', round(CAST(sum(CASE WHEN kind = 'edge' THEN cnt END) AS DOUBLE)
          / sum(CASE WHEN kind = 'node' THEN cnt END), 2) FROM s""",
)
def _a26(w):
    return agg.stats_dashboard(w.graph)


def _schema_sql() -> str:
    nodes = {
        "Region": ("region", ["r_regionkey", "r_name"], ["id", "name"]),
        "Nation": ("nation", ["n_nationkey", "n_name"], ["id", "name"]),
        "Customer": ("customer", ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"], ["id", "name", "acctbal", "segment"]),
        "Supplier": ("supplier", ["s_suppkey", "s_name", "s_acctbal"], ["id", "name", "acctbal"]),
        "Part": ("part", ["p_partkey", "p_name", "p_type", "p_size", "p_retailprice"], ["id", "name", "type", "size", "price"]),
        "Brand": ("(SELECT DISTINCT p_brand FROM part)", ["p_brand", "p_brand"], ["id", "name"]),
        "Order": ("orders", ["o_orderkey", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"],
                  ["id", "name", "status", "total_amount", "ordered_at"]),
        "Payment": ("orders", ["o_orderkey", "o_orderkey", "o_orderpriority", "o_totalprice"], ["id", "name", "method", "amount"]),
        "Coupon": (f"(SELECT DISTINCT dst FROM {q.COUPON} u)", ["dst", "dst"], ["id", "name"]),
        "Event": ("events", ["event_id", "event_id", "value", "event_type"], ["id", "name", "rating", "type"]),
        "Turn": ("conversations", ["conv_id", "conv_id", "role"], ["id", "name", "role"]),
    }
    parts = [
        f"SELECT 'node' AS kind, '{label}' AS name, '{p}' AS property, count({c}) AS present FROM {t} t"
        for label, (t, cols, props) in nodes.items()
        for c, p in zip(cols, props)
    ] + [
        f"SELECT 'edge', 'CONTAINS', '{p}', count({p}) FROM {q.CONTAINS_PROPS} e" for p in ("status", "quantity", "price")
    ]
    return " UNION ALL ".join(parts)


@checked("a27_live_schema", _schema_sql())
def _a27(w):
    return agg.live_schema(w.graph)


_DEGREE = f"""SELECT id, count(*) AS degree FROM (SELECT src AS id FROM {q.EDGES} a UNION ALL SELECT dst FROM {q.EDGES} b)
  GROUP BY id"""


@checked("a28_degree_hub", f"{_DEGREE} ORDER BY degree DESC, id LIMIT 1")
def _a28(w):
    return agg.hub(w.graph)


@checked(
    "a28_degrees",
    f"""SELECT v.id, coalesce(d.degree, 0) AS degree FROM {q.NODES} v LEFT JOIN ({_DEGREE}) d ON d.id = v.id""",
)
def _a28b(w):
    return agg.degrees(w.graph)


# ---- anchored analyses -----------------------------------------------------------------


@checked(
    "n1_customer_orders",
    f"""SELECT c_name AS customer, o_orderkey AS order_id, round({q.cents('o_totalprice')} / 100) AS amount,
        p_name AS product, p_brand AS category FROM customer JOIN orders ON o_custkey = c_custkey
        JOIN {q.CONTAINS} e ON e.src = o_orderkey JOIN part ON p_partkey = e.dst""",
)
def _n1(w):
    return anchored.customer_orders(w.graph, F.lit(True))


@checked(
    "n2_customer_reviews",
    f"""SELECT c_name AS customer, p_name AS product, rating, event_type AS comment FROM {q.REVIEW} r
        JOIN customer ON c_custkey = user_id JOIN part ON p_partkey = part""",
)
def _n2(w):
    return anchored.customer_reviews(w.graph, F.lit(True))


@checked(
    "n3_customer_profile",
    f"""WITH o AS (SELECT c_name AS customer, o_orderkey AS ord, e.dst AS part, {q.cents('o_totalprice')} AS c
          FROM customer JOIN orders ON o_custkey = c_custkey JOIN {q.CONTAINS} e ON e.src = o_orderkey
          WHERE c_name = '{CUSTOMER_A}'),
        f AS (SELECT o.*, s.dst AS supp FROM o LEFT JOIN {q.SUPPLIED} s ON s.src = o.part)
        SELECT DISTINCT customer, 'product' AS kind, p_name AS item, CAST(NULL AS DOUBLE) AS value FROM o
          JOIN part ON p_partkey = part
        UNION ALL SELECT DISTINCT customer, 'supplier', s_name, NULL FROM f JOIN supplier ON s_suppkey = supp
        UNION ALL SELECT DISTINCT customer, 'category', p_brand, NULL FROM o JOIN part ON p_partkey = part
        UNION ALL SELECT customer, 'order_count', NULL, CAST(count(DISTINCT ord) AS DOUBLE) FROM o GROUP BY 1
        UNION ALL SELECT customer, 'total_spent', NULL, CAST(sum(c) AS DOUBLE) / 100 FROM f GROUP BY 1
        UNION ALL SELECT customer, 'total_spent_distinct', NULL, CAST(sum(c) AS DOUBLE) / 100
          FROM (SELECT DISTINCT customer, ord, c FROM o) GROUP BY 1""",
)
def _n3(w):
    return anchored.customer_profile(w.graph, F.col("name") == CUSTOMER_A)


@checked(
    "n4_supplier_impact",
    f"""WITH f AS (SELECT s_name AS supplier, p.src AS part, c.src AS ord, o_custkey, {q.cents('o_totalprice')} AS c
          FROM {q.SUPPLIED} p JOIN supplier ON s_suppkey = p.dst JOIN {q.CONTAINS} c ON c.dst = p.src
          JOIN orders ON o_orderkey = c.src WHERE s_name = '{SUPPLIER_A}')
        SELECT DISTINCT supplier, 'product' AS kind, p_name AS item, CAST(NULL AS DOUBLE) AS value FROM f
          JOIN part ON p_partkey = part
        UNION ALL SELECT DISTINCT supplier, 'affected_customer', c_name, NULL FROM f JOIN customer ON c_custkey = o_custkey
        UNION ALL SELECT supplier, 'affected_orders', NULL, CAST(count(DISTINCT ord) AS DOUBLE) FROM f GROUP BY 1
        UNION ALL SELECT supplier, 'at_risk_revenue', NULL, round(CAST(sum(c) AS DOUBLE) / 100) FROM f GROUP BY 1
        UNION ALL SELECT supplier, 'at_risk_revenue_distinct', NULL, round(CAST(sum(c) AS DOUBLE) / 100)
          FROM (SELECT DISTINCT supplier, ord, c FROM f) GROUP BY 1""",
)
def _n4(w):
    return anchored.supplier_impact(w.graph, F.col("name") == SUPPLIER_A)


_ALTERNATIVES = f"""WITH c AS (SELECT DISTINCT p_brand FROM {q.SUPPLIED} e JOIN supplier ON s_suppkey = dst
    JOIN part ON p_partkey = src WHERE s_name = '{SUPPLIER_A}'),
  x AS (SELECT p_brand AS category, s_name, p_name FROM {q.SUPPLIED} e JOIN supplier ON s_suppkey = dst
    JOIN part ON p_partkey = src WHERE s_name <> '{SUPPLIER_A}' AND p_brand IN (SELECT p_brand FROM c))
  SELECT DISTINCT '{SUPPLIER_A}' AS supplier, category, 'alternative_supplier' AS kind, s_name AS item FROM x
  UNION ALL SELECT DISTINCT '{SUPPLIER_A}', category, 'alternative_product', p_name FROM x"""


@checked("n5_supplier_alternatives", _ALTERNATIVES)
def _n5(w):
    return anchored.supplier_alternatives(w.graph, F.col("name") == SUPPLIER_A)


@checked(
    "n6_recommendation",
    f"""WITH b AS (SELECT DISTINCT o_custkey AS cust, l_partkey AS part FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
        t AS (SELECT c_custkey FROM customer WHERE c_name = '{CUSTOMER_A}'),
        own AS (SELECT DISTINCT part FROM b WHERE cust IN (SELECT * FROM t)),
        peers AS (SELECT DISTINCT cust FROM b WHERE part IN (SELECT part FROM own) AND cust NOT IN (SELECT * FROM t)),
        picks AS (SELECT DISTINCT p_name, cust FROM b JOIN part ON p_partkey = part
          WHERE cust IN (SELECT cust FROM peers) AND part NOT IN (SELECT part FROM own)),
        best AS (SELECT p_name, count(*) AS n FROM picks GROUP BY 1 ORDER BY n DESC, p_name LIMIT 5)
        SELECT DISTINCT p_name AS recommended_product, n AS recommender_count, c_name AS similar_customer
        FROM picks JOIN best USING (p_name) JOIN customer ON c_custkey = cust""",
)
def _n6(w):
    return anchored.collaborative(w.graph, CUSTOMER_A)


@checked(
    "n7_intent_pack",
    f"""WITH s AS (SELECT c_name AS customer, {q.sum_cents('o_totalprice')} AS c FROM customer
          JOIN orders ON o_custkey = c_custkey GROUP BY 1)
        SELECT 'customer_segments' AS query, customer AS item FROM s
        UNION ALL SELECT 'category_distribution', category FROM ({_CAT_DIST})
        UNION ALL SELECT DISTINCT 'supplier_dependency', s_name FROM {q.SUPPLIED} p
          JOIN supplier ON s_suppkey = dst
        UNION ALL SELECT DISTINCT 'supplier_impact', p_name FROM {q.SUPPLIED} p JOIN supplier ON s_suppkey = dst
          JOIN part ON p_partkey = src WHERE s_name = '{SUPPLIER_A}'
        UNION ALL SELECT 'supplier_alternatives', item FROM ({_ALTERNATIVES})""",
)
def _n7(w):
    pack = anchored.intent_pack(w.graph, "what_if", SUPPLIER_A)
    key = {"customer_segments": "customer", "category_distribution": "category", "supplier_dependency": "supplier"}
    frames = [pack[k].select(F.lit(k).alias("query"), F.col(c).alias("item")) for k, c in key.items()]
    impact = pack["supplier_impact"].where("kind = 'product'")
    others = pack["supplier_alternatives"]
    return union_all(
        [*frames, *(df.select(F.lit(k).alias("query"), "item") for k, df in (("supplier_impact", impact), ("supplier_alternatives", others)))]
    )


@checked(
    "n8_context_lines",
    f"""WITH d AS ({_CAT_DIST}),
        n AS (SELECT *, row_number() OVER (ORDER BY order_count DESC, category) AS position FROM d)
        SELECT '카테고리별 주문 분포' AS section, position, '  ' || position || '. category=' || category
          || ', order_count=' || order_count || ', product_count=' || product_count AS line FROM n
        UNION ALL SELECT '카테고리별 주문 분포', 0, '=== 카테고리별 주문 분포 ==='""",
)
def _n8(w):
    rows = agg.category_distribution(w.graph).select("category", "order_count", "product_count")
    return anchored.context_lines("카테고리별 주문 분포", rows, [F.desc("order_count"), F.asc("category")])


@checked(
    "n10_evidence_paths",
    f"""SELECT 'Order(*) -> CONTAINS -> Part(*) -> BELONGS_TO -> Brand(' || category || ') [count=' || order_count || ']'
        AS path FROM ({_CAT_ORDERS} GROUP BY p_brand) x""",
)
def _n10(w):
    rows = agg.sources_per_far_value(w.graph, "CONTAINS", "BELONGS_TO", "name")
    return pat.evidence_paths(
        rows,
        ["Order(*) -> CONTAINS -> Part(*) -> BELONGS_TO -> Brand(", F.col("category"), ") [count=",
         F.col("order_count"), "]"],
    )


# ---- ranking --------------------------------------------------------------------------


@checked(
    "w1_global_top_k",
    "SELECT o_orderkey AS id, o_totalprice AS total_amount FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
)
def _w1(w):
    orders = w.graph.nodes("Order").select("id", "total_amount")
    return ranking.top_k(orders, 20, F.desc("total_amount"), F.asc("id"))


@checked(
    "w3_offset_page",
    "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 50 OFFSET 100",
)
def _w3(w):
    return ranking.page(w.t("events").select("event_id", "ts"), 50, 100, F.desc("ts"), F.asc("event_id"))


@checked(
    "w5_rank_numbering",
    f"""SELECT row_number() OVER (ORDER BY order_count DESC, category) AS rank, category, order_count
        FROM ({_CAT_ORDERS} GROUP BY p_brand) x ORDER BY rank LIMIT 5""",
)
def _w5(w):
    rows = agg.sources_per_far_value(w.graph, "CONTAINS", "BELONGS_TO", "name")
    top = ranking.ranked_top(rows, 5, [F.desc("order_count"), F.asc("category")])
    return top.withColumn("rank", F.col("rank").cast("long"))


@checked(
    "w6_keep_newest_finished",
    """SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderstatus NOT IN ('F')
       UNION ALL (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'
         ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200)""",
)
def _w6(w):
    kept = ranking.keep_newest_finished(w.graph.nodes("Order"), 200, ["F"], "status", "ordered_at", "id")
    return kept.select("id", "status")


@checked(
    "w7_latest_version",
    """SELECT o_custkey AS tenant, max(o_orderkey) AS version FROM orders WHERE o_orderstatus = 'F' GROUP BY 1""",
)
def _w7(w):
    versions = w.t("orders").select(
        F.col("o_custkey").alias("tenant"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("status")
    )
    return ranking.latest_where(versions, ["tenant"], "version", F.col("status") == "F").select("tenant", "version")


# ---- set operations ---------------------------------------------------------------------

_GOLDEN = "(SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R')"
_GENERATED = "(SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag <> 'R')"


def _edge_sets(w):
    rows = w.t("lineitem")
    pick = ["l_partkey", "l_suppkey"]
    return rows.where("l_returnflag = 'R'").select(*pick), rows.where("l_returnflag <> 'R'").select(*pick)


@checked("u1_union_typed", f"SELECT src, dst, rel_type FROM {q.EDGES} e")
def _u1(w):
    return w.graph.connections()


@checked("u2_difference", f"SELECT * FROM {_GOLDEN} EXCEPT SELECT * FROM {_GENERATED}")
def _u2(w):
    return setops.minus(*_edge_sets(w), ["l_partkey", "l_suppkey"])


@checked("u3_intersection", f"SELECT * FROM {_GOLDEN} INTERSECT SELECT * FROM {_GENERATED}")
def _u3(w):
    return setops.matched(*_edge_sets(w), ["l_partkey", "l_suppkey"])


@checked("u4_distinct", "SELECT DISTINCT p_name, p_brand FROM part")
def _u4(w):
    return setops.distinct(w.t("part"), ["p_name", "p_brand"])
