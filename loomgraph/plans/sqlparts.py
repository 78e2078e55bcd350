"""SQL fragments shared by the equivalent statements of the catalogue."""

CONTAINS = "(SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem)"
CONTAINS_PROPS = """(SELECT l_orderkey AS src, l_partkey AS dst, l_linestatus AS status, l_quantity AS quantity,
  l_extendedprice AS price FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey
    ORDER BY l_linenumber DESC, l_extendedprice DESC, l_linestatus DESC, l_quantity DESC) = 1)"""
SUPPLIED = "(SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem)"
COUPON = """(SELECT DISTINCT l_orderkey AS src, 'DISC' || CAST(CAST(round(l_discount * 100) AS BIGINT) AS VARCHAR) AS dst
  FROM lineitem WHERE l_discount >= 0.10)"""
REVIEW = """(SELECT event_id, user_id, value AS rating, event_type, ts,
  CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS part FROM events)"""
TURN = """(SELECT conv_id, turn, role, text, conv_id || ':' || turn AS id, conv_id || ':' || (turn + 1) AS next_id
  FROM conversations)"""
NEXT_TURN = f"(SELECT a.id AS src, b.id AS dst FROM {TURN} a JOIN {TURN} b ON a.next_id = b.id)"


def cents(expr: str) -> str:
    return f"CAST(round(({expr}) * 100) AS BIGINT)"


def sum_cents(expr: str) -> str:
    return f"CAST(sum({cents(expr)}) AS BIGINT)"


def avg_2dp(expr: str) -> str:
    return f"(round(CAST(sum({cents(expr)}) AS DOUBLE) / count({expr})) / 100.0)"


def avg_whole(expr: str) -> str:
    return f"round(CAST(sum({cents(expr)}) AS DOUBLE) / (count({expr}) * 100))"


NODES = f"""(
  SELECT 'Region_' || r_regionkey AS id, 'Region' AS label, r_name AS display_name FROM region
  UNION ALL SELECT 'Nation_' || n_nationkey, 'Nation', n_name FROM nation
  UNION ALL SELECT 'Customer_' || c_custkey, 'Customer', c_name FROM customer
  UNION ALL SELECT 'Supplier_' || s_suppkey, 'Supplier', s_name FROM supplier
  UNION ALL SELECT 'Part_' || p_partkey, 'Part', p_name FROM part
  UNION ALL SELECT DISTINCT 'Brand_' || p_brand, 'Brand', p_brand FROM part
  UNION ALL SELECT 'Order_' || o_orderkey, 'Order', '주문 #' || o_orderkey || ' (' || o_orderstatus || ')' FROM orders
  UNION ALL SELECT 'Payment_' || o_orderkey, 'Payment', '결제 #' || o_orderkey || ' (' || o_orderpriority || ')'
    FROM orders
  UNION ALL SELECT DISTINCT 'Coupon_' || dst, 'Coupon', dst FROM {COUPON} u
  UNION ALL SELECT 'Event_' || event_id, 'Event', 'Event #' || event_id || ' (' || event_type || ')' FROM events
  UNION ALL SELECT 'Turn_' || id, 'Turn', 'Turn #' || id FROM {TURN} t
)"""

EDGES = f"""(
  SELECT 'Nation_' || n_nationkey AS src, 'Region_' || n_regionkey AS dst, 'IN_REGION' AS rel_type FROM nation
  UNION ALL SELECT 'Customer_' || c_custkey, 'Nation_' || c_nationkey, 'LIVES_AT' FROM customer
  UNION ALL SELECT 'Supplier_' || s_suppkey, 'Nation_' || s_nationkey, 'LOCATED_IN' FROM supplier
  UNION ALL SELECT 'Customer_' || o_custkey, 'Order_' || o_orderkey, 'PLACED' FROM orders
  UNION ALL SELECT 'Order_' || src, 'Part_' || dst, 'CONTAINS' FROM {CONTAINS} c
  UNION ALL SELECT 'Part_' || p_partkey, 'Brand_' || p_brand, 'BELONGS_TO' FROM part
  UNION ALL SELECT 'Part_' || src, 'Supplier_' || dst, 'SUPPLIED_BY' FROM {SUPPLIED} s
  UNION ALL SELECT 'Order_' || o_orderkey, 'Payment_' || o_orderkey, 'PAID_BY' FROM orders
  UNION ALL SELECT 'Order_' || src, 'Coupon_' || dst, 'USED_COUPON' FROM {COUPON} u
  UNION ALL SELECT 'Customer_' || user_id, 'Event_' || event_id, 'WROTE' FROM events
  UNION ALL SELECT 'Event_' || event_id, 'Part_' || part, 'REVIEWS' FROM {REVIEW} r
  UNION ALL SELECT 'Turn_' || src, 'Turn_' || dst, 'NEXT_TURN' FROM {NEXT_TURN} n
)"""
