"""Catalogue: neighbourhoods, paths, inferred edges, extension surface."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.graph import union_all
from loomgraph.operators import aggregates as agg
from loomgraph.operators import anchored, inference
from loomgraph.operators import patterns as pat
from loomgraph.operators import traversal as tr
from loomgraph.plans import sqlparts as q
from loomgraph.plans.graph_queries import CUSTOMER_A
from loomgraph.plans.registry import PatternRegistry, checked

CENTRE = "Customer_7"
_BOTH = f"(SELECT src AS a, dst AS b, rel_type FROM {q.EDGES} e UNION ALL SELECT dst, src, rel_type FROM {q.EDGES} f)"


def _reached_sql(centre: str, depth: int) -> str:
    return f"""WITH RECURSIVE u AS MATERIALIZED (SELECT DISTINCT a, b FROM {_BOTH} x),
      r(id, d) AS (SELECT '{centre}', 0 UNION SELECT u.b, r.d + 1 FROM r JOIN u ON u.a = r.id WHERE r.d < {depth}),
      n AS (SELECT DISTINCT id FROM r)"""


@checked(
    "j18_neighbourhood",
    f"""{_reached_sql(CENTRE, 2)}
        SELECT 'node' AS kind, id, split_part(id, '_', 1) AS type, CAST(NULL AS VARCHAR) AS target FROM n
        UNION ALL SELECT 'edge', src, rel_type, dst FROM {q.EDGES} e
          WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)""",
)
def _j18(w):
    return tr.neighbourhood(w.graph, CENTRE, 2)


@checked(
    "g2_k_hop_reachability",
    f"{_reached_sql('Supplier_3', 3)} SELECT split_part(id, '_', 1) AS label, count(*) AS cnt FROM n GROUP BY 1",
)
def _g2(w):
    found = tr.neighbourhood_nodes(w.graph, "Supplier_3", 3)
    return found.rows.groupBy("label").agg(F.count(F.lit(1)).alias("cnt"))


@checked(
    "j19_ego_merge",
    f"""WITH u AS (SELECT DISTINCT a, b FROM {_BOTH} x)
        SELECT DISTINCT id FROM (SELECT '{CENTRE}' AS id UNION ALL SELECT b FROM u WHERE a = '{CENTRE}'
          UNION ALL SELECT 'Region_1' UNION ALL SELECT b FROM u WHERE a = 'Region_1')""",
)
def _j19(w):
    view = tr.neighbourhood_nodes(w.graph, CENTRE, 1).rows.select(tr.composite().alias("id"))
    more = tr.neighbourhood_nodes(w.graph, "Region_1", 1).rows.select(tr.composite().alias("id"))
    return tr.merge_view(view, more)


def _hops_sql(depth: int) -> str:
    one = f"SELECT DISTINCT b AS n1, rel_type AS rel FROM b WHERE a = '{CENTRE}'"
    text = f"""WITH b AS MATERIALIZED (SELECT * FROM {_BOTH} x), h1 AS ({one}),
      p2 AS (SELECT DISTINCT h.n1, b.b AS n2, b.rel_type AS rel FROM (SELECT DISTINCT n1 FROM h1) h JOIN b ON b.a = h.n1
        WHERE b.b <> '{CENTRE}'),
      p3 AS (SELECT DISTINCT b.b AS n3, b.rel_type AS rel FROM (SELECT DISTINCT n1, n2 FROM p2) p JOIN b ON b.a = p.n2
        WHERE b.b <> '{CENTRE}' AND b.b <> p.n1),
      h AS (SELECT 1 AS hop, n1 AS id, rel FROM h1 UNION ALL SELECT DISTINCT 2, n2, rel FROM p2"""
    if depth >= 3:
        text += " UNION ALL SELECT 3, n3, rel FROM p3"
    return text + f"), l AS (SELECT '{CENTRE}' AS anchor, hop, id, split_part(id, '_', 1) AS label, rel FROM h)"


@checked("j20_hop_lists", f"{_hops_sql(3)} SELECT * FROM l")
def _j20(w):
    return tr.hop_lists(w.graph, "Customer", F.col("name") == CUSTOMER_A, 3)


@checked(
    "j21_node_budget",
    f"""{_hops_sql(2)} SELECT *, row_number() OVER (ORDER BY hop, id, rel) AS position FROM l
        ORDER BY position LIMIT 50""",
)
def _j21(w):
    return tr.budgeted(tr.hop_lists(w.graph, "Customer", F.col("name") == CUSTOMER_A, 2))


_NAMED = f"""n AS (SELECT x.*, coalesce(v.display_name, x.id) AS name FROM (SELECT *, row_number()
    OVER (ORDER BY hop, id, rel) AS position FROM l ORDER BY position LIMIT 50) x LEFT JOIN {q.NODES} v USING (id)),
  s AS (SELECT anchor, hop, min(position) AS position, '  -' || rel || '-> ' || label || '(' || name || ')' AS line
    FROM n GROUP BY anchor, hop, label, name, rel)"""


@checked(
    "n9_subgraph_text",
    f"""{_hops_sql(2)}, {_NAMED}, t AS (SELECT hop, 0 AS position, '[' || hop || '홉 연결]' AS line FROM s GROUP BY hop
          UNION ALL SELECT hop, position, line FROM s)
        SELECT '{CENTRE}' AS anchor, '[앵커 노드] Customer: 7' || chr(10) || string_agg(line, chr(10) ORDER BY hop, position)
          AS text FROM t""",
)
def _n9(w):
    g = w.graph
    hops = tr.budgeted(tr.hop_lists(g, "Customer", F.col("name") == CUSTOMER_A, 2))
    return anchored.subgraph_text(tr.with_names(g, hops))


# ---- paths ---------------------------------------------------------------------------


def _path_sql(start: str, goal: str, depth: int) -> str:
    return f"""WITH RECURSIVE u AS MATERIALIZED (SELECT DISTINCT a, b FROM {_BOTH} x),
      p(id, path) AS (SELECT '{start}', ['{start}'] UNION ALL SELECT u.b, list_append(p.path, u.b) FROM p
        JOIN u ON u.a = p.id WHERE len(p.path) <= {depth} AND p.id <> '{goal}' AND NOT list_contains(p.path, u.b)),
      s AS (SELECT path FROM p WHERE id = '{goal}' ORDER BY len(path), path LIMIT 1)"""


@checked(
    "g1_shortest_path",
    f"{_path_sql(CENTRE, 'Supplier_3', 3)} SELECT array_to_string(path, ' -> ') AS path, len(path) - 1 AS hops FROM s",
)
def _g1(w):
    found = tr.shortest_path(
        w.graph, "Customer", F.col("name") == CUSTOMER_A, "Supplier", F.col("name") == "Supplier#000000003", 10
    )
    return found.select(F.array_join("path", " -> ").alias("path"), "hops")


@checked(
    "g1_path_names",
    f"""{_path_sql(CENTRE, 'Brand_Brand#2', 4)}, x AS (SELECT unnest(path) AS id, unnest(range(len(path))) AS step FROM s)
        SELECT CAST(step AS INT) AS step, v.label || '(' || v.display_name || ')' AS node FROM x JOIN {q.NODES} v USING (id)""",
)
def _g1b(w):
    found = tr.shortest_path(
        w.graph, "Customer", F.col("name") == CUSTOMER_A, "Brand", F.col("name") == "Brand#2", 10
    )
    return tr.path_names(w.graph, found)


_DEG = f"""(SELECT id FROM (SELECT src AS id FROM {q.EDGES} a UNION ALL SELECT dst FROM {q.EDGES} b)
  GROUP BY id ORDER BY count(*) DESC, id LIMIT 1)"""


@checked(
    "g3_ego_network",
    f"""WITH c AS {_DEG}, e AS (SELECT * FROM {q.EDGES} x WHERE src IN (SELECT id FROM c) OR dst IN (SELECT id FROM c))
        SELECT 'node' AS kind, id, CAST(NULL AS VARCHAR) AS type, CAST(NULL AS VARCHAR) AS target
          FROM (SELECT src AS id FROM e UNION SELECT dst FROM e UNION SELECT id FROM c)
        UNION ALL SELECT 'edge', src, rel_type, dst FROM e""",
)
def _g3(w):
    return tr.hub_ego(w.graph)


# ---- inference ------------------------------------------------------------------------


@checked(
    "g4_transitive_closure",
    f"""WITH e AS (SELECT src, dst FROM {q.NEXT_TURN} n), e2 AS (SELECT a.src, b.dst FROM e a JOIN e b ON a.dst = b.src),
        e3 AS (SELECT a.src, b.dst FROM e2 a JOIN e b ON a.dst = b.src),
        e4 AS (SELECT a.src, b.dst FROM e3 a JOIN e b ON a.dst = b.src),
        e5 AS (SELECT a.src, b.dst FROM e4 a JOIN e b ON a.dst = b.src)
        SELECT DISTINCT src, dst, true AS inferred, 'owl_transitive' AS derivation FROM (SELECT * FROM e2
          UNION ALL SELECT * FROM e3 UNION ALL SELECT * FROM e4 UNION ALL SELECT * FROM e5) WHERE src <> dst""",
)
def _g4(w):
    g = inference.infer_closure(w.graph, inference.ClosureRule("NEXT_TURN"))
    return g.edges("NEXT_TURN_CLOSURE")


_CHAIN = inference.ChainRule("CUSTOMER_CATEGORY", ("PLACED", "CONTAINS", "BELONGS_TO"))


@checked(
    "g5_property_chain",
    """SELECT DISTINCT o_custkey AS src, p_brand AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey
       JOIN part ON p_partkey = l_partkey""",
)
def _g5(w):
    return inference.infer_chain(w.graph, _CHAIN).edges("CUSTOMER_CATEGORY").select("src", "dst")


@checked("g6_inverse_edges", "SELECT o_orderkey AS src, o_custkey AS dst FROM orders")
def _g6(w):
    g = inference.infer_inverse(w.graph, inference.InverseRule("PLACED", "PLACED_BY"))
    return g.edges("PLACED_BY").select("src", "dst")


_RULES = [
    inference.ClosureRule("NEXT_TURN"),
    inference.InverseRule("PLACED", "PLACED_BY"),
    inference.ChainRule("CUSTOMER_REGION", ("LIVES_AT", "IN_REGION")),
]
_CLOSURE_N = f"""SELECT count(*) FROM (SELECT a.id AS s, b.id AS t FROM {q.TURN} a JOIN {q.TURN} b
  ON a.conv_id = b.conv_id AND b.turn - a.turn BETWEEN 2 AND 5)"""


@checked(
    "g7_remove_inferred",
    f"""SELECT 'NEXT_TURN_CLOSURE' AS rel_type, ({_CLOSURE_N}) AS deleted
        UNION ALL SELECT 'PLACED_BY', count(*) FROM orders UNION ALL SELECT 'CUSTOMER_REGION', count(*) FROM customer""",
)
def _g7(w):
    return inference.drop_inferred(inference.apply_rules(w.graph, _RULES))[1]


@checked(
    "g8_closure_expansion",
    f"""SELECT a.id AS src, 'NEXT_TURN_CLOSURE' AS rel, 'Turn' AS label, 'Turn #' || b.id AS name,
          row_number() OVER (PARTITION BY a.id ORDER BY b.id) AS rank FROM {q.TURN} a JOIN {q.TURN} b
          ON a.conv_id = b.conv_id AND b.turn - a.turn BETWEEN 2 AND 5 WHERE a.role = 'user'
          QUALIFY rank <= 3""",
)
def _g8(w):
    g = inference.infer_closure(w.graph, inference.ClosureRule("NEXT_TURN"))
    anchors = g.nodes("Turn").where("role = 'user'").select(F.col("id").alias("src"))
    return inference.closure_context(g, "Turn", anchors, 3).select("src", "rel", "label", "name", "rank")


_REFER = "(SELECT c_custkey AS src, CAST((CAST(floor(c_acctbal) AS BIGINT) % 40 + 40) % 40 AS BIGINT) AS dst FROM customer "
_REFER += "UNION ALL SELECT c_custkey, c_nationkey FROM customer)"


@checked(
    "g9_cycle_check",
    f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {_REFER} r WHERE src <> dst),
        x(src, here, hops) AS (SELECT src, dst, 1 FROM e UNION SELECT x.src, e.dst, x.hops + 1 FROM x
          JOIN e ON e.src = x.here WHERE x.hops < 5)
        SELECT src, CAST(min(hops) AS BIGINT) AS hops FROM x WHERE src = here AND hops >= 2 GROUP BY src""",
)
def _g9(w):
    """Customers pointing at low customer keys, by balance and by nation."""
    customer = w.t("customer")
    by_balance = F.pmod(F.floor("c_acctbal"), F.lit(40)).cast("long")
    refer = union_all(
        [customer.select(F.col("c_custkey").alias("src"), d.alias("dst")) for d in (by_balance, F.col("c_nationkey").cast("long"))]
    )
    return inference.cyclic_nodes(refer, 5)


# ---- extension surface -------------------------------------------------------------------


@checked(
    "y1_registered_pattern",
    """SELECT DISTINCT r_name AS result FROM customer JOIN nation ON n_nationkey = c_nationkey
       JOIN region ON r_regionkey = n_regionkey WHERE c_mktsegment = 'MACHINERY'""",
)
def _y1(w):
    registry = PatternRegistry()
    registry.register(
        "regions_of_segment",
        lambda g, segment: pat.reach(
            g, "Customer", F.col("segment") == segment, [pat.out("LIVES_AT"), pat.out("IN_REGION")], "name"
        ),
    )
    return registry.run(w.graph, "regions_of_segment", segment="MACHINERY")


@checked(
    "y2_registered_rules",
    f"""SELECT 'NEXT_TURN_CLOSURE' AS name, ({_CLOSURE_N}) AS cnt
        UNION ALL SELECT 'PLACED_BY', count(*) FROM orders UNION ALL SELECT 'CUSTOMER_REGION', count(*) FROM customer""",
)
def _y2(w):
    g = inference.apply_rules(w.graph, _RULES)
    inferred = g.restrict(g.labels, inference.inferred_keys(g))
    return agg.graph_stats(inferred).where("kind = 'edge' AND name <> '(total)'").select("name", "cnt")


