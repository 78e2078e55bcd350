"""Catalogue: sources and sinks, quality, evaluation, evolution, logs."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import functions as F

from loomgraph.functions.exact import cents
from loomgraph.graph import PropertyGraph, build_nodes, union_all
from loomgraph.operators import evaluation as ev
from loomgraph.operators import evolution as evo
from loomgraph.operators import logs, maintenance, quality
from loomgraph.plans import sqlparts as q
from loomgraph.plans.graph_queries import _TENANTS, _tenant_graph
from loomgraph.plans.registry import checked
from loomgraph.session import shared_dir
from loomgraph.sources import csv, synth, text
from loomgraph.sources.binding import SALES_GRAPH, SALES_TABLES
from loomgraph.spec import ColumnSpec, ForeignKey, GraphSpec, NodeSpec, TableSpec

# ---- sources and sinks ---------------------------------------------------------------


def _csv_folder(w, name, frame):
    path = f"{shared_dir(w.spark, 'csv')}/{name}.csv"
    frame.write.option("header", True).option("escape", '"').csv(path)
    return path


@checked(
    "s1_typed_csv_load",
    """SELECT c_custkey, c_name || ' "q", ' || chr(10) || c_mktsegment AS c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal
       FROM customer""",
)
def _s1(w):
    """Names with quotes, commas and line breaks, keys padded with tabs."""
    spec = SALES_TABLES["customer"]
    narrow = replace(spec, columns=tuple(c for c in spec.columns if c.name != "c_mktsegment"))
    rows = w.t("customer").withColumns({
        "c_name": F.concat("c_name", F.lit(' "q", \n'), "c_mktsegment"),
        "c_custkey": F.concat(F.lit("\t"), F.col("c_custkey").cast("string"), F.lit("\t")),
    })
    path = _csv_folder(w, "customer", rows)
    raw, _ = csv.load_csv(w.spark, path, narrow)
    return csv.coerce(raw, narrow)[0]


_DIRTY = TableSpec(
    "order_lines",
    (
        ColumnSpec("order_id", "BIGINT", nullable=False),
        ColumnSpec("quantity", "INT"),
        ColumnSpec("price", "DECIMAL(12,2)", nullable=False),
        ColumnSpec("open", "BOOLEAN"),
        ColumnSpec("location", "POINT"),
    ),
)


def _dirty_lines(w):
    """Order lines as text with faults that follow from their own values."""
    line = w.t("lineitem")
    return line.select(
        F.concat(F.lit(" "), F.col("l_orderkey").cast("string"), F.lit(" ")).alias("order_id"),
        F.when(F.col("l_returnflag") == "R", F.col("l_quantity").cast("string"))  # 7.0 is not an integer
        .when(F.col("l_returnflag") == "A", "NULL").otherwise(F.col("l_quantity").cast("int").cast("string"))
        .alias("quantity"),
        F.when(F.col("l_discount") >= 0.1, "").otherwise(F.col("l_extendedprice").cast("string")).alias("price"),
        F.when(F.col("l_linestatus") == "O", "Yes").when(F.col("l_tax") > 0.07, "maybe").otherwise("f").alias("open"),
        F.lit("(1,2)").alias("location"),
    )


@checked(
    "s2_coercion_with_rejection",
    """WITH l AS (SELECT *, l_returnflag = 'R' AS q_bad, l_discount >= 0.1 AS p_bad,
          l_linestatus <> 'O' AND l_tax > 0.07 AS o_bad FROM lineitem)
       SELECT 'good' AS outcome, '' AS "column", count(*) AS cnt, CAST(count(*) FILTER (l_returnflag = 'A') AS BIGINT)
         AS null_quantity, CAST(sum(l_orderkey) AS BIGINT) AS key_sum FROM l WHERE NOT (q_bad OR p_bad OR o_bad)
       UNION ALL SELECT 'bad', 'quantity', count(*), 0, 0 FROM l WHERE q_bad
       UNION ALL SELECT 'bad', 'price', count(*), 0, 0 FROM l WHERE p_bad
       UNION ALL SELECT 'bad', 'open', count(*), 0, 0 FROM l WHERE o_bad""",
)
def _s2(w):
    good, bad = csv.coerce(_dirty_lines(w), _DIRTY)
    zero = F.lit(0).cast("long")
    return good.agg(
        F.count(F.lit(1)).alias("cnt"), F.count_if(F.col("quantity").isNull()).alias("null_quantity"),
        F.sum("order_id").alias("key_sum"),
    ).select(F.lit("good").alias("outcome"), F.lit("").alias("column"), "cnt", "null_quantity", "key_sum").unionByName(
        bad.groupBy("column").agg(F.count(F.lit(1)).alias("cnt")).select(
            F.lit("bad").alias("outcome"), "column", "cnt", zero.alias("null_quantity"), zero.alias("key_sum")
        )
    )


@checked(
    "s3_load_summary",
    """SELECT 'customer' AS "table", count(*) AS row_count, 'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment' AS columns,
         '' AS warnings FROM customer
       UNION ALL SELECT 'supplier', count(*), 's_suppkey,s_name,s_nationkey,s_acctbal', '' FROM supplier
       UNION ALL SELECT 'part', 0, '', 'No CSV for table ''part''' """,
)
def _s3(w):
    names = ["customer", "supplier"]
    return csv.load_summary(
        {n: w.t(n) for n in names}, [SALES_TABLES[n] for n in (*names, "part")],
        uploads=[f"/in/{n}.csv" for n in names],
    )


@checked(
    "s4_decode_text",
    """SELECT o_orderkey AS id, '주문 #' || o_orderkey AS text,
         CASE o_orderstatus WHEN 'F' THEN 'cp949' WHEN 'O' THEN 'utf-8-sig' ELSE 'utf-8' END AS encoding FROM orders""",
)
def _s4(w):
    tail = F.concat(F.lit(" #"), F.col("o_orderkey").cast("string"))
    utf8 = F.encode(F.concat(F.lit("주문"), tail), "UTF-8")
    status = F.col("o_orderstatus")
    content = (
        F.when(status == "F", F.concat(F.unhex(F.lit("C1D6B9AE")), F.encode(tail, "UTF-8")))  # the word in CP949
        .when(status == "O", F.concat(F.unhex(F.lit("EFBBBF")), utf8))
        .otherwise(utf8)
    )
    return w.t("orders").select(F.col("o_orderkey").alias("id"), text.decode_text(content).alias("d")).select("id", "d.*")


@checked(
    "s5_node_load",
    """SELECT l_orderkey AS id, l_returnflag AS flag, l_quantity AS quantity, 'Line #' || l_orderkey AS name FROM lineitem
       QUALIFY row_number() OVER (PARTITION BY l_orderkey
         ORDER BY l_linenumber DESC, l_extendedprice DESC, l_returnflag DESC, l_quantity DESC) = 1""",
)
def _s5(w):
    spec = NodeSpec(
        "Line", "lineitem", "l_orderkey", {"flag": "l_returnflag", "quantity": "l_quantity"},
        merge_order=("l_linenumber", "l_extendedprice"),
    )
    return build_nodes(spec, w.t("lineitem"))


@checked("s6_edge_load", f"SELECT * FROM {q.CONTAINS_PROPS} e")
def _s6(w):
    return w.graph.edges("CONTAINS")


@checked(
    "s7_display_name_enrichment",
    """SELECT 'Order' AS label, o_orderkey AS id, '주문 #' || o_orderkey || ' (' || o_orderstatus || ')' AS name FROM orders
       UNION ALL SELECT 'Event', event_id, 'Event #' || event_id || ' (' || event_type || ')' FROM events
       UNION ALL SELECT 'Part', p_partkey, p_name FROM part""",
)
def _s7(w):
    g = w.graph
    return union_all([g.nodes(l).select(F.lit(l).alias("label"), "id", "name") for l in ("Order", "Event", "Part")])


def _report_sql() -> str:
    stored = f"""SELECT 'node' AS kind, label AS name, count(*) AS stored FROM {q.NODES} v GROUP BY label
      UNION ALL SELECT 'edge', rel_type, count(*) FROM {q.EDGES} e GROUP BY rel_type"""
    sizes = {
        "region": ["Region"], "nation": ["Nation", "IN_REGION"], "customer": ["Customer", "LIVES_AT"],
        "supplier": ["Supplier", "LOCATED_IN"], "part": ["Part", "Brand", "BELONGS_TO"],
        "orders": ["Order", "Payment", "PLACED", "PAID_BY"], "lineitem": ["CONTAINS", "SUPPLIED_BY"],
        "(SELECT * FROM lineitem WHERE l_discount >= 0.10)": ["Coupon", "USED_COUPON"],
        "events": ["Event", "WROTE", "REVIEWS"], "conversations": ["Turn", "NEXT_TURN"],
    }
    offered = " UNION ALL ".join(
        f"SELECT '{n}' AS name, count(*) AS offered FROM {t} t" for t, names in sizes.items() for n in names
    )
    return f"SELECT kind, name, offered, stored FROM ({stored}) JOIN ({offered}) USING (name)"


@checked("s8_graph_build_counts", _report_sql())
def _s8(w):
    return maintenance.load_report(SALES_GRAPH, w.tables, w.graph)


_MAPPING = {
    "version": "1.0",
    "triples_maps": [
        {"id": "TM_C", "logical_table": {"table_name": "customer"}, "subject_map": {"class": "Customer", "template": "{id}"},
         "properties": [{"name": "id", "column": "c_custkey", "is_key": True}, {"name": "name", "column": "c_name"}]},
        {"id": "TM_N", "logical_table": {"table_name": "nation"},
         "subject_map": {"class": "Nation", "template": "{n_nationkey}"},
         "properties": [{"name": "name", "column": "n_name"}]},
    ],
    "relationship_maps": [
        {"id": "RM", "type": "LIVES_AT", "source_triples_map": "TM_C", "target_triples_map": "TM_N",
         "logical_table": {"table_name": "customer"},
         "join_condition": {"source_column": "c_custkey", "target_column": "c_nationkey"}},
    ],
}


@checked(
    "s9_mapping_build",
    """SELECT 'Customer_' || c_custkey AS src, 'Nation_' || c_nationkey AS dst, 'LIVES_AT' AS rel_type FROM customer""",
)
def _s9(w):
    spec = GraphSpec.from_mapping(json.dumps(_MAPPING))
    return PropertyGraph.build(spec, w.tables).connections()


@checked(
    "s12_graph_reset",
    f"""WITH v AS (SELECT * FROM {_TENANTS} x), e AS (SELECT * FROM {q.EDGES} y WHERE rel_type IN ('PLACED', 'LIVES_AT')),
        gone AS (SELECT id FROM v WHERE tenant_id = 'BUILDING'),
        touched AS (SELECT * FROM e WHERE src IN (SELECT id FROM gone) OR dst IN (SELECT id FROM gone))
        SELECT 'removed' AS what, 'node' AS kind, count(*) AS cnt FROM gone
        UNION ALL SELECT 'removed', 'edge', count(*) FROM touched
        UNION ALL SELECT 'kept', 'node', count(*) FROM v WHERE tenant_id <> 'BUILDING'
        UNION ALL SELECT 'kept', 'edge', (SELECT count(*) FROM e) - (SELECT count(*) FROM touched)""",
)
def _s12(w):
    nodes, edges, removed = maintenance.reset_tenant(*_tenant_graph(w), "BUILDING")
    kept = union_all([nodes.select(F.lit("node").alias("kind")), edges.select(F.lit("edge").alias("kind"))])
    return union_all(
        [
            removed.select(F.lit("removed").alias("what"), "kind", F.col("removed").alias("cnt")),
            kept.groupBy("kind").agg(F.count(F.lit(1)).alias("cnt")).select(F.lit("kept").alias("what"), "kind", "cnt"),
        ]
    )


_SYNTH = [
    SALES_TABLES["customer"], SALES_TABLES["orders"], SALES_TABLES["nation"], SALES_TABLES["region"],
    TableSpec(
        "part", (ColumnSpec("id", "INT", False), ColumnSpec("name"), ColumnSpec("parent_id", "INT")), "id",
        (ForeignKey("parent_id", "part", "id"),),
    ),
]


@checked(
    "s13_synthetic_tables",
    " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", count(*) AS row_count, CAST(0 AS BIGINT) AS broken, "
        f"CAST({nulls} AS BIGINT) AS empty_refs FROM {t}"
        for t, nulls in (("customer", 1), ("orders", 1), ("nation", 1), ("region", 0), ("part", 2))
    ),
)
def _s13(w):
    """Tables of the same sizes as the given ones, with their reference checks."""
    rows = {s.name: w.t(s.name).count() for s in _SYNTH}
    tables = synth.generate(w.spark, _SYNTH, rows)
    broken = quality.fk_violations(tables, _SYNTH).select(
        F.substring_index("column", ".", 1).alias("table"), F.lit("broken").alias("m")
    )
    frames = [broken]
    for s in _SYNTH:
        df = tables[s.name]
        frames.append(df.select(F.lit(s.name).alias("table"), F.lit("row").alias("m")))
        for fk in s.foreign_keys:
            frames.append(df.where(F.col(fk.column).isNull()).select(F.lit(s.name).alias("table"), F.lit("empty").alias("m")))
    return union_all(frames).groupBy("table").agg(
        F.count_if(F.col("m") == "row").alias("row_count"), F.count_if(F.col("m") == "broken").alias("broken"),
        F.count_if(F.col("m") == "empty").alias("empty_refs"),
    )


# ---- quality ------------------------------------------------------------------------------


def _with_wrong_fk():
    """The declared keys plus one that does not hold in the data."""
    orders = SALES_TABLES["orders"]
    wrong = replace(orders, foreign_keys=(*orders.foreign_keys, ForeignKey("o_custkey", "supplier", "s_suppkey")))
    return [SALES_TABLES[t] for t in ("nation", "customer", "supplier", "lineitem")] + [wrong]


@checked(
    "q1_fk_integrity",
    """SELECT 'orders.o_custkey' AS "column", CAST(o_custkey AS VARCHAR) AS value, 'supplier.s_suppkey' AS target,
         count(*) AS child_rows FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY o_custkey""",
)
def _q1(w):
    return quality.fk_violations(w.tables, _with_wrong_fk())


@checked(
    "q2_key_uniqueness",
    """SELECT CAST(l_orderkey AS VARCHAR) AS value, 'duplicate' AS problem, count(*) AS rows FROM lineitem
       GROUP BY l_orderkey HAVING count(*) > 1""",
)
def _q2(w):
    return quality.key_violations(w.t("lineitem"), "l_orderkey")


@checked(
    "q3_dangling_edges",
    """SELECT o_custkey AS src, o_orderkey AS dst, 'source' AS missing FROM orders
         WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)
       UNION ALL SELECT o_custkey, o_orderkey, 'target' FROM orders WHERE o_orderstatus = 'P'""",
)
def _q3(w):
    g = w.graph
    return quality.dangling_edges(
        g.edges("PLACED"), g.nodes("Customer").where("acctbal >= 0"), g.nodes("Order").where("status <> 'P'")
    )


@checked(
    "q4_orphan_nodes",
    f"""WITH e AS (SELECT src, dst FROM {q.EDGES} x WHERE rel_type IN ('WROTE', 'REVIEWS'))
        SELECT id, label, display_name AS name FROM {q.NODES} v WHERE label IN ('Customer', 'Event', 'Part')
          AND id NOT IN (SELECT src FROM e) AND id NOT IN (SELECT dst FROM e)""",
)
def _q4(w):
    g = w.graph
    reviews = g.restrict(["Customer", "Event", "Part"], [k for k in g.edge_keys if k[0] in ("WROTE", "REVIEWS")])
    return quality.orphan_nodes(reviews)


@checked(
    "q5_name_collisions",
    f"""SELECT label, lower(display_name) AS folded_name, count(*) AS nodes FROM {q.NODES} v GROUP BY 1, 2
        HAVING count(*) > 1""",
)
def _q5(w):
    return quality.name_collisions(w.graph.vertices())


@checked(
    "q6_quality_score",
    f"""WITH w AS (SELECT DISTINCT label FROM (SELECT label FROM {q.NODES} v GROUP BY label, lower(display_name)
          HAVING count(*) > 1)),
        e AS (SELECT DISTINCT 1 AS x FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier))
        SELECT (SELECT count(*) FROM e) AS errors, (SELECT count(*) FROM w) AS warnings,
          greatest(0, 100 - 20 * (SELECT count(*) FROM e) - 5 * (SELECT count(*) FROM w)) / 100.0 AS score""",
)
def _q6(w):
    """One error per broken key, one warning per label with colliding names."""
    errors = quality.fk_violations(w.tables, _with_wrong_fk()).select("column").distinct()
    warnings = quality.name_collisions(w.graph.vertices()).select("label").distinct()
    issues = union_all(
        [errors.select(F.lit("error").alias("severity")), warnings.select(F.lit("warning").alias("severity"))]
    )
    return quality.quality_score(issues)


@checked(
    "q7_shape_validation",
    f"""SELECT 'Customer_' || c_custkey AS id, 'acctbal' AS path, 'min 0' AS rule FROM customer WHERE c_acctbal < 0
        UNION ALL SELECT 'Order_' || o_orderkey, 'total_amount', 'below 400000' FROM orders WHERE o_totalprice >= 400000
        UNION ALL SELECT 'Part_' || src, 'SUPPLIED_BY', 'max 1' FROM {q.SUPPLIED} s GROUP BY src HAVING count(*) > 1
        UNION ALL SELECT 'Event_' || event_id, 'REVIEWS', 'class' FROM {q.REVIEW} r
          WHERE part NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)""",
)
def _q7(w):
    g = w.graph
    rows = quality.shape_violations(
        g,
        [
            quality.required("Customer", "segment"),
            quality.datatype("Customer", "acctbal", "double"),
            quality.Shape("Customer", "acctbal", "min 0", F.col("acctbal") >= 0),
            quality.Shape("Order", "total_amount", "below 400000", F.col("total_amount") < 400000),
            quality.required("Order", "status"),
        ],
    )
    large = g.nodes("Part").where("size > 25")
    return union_all(
        [rows, quality.at_most_one(g, "SUPPLIED_BY"), quality.target_class(g.edges("REVIEWS"), "REVIEWS", "Event", large)]
    )


_GEN = """(SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS name, CAST(l_suppkey AS VARCHAR) AS source, l_returnflag AS target,
  CASE WHEN l_tax > 0.06 THEN 'llm_suggested' ELSE 'fk_direct' END AS derivation FROM lineitem WHERE l_linestatus = 'O')"""
_GOLD = """(SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS name, CAST(l_suppkey AS VARCHAR) AS source, l_returnflag AS target
  FROM lineitem WHERE l_linestatus = 'F')"""


@checked(
    "q8_edge_set_evaluation",
    f"""WITH g AS (SELECT DISTINCT name, source, target FROM {_GEN} a), o AS (SELECT * FROM {_GOLD} b),
        gn AS (SELECT DISTINCT source AS name FROM g), gon AS (SELECT DISTINCT source AS name FROM o),
        m AS (SELECT count(*) AS n FROM (SELECT * FROM o INTERSECT SELECT * FROM g)),
        miss AS (SELECT (SELECT count(*) FROM (SELECT * FROM o EXCEPT SELECT * FROM g))
          + (SELECT count(*) FROM (SELECT * FROM gon EXCEPT SELECT * FROM gn)) AS n),
        d AS (SELECT count(*) AS n FROM o WHERE name IN (SELECT name FROM g)),
        c AS (SELECT (SELECT count(*) FROM o) AS o, (SELECT count(*) FROM gon) AS gon, (SELECT count(*) FROM gn) AS gn,
          (SELECT count(*) FROM {_GEN} x) AS gr, (SELECT count(*) FROM {_GEN} y WHERE derivation = 'llm_suggested') AS s)
        SELECT round(CAST(miss.n AS DOUBLE) / (c.o + c.gon), 4) AS critical_error_rate,
          round(CAST(m.n AS DOUBLE) / c.o, 4) AS fk_relationship_coverage,
          round(CAST(m.n AS DOUBLE) / d.n, 4) AS direction_accuracy, round(CAST(c.s AS DOUBLE) / c.gr, 4) AS adoption_rate,
          c.gn AS node_count_generated, c.gon AS node_count_golden, c.gr AS relationship_count_generated,
          c.o AS relationship_count_golden FROM m, miss, d, c""",
)
def _q8(w):
    line = w.t("lineitem").select(
        F.col("l_partkey").cast("string").alias("name"), F.col("l_suppkey").cast("string").alias("source"),
        F.col("l_returnflag").alias("target"),
        F.when(F.col("l_tax") > 0.06, "llm_suggested").otherwise("fk_direct").alias("derivation"), "l_linestatus",
    )
    generated = line.where("l_linestatus = 'O'").drop("l_linestatus").distinct()
    golden = line.where("l_linestatus = 'F'").select("name", "source", "target").distinct()
    labels = [df.select(F.col("source").alias("name")).distinct() for df in (generated, golden)]
    return ev.evaluate_edges(*labels, generated, golden)


_WORDS = "list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{Nd}\\p{Pc}]{12,}'))"
_QA = f"""(SELECT a.conv_id || ':' || a.turn AS qa_id, CASE WHEN a.turn % 2 = 0 THEN 'a' ELSE 'b' END AS mode,
  lower(a.text) AS answer, CASE WHEN len(a.text) % 7 = 0 THEN 'failed' END AS error, len(a.text) AS latency_ms,
  len(a.text) // 4 AS tokens, CASE WHEN a.role = 'system' THEN 'unsupported' ELSE 'traverse' END AS category,
  g.words AS kw, list_filter(g.words, lambda x: len(x) > 15) AS ent
  FROM conversations a JOIN (SELECT conv_id, {_WORDS} AS words FROM conversations WHERE turn = 0) g USING (conv_id))"""
_HITS = "len(list_filter({w}, lambda x: contains(answer, x)))"
_SCORED = f"""(SELECT *, CASE WHEN category = 'unsupported' THEN CAST(refused AS DOUBLE)
    WHEN len(kw) = 0 THEN 0.0 ELSE CAST({_HITS.format(w='kw')} AS DOUBLE) / len(kw) END AS keyword_score,
  CASE WHEN category = 'unsupported' THEN CAST(refused AS DOUBLE)
    WHEN len(ent) = 0 THEN 1.0 ELSE CAST({_HITS.format(w='ent')} AS DOUBLE) / len(ent) END AS entity_score,
  CASE WHEN category = 'unsupported' THEN refused
    ELSE (len(kw) = 0 OR {_HITS.format(w='kw')} > 0) AND error IS NULL END AS success
  FROM (SELECT *, error IS NOT NULL OR contains(answer, '지원') OR contains(answer, '찾을 수 없')
    OR contains(answer, 'unsupported') AS refused FROM {_QA} qa) r)"""


def _scored(w):
    """Every turn as an answer; the long words of the opening turn are expected in it."""
    turn = w.t("conversations")
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{M}\p{Nd}\p{Pc}]{12,})"), 1))
    opening = turn.where("turn = 0").select("conv_id", words.alias("words"))
    size = F.length("text")
    rows = turn.join(opening, "conv_id").withColumn("qa_id", F.concat_ws(":", "conv_id", "turn"))
    answers = rows.select(
        "qa_id", F.when(F.col("turn") % 2 == 0, "a").otherwise("b").alias("mode"), F.col("text").alias("answer"),
        F.when(size % 7 == 0, "failed").alias("error"), size.alias("latency_ms"), F.floor(size / 4).alias("tokens"),
    )
    golden = rows.select(
        "qa_id", F.when(F.col("role") == "system", "unsupported").otherwise("traverse").alias("category"),
        F.col("words").alias("expected_keywords"),
        F.filter("words", lambda x: F.length(x) > 15).alias("expected_entities"),
    )
    return ev.score_answers(answers, golden)


@checked(
    "q9_answer_scoring",
    f"""SELECT qa_id, mode, round(keyword_score, 6) AS keyword_score, round(entity_score, 6) AS entity_score, success
        FROM {_SCORED} s""",
)
def _q9(w):
    return _scored(w).select(
        "qa_id", "mode", F.round("keyword_score", 6).alias("keyword_score"),
        F.round("entity_score", 6).alias("entity_score"), "success",
    )


@checked(
    "q10_mode_comparison",
    f"""WITH t AS (SELECT count(*) FILTER (mode = 'a') AS na, count(*) FILTER (mode = 'b') AS nb,
          count(*) FILTER (mode = 'a' AND success) AS a, count(*) FILTER (mode = 'b' AND success) AS b,
          round(avg(latency_ms) FILTER (mode = 'a'), 1) AS la, round(avg(latency_ms) FILTER (mode = 'b'), 1) AS lb,
          round(avg(keyword_score) FILTER (mode = 'a'), 3) AS ka, round(avg(keyword_score) FILTER (mode = 'b'), 3) AS kb,
          CAST(sum(tokens) FILTER (mode = 'b') AS BIGINT) AS tb FROM {_SCORED} s)
        SELECT greatest(na, nb) AS total_pairs, a AS a_success_count, b AS b_success_count, la AS a_avg_latency_ms,
          lb AS b_avg_latency_ms, ka AS a_avg_keyword_score, kb AS b_avg_keyword_score, tb AS b_total_tokens,
          round(tb * 8.0::DOUBLE / 1000000, 4) AS b_estimated_cost_usd,
          CASE WHEN a > b THEN 'a_only' WHEN b > a THEN 'b_preferred' WHEN kb > ka THEN 'b_preferred'
            WHEN ka > kb THEN 'a_only' ELSE 'hybrid' END AS recommendation FROM t""",
)
def _q10(w):
    row = ev.compare_modes(_scored(w))
    return row.withColumn("a_success_count", F.col("a_success_count").cast("long")).withColumn(
        "b_success_count", F.col("b_success_count").cast("long")
    )


_FK_TABLES = ("customer", "supplier", "orders", "lineitem", "nation", "region")
_FK_COLUMNS = [
    ("customer", "c_custkey"), ("customer", "c_nationkey"), ("lineitem", "l_orderkey"), ("lineitem", "l_partkey"),
    ("lineitem", "l_suppkey"), ("lineitem", "l_linenumber"), ("nation", "n_nationkey"), ("nation", "n_regionkey"),
    ("orders", "o_orderkey"), ("orders", "o_custkey"), ("region", "r_regionkey"), ("supplier", "s_suppkey"),
    ("supplier", "s_nationkey"),
]


def _fk_sql() -> str:
    values = " UNION ALL ".join(
        f"SELECT CAST({c} AS BIGINT) AS v, '{t}.{c}' AS c, count(*) AS n FROM {t} GROUP BY 1" for t, c in _FK_COLUMNS
    )
    return f"""WITH x AS ({values}), p AS (SELECT c, count(*) AS d, max(n) = 1 AS u FROM x GROUP BY c),
      y AS (SELECT a.c AS child, b.c AS parent, count(*) AS k FROM x a JOIN x b ON a.v = b.v
        AND split_part(a.c, '.', 1) <> split_part(b.c, '.', 1) GROUP BY 1, 2)
      SELECT child, parent, pc.d AS child_values, pp.d AS parent_values, round(CAST(k AS DOUBLE) / pc.d, 4) AS ratio
      FROM y JOIN p pc ON pc.c = child JOIN p pp ON pp.c = parent WHERE pp.u AND k >= 0.9 * pc.d"""


@checked("q11_fk_discovery", _fk_sql())
def _q11(w):
    return quality.discover_fks({t: w.t(t) for t in _FK_TABLES}, min_ratio=0.9)


@checked(
    "q12_bridge_profile",
    """WITH p AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2),
       a AS (SELECT count(*) AS k, max(f) AS m FROM (SELECT count(*) AS f FROM p GROUP BY l_partkey)),
       b AS (SELECT count(*) AS k, max(f) AS m FROM (SELECT count(*) AS f FROM p GROUP BY l_suppkey))
       SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS pairs, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows,
         any_value(a.k) AS first_keys, any_value(a.m) AS first_max_fanout, any_value(b.k) AS second_keys,
         any_value(b.m) AS second_max_fanout, CAST(9 AS BIGINT) AS extra_columns FROM p, a, b""",
)
def _q12(w):
    return quality.bridge_profile(w.t("lineitem"), "l_partkey", "l_suppkey")


# ---- evolution ------------------------------------------------------------------------------


def _slice(spec: GraphSpec, labels, rels) -> GraphSpec:
    return GraphSpec(tuple(n for n in spec.nodes if n.label in labels), tuple(e for e in spec.edges if e.name in rels))


_BASE_SPEC = _slice(SALES_GRAPH, ("Customer", "Order", "Nation", "Supplier"), ("PLACED", "LIVES_AT", "LOCATED_IN"))


def _changed_tables(w):
    """A later state of the sources, derived from the given one."""
    tables = dict(w.tables)
    tables["customer"] = (
        w.t("customer").where("c_acctbal >= 0")
        .withColumn("c_mktsegment", F.when(F.col("c_acctbal") > 9000, "VIP").otherwise(F.col("c_mktsegment")))
    )
    tables["orders"] = w.t("orders").where("o_orderpriority <> '1-URGENT'")
    return tables


@checked(
    "e1_snapshot_diff",
    """SELECT 'node' AS kind, 'Customer' AS type, 'removed' AS change, count(*) AS cnt FROM customer WHERE c_acctbal < 0
       UNION ALL SELECT 'node', 'Customer', 'modified', count(*) FROM customer WHERE c_acctbal > 9000
       UNION ALL SELECT 'node', 'Order', 'removed', count(*) FROM orders WHERE o_orderpriority = '1-URGENT'
       UNION ALL SELECT 'edge', 'LIVES_AT', 'removed', count(*) FROM customer WHERE c_acctbal < 0
       UNION ALL SELECT 'edge', 'PLACED', 'removed', count(*) FROM orders WHERE o_orderpriority = '1-URGENT'
         OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""",
)
def _e1(w):
    base = PropertyGraph.build(_BASE_SPEC, w.tables)
    target = PropertyGraph.build(_BASE_SPEC, _changed_tables(w))
    return evo.diff_counts(evo.diff_graphs(base, target))


def _target_spec() -> GraphSpec:
    """Suppliers go, payments come, customers change properties, LIVES_AT turns to a region."""
    full = SALES_GRAPH
    customer = replace(full.node("Customer"), props={"name": "c_name", "segment": "c_mktsegment", "home": "c_nationkey"})
    lives = replace(full.edge("LIVES_AT"), target="Region", target_key="c_nationkey")
    return GraphSpec(
        (customer, full.node("Order"), full.node("Nation"), full.node("Payment"), full.node("Region")),
        (full.edge("PLACED"), lives, full.edge("PAID_BY")),
    )


_E2_ROWS = [
    ("node", "Customer", "", "", "acctbal", "removed", False, False),
    ("node", "Customer", "", "", "home", "added", False, False),
    *[("node", "Supplier", "", "", p, "removed", False, p == "") for p in ("", "id", "name", "acctbal")],
    *[("node", "Payment", "", "", p, "added", False, False) for p in ("", "id", "name", "method", "amount")],
    *[("node", "Region", "", "", p, "added", False, False) for p in ("", "id", "name")],
    ("edge", "LOCATED_IN", "Supplier", "Nation", "", "removed", False, True),
    ("edge", "LIVES_AT", "Customer", "Nation", "", "removed", True, True),
    ("edge", "LIVES_AT", "Customer", "Region", "", "added", True, True),
    ("edge", "PAID_BY", "Order", "Payment", "", "added", False, False),
]


def _types(w):
    base = PropertyGraph.build(_BASE_SPEC, w.tables)
    target = PropertyGraph.build(_target_spec(), w.tables)
    return base, target, evo.diff_types(evo.type_table(base), evo.type_table(target))


@checked(
    "e2_type_diff",
    "SELECT * FROM (VALUES "
    + ", ".join(
        "(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v).lower() for v in row) + ")" for row in _E2_ROWS
    )
    + ") t(kind, name, source, target, property, change, endpoint_changed, breaking)",
)
def _e2(w):
    return _types(w)[2].select("kind", "name", "source", "target", "property", "change", "endpoint_changed", "breaking")


@checked(
    "e2_type_diff_summary",
    "SELECT 'nodes +2, nodes -1, nodes ~1, rels +1, rels -1, rels ~1' AS summary, true AS is_breaking",
)
def _e2b(w):
    return evo.diff_summary(_types(w)[2])


@checked(
    "e3_impact",
    """SELECT 'node' AS kind, 'Customer' AS name, count(*) AS affected, round(count(*) * 1.0::DOUBLE / 1000, 2)
         AS estimated_seconds FROM customer
       UNION ALL SELECT 'node', 'Supplier', count(*), round(count(*) * 1.0::DOUBLE / 1000, 2) FROM supplier
       UNION ALL SELECT 'edge', 'LOCATED_IN', count(*), round(count(*) * 2.0::DOUBLE / 1000, 2) FROM supplier
       UNION ALL SELECT 'edge', 'LIVES_AT', count(*), round(count(*) * 2.0::DOUBLE / 1000, 2) FROM customer""",
)
def _e3(w):
    base, _, diff = _types(w)
    return evo.impact(base, diff)


@checked(
    "e4_migration",
    """SELECT 'nodes_modified' AS step, count(*) AS cnt FROM customer
       UNION ALL SELECT 'nodes_removed', count(*) FROM supplier
       UNION ALL SELECT 'nodes_added', (SELECT count(*) FROM orders) + (SELECT count(*) FROM region)
       UNION ALL SELECT 'relationships_removed', (SELECT count(*) FROM supplier) + (SELECT count(*) FROM customer)
       UNION ALL SELECT 'relationships_added', (SELECT count(*) FROM orders)
         + (SELECT count(*) FROM customer WHERE c_nationkey IN (SELECT r_regionkey FROM region))""",
)
def _e4(w):
    base = PropertyGraph.build(_BASE_SPEC, w.tables)
    migrated, plan = evo.migrate(base, _target_spec(), w.tables)
    return evo.migration_counts(base, migrated, plan)


# ---- logs -----------------------------------------------------------------------------------

K = "CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT)"
LOG = f"""(SELECT event_id AS id, ts AS created_at, 't' || (user_id % 4) AS tenant_id, 'q' || {K} AS question,
  CASE event_type WHEN 'click' THEN 'a' WHEN 'view' THEN 'b' ELSE 'c' END AS mode,
  CASE WHEN event_type <> 'signup' THEN event_type END AS route, {K} < 30 AS cached,
  CAST(round(value * 10) AS BIGINT) AS latency_ms, CASE WHEN event_type = 'error' THEN 'failed' END AS error FROM events)"""


def query_log(events):
    """The event table read as a query log."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").alias("id"), F.col("ts").alias("created_at"),
        F.concat(F.lit("t"), F.col("user_id") % 4).alias("tenant_id"), F.concat(F.lit("q"), k).alias("question"),
        F.when(kind == "click", "a").when(kind == "view", "b").otherwise("c").alias("mode"),
        F.when(kind != "signup", kind).alias("route"), (k < 30).alias("cached"),
        F.round(F.col("value") * 10).cast("long").alias("latency_ms"),
        F.when(kind == "error", "failed").alias("error"),
    )


@checked(
    "l1_query_analytics",
    f"""SELECT tenant_id, count(*) AS total_queries, round(CAST(count(*) FILTER (cached) AS DOUBLE) / count(*), 3)
          AS cache_hit_rate, round(avg(latency_ms), 1) AS avg_latency_ms,
          round(quantile_cont(latency_ms, 0.95), 1) AS p95_latency_ms, count(error) AS error_count,
          round(CAST(count(error) AS DOUBLE) / count(*), 3) AS error_rate FROM {LOG} l GROUP BY tenant_id""",
)
def _l1(w):
    return logs.query_analytics(query_log(w.t("events")))


@checked(
    "l2_counts_by",
    f"""SELECT 'mode' AS col, tenant_id, mode AS value, count(*) AS cnt FROM {LOG} l GROUP BY ALL
        UNION ALL SELECT 'route', tenant_id, route, count(*) FROM {LOG} l WHERE route IS NOT NULL GROUP BY ALL""",
)
def _l2(w):
    log = query_log(w.t("events"))
    return union_all([logs.counts_by(log, c).withColumn("col", F.lit(c)) for c in ("mode", "route")])


@checked(
    "l3_query_history",
    f"""SELECT id, created_at, mode, latency_ms FROM {LOG} l WHERE tenant_id = 't1' ORDER BY created_at DESC, id DESC
        LIMIT 50 OFFSET 100""",
)
def _l3(w):
    return logs.history(query_log(w.t("events")), "t1", 50, 100).select("id", "created_at", "mode", "latency_ms")


_RATES = {"model-large": (2.5, 10.0), "model-small": (0.15, 0.6)}
_USAGE = """(SELECT role AS caller, CASE conv_id % 3 WHEN 0 THEN 'model-large' WHEN 1 THEN 'model-small' ELSE 'other' END
  AS model, len(text) AS i, len(text) // 4 AS o FROM conversations)"""


@checked(
    "l4_token_cost",
    f"""SELECT caller, model, count(*) AS calls, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT)
          AS output_tokens, round(sum((i * CASE model WHEN 'model-large' THEN 2.5::DOUBLE WHEN 'model-small'
            THEN 0.15::DOUBLE ELSE 5.0::DOUBLE END + o * CASE model WHEN 'model-large' THEN 10.0::DOUBLE
            WHEN 'model-small' THEN 0.6::DOUBLE ELSE 15.0::DOUBLE END) / 1000000), 4) AS estimated_cost_usd
        FROM {_USAGE} u GROUP BY GROUPING SETS ((), (caller), (model))""",
)
def _l4(w):
    size = F.length("text").cast("long")
    usage = w.t("conversations").select(
        F.col("role").alias("caller"),
        F.when(F.col("conv_id") % 3 == 0, "model-large").when(F.col("conv_id") % 3 == 1, "model-small")
        .otherwise("other").alias("model"),
        size.alias("input_tokens"), F.floor(size / 4).alias("output_tokens"),
    )
    return logs.token_cost(usage, _RATES)


def _histogram_sql() -> str:
    base = f"""(SELECT CASE WHEN {K} % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, '/api/' || event_type || '/{{id}}' AS path,
      round(value * 10) / 1000 AS seconds FROM events)"""
    parts = [
        f"SELECT method, path, '{le}' AS le, count(*) FILTER (seconds <= {bound}) AS cnt FROM {base} r GROUP BY ALL"
        for le, bound in [(str(b), f"{b}::DOUBLE") for b in logs.LATENCY_BOUNDS] + [("+Inf", "1e9")]
    ]
    return " UNION ALL ".join(parts)


def _requests(w):
    k = F.get_json_object("props", "$.k").try_cast("long")
    return w.t("events").select(
        F.when(k % 2 == 0, "GET").otherwise("POST").alias("method"),
        F.concat(F.lit("/api/"), "event_type", F.lit("/"), k, F.lit("/")).alias("path"),
        (F.round(F.col("value") * 10) / 1000).alias("seconds"),
        F.when(F.col("event_type") == "error", "500").otherwise("200").alias("status"),
    )


@checked("l5_latency_histogram", _histogram_sql())
def _l5(w):
    return logs.latency_histogram(_requests(w))


@checked(
    "l5_requests_by_status",
    f"""SELECT CASE WHEN {K} % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, '/api/' || event_type || '/{{id}}' AS path,
          CASE WHEN event_type = 'error' THEN '500' ELSE '200' END AS status, count(*) AS cnt FROM events GROUP BY ALL""",
)
def _l5b(w):
    return logs.requests_by_status(_requests(w))


@checked(
    "l6_job_counts",
    """WITH j AS (SELECT CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'P' THEN 'pending' ELSE 'completed' END AS status
         FROM orders)
       SELECT status, count(*) AS cnt FROM j GROUP BY 1
       UNION ALL SELECT '(total)', count(*) FROM j
       UNION ALL SELECT '(active)', count(*) FROM j WHERE status IN ('pending', 'running')""",
)
def _l6(w):
    status = F.col("o_orderstatus")
    jobs = w.t("orders").select(
        F.when(status == "O", "running").when(status == "P", "pending").otherwise("completed").alias("status")
    )
    return logs.job_counts(jobs)


@checked(
    "f1_rounding",
    f"""SELECT o_orderpriority AS method, round(CAST({q.sum_cents('o_totalprice')} AS DOUBLE) / 100, 2) AS total_2dp,
          round(CAST({q.sum_cents('o_totalprice')} AS DOUBLE) / 100) AS total_whole FROM orders GROUP BY 1""",
)
def _f1(w):
    text_amount = F.col("amount").cast("string").try_cast("double")
    total = F.sum(cents(text_amount)) / 100
    return w.graph.nodes("Payment").groupBy("method").agg(
        F.round(total, 2).alias("total_2dp"), F.round(total).alias("total_whole")
    )


