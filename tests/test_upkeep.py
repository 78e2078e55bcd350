import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from loomgraph import ColumnSpec, EdgeSpec, ForeignKey, GraphSpec, NodeSpec, PropertyGraph, TableSpec
from loomgraph.operators import evaluation, evolution, logs, maintenance, quality, ranking
from loomgraph.session import shared_dir
from loomgraph.sources import csv, synth
from loomgraph.spec import sql_kind
from loomgraph.streaming import ingest, ratelimit, windows
from tests.shop import SPEC, graph, rows_of, tables


def test_sql_kinds_use_the_base_name():
    assert [sql_kind(t) for t in ("BIGINT", "DECIMAL(12,2)", "POINT", "INTERVAL", "varchar(9)", "bool")] == [
        "integer", "float", "string", "string", "string", "boolean"
    ]


def test_csv_rules(spark, tmp_path):
    path = tmp_path / "people.csv"
    path.write_text("id,age,member,extra\n1, 30 ,Yes,x\n2,NULL,f,x\nx,1,no,x\n,5,true,x\n4,3.5,maybe,x\n")
    spec = TableSpec(
        "people",
        (ColumnSpec("id", "INT", False), ColumnSpec("age", "INT"), ColumnSpec("member", "BOOL"), ColumnSpec("absent")),
        "id",
    )
    raw, warnings = csv.load_csv(spark, str(path), spec)
    assert len(warnings) == 1 and "extra" in warnings[0]
    good, bad = csv.coerce(raw, spec)
    assert rows_of(good, "id", "age", "member") == [(1, 30, True), (2, None, False)]
    assert rows_of(bad, "column", "message") == [
        ("age", "cannot convert '3.5' to integer"),
        ("id", "cannot convert 'x' to integer"),
        ("id", "empty value for non-nullable column"),
        ("member", "cannot convert 'maybe' to boolean"),
    ]
    with pytest.raises(ValueError):
        csv.load_summary({"people": good}, [spec], uploads=["a/people.csv", "b/People.csv"])


def test_injected_faults(spark):
    data = tables(spark)
    specs = [
        TableSpec("orders", (), "id", (ForeignKey("customer_id", "customers", "id"),)),
        TableSpec("items", (), None, (ForeignKey("product_id", "products", "id"),)),
    ]
    assert rows_of(quality.fk_violations(data, specs), "column", "value", "child_rows") == [
        ("items.product_id", "999", 1), ("orders.customer_id", "9", 1)
    ]
    keys = spark.createDataFrame([(1,), (1,), (None,)], "k long")
    assert rows_of(quality.key_violations(keys, "k"), "value", "problem", "rows") == [("1", "duplicate", 2), (None, "null", 1)]
    edges = spark.createDataFrame([(1, 5), (2, 6)], "src long, dst long")
    ids = lambda *xs: spark.createDataFrame([(x,) for x in xs], "id long")
    assert rows_of(quality.dangling_edges(edges, ids(1), ids(6)), "src", "missing") == [(1, "target"), (2, "source")]
    orphans = {r["id"] for r in quality.orphan_nodes(graph(spark)).collect()}
    assert "Customer_4" in orphans and "Customer_1" not in orphans
    issues = spark.createDataFrame([("error",), ("warning",), ("warning",)], "severity string")
    assert quality.quality_score(issues).first()["score"] == 0.7
    many = spark.createDataFrame([("error",)] * 9, "severity string")
    assert quality.quality_score(many).first()["score"] == 0.0


def test_merge_is_idempotent(spark):
    rows = tables(spark)["items"].where("order_id IS NOT NULL")
    folder = shared_dir(spark, "upsert")
    for _ in range(2):
        ingest.upsert(rows, folder, ["order_id", "product_id"], ["line"], buckets=4)
    stored = spark.read.parquet(folder)
    assert rows_of(stored.where("order_id = 10 AND product_id = 100"), "line", "quantity") == [(3, 5)]
    assert stored.count() == 7


def test_chunk_store_replaces_documents(spark):
    folder = shared_dir(spark, "chunks")
    make = lambda *rows: spark.createDataFrame(list(rows), "tenant_id string, doc_id long, chunk_index int, text string")
    maintenance.write_chunks(make(("a", 1, 0, "x"), ("a", 1, 1, "y"), ("a", 2, 0, "z"), ("b", 1, 0, "q")), folder, buckets=2)
    maintenance.write_chunks(make(("a", 1, 0, "new")), folder, buckets=2)
    assert rows_of(spark.read.parquet(folder), "tenant_id", "doc_id", "text") == [
        ("a", 1, "new"), ("a", 2, "z"), ("b", 1, "q")
    ]


def test_generated_tables_are_consistent_and_repeatable(spark):
    specs = [
        TableSpec("child", (ColumnSpec("id", "INT", False), ColumnSpec("p", "INT", False)), "id", (ForeignKey("p", "parent", "id"),)),
        TableSpec("parent", (ColumnSpec("id", "INT", False), ColumnSpec("up", "INT")), "id", (ForeignKey("up", "parent", "id"),)),
    ]
    one = synth.generate(spark, specs, {"child": 300, "parent": 20}, seed=1)
    two = synth.generate(spark, specs, {"child": 300, "parent": 20}, seed=1)
    assert quality.fk_violations(one, specs).count() == 0
    assert one["child"].exceptAll(two["child"]).isEmpty()
    assert one["parent"].where("up >= id").count() == 0 and one["parent"].where("up IS NULL").count() == 2


def _spec(props, *rels):
    nodes = (NodeSpec("Customer", "customers", "id", props), NodeSpec("Order", "orders", "id", {"status": "status"}))
    return GraphSpec(nodes, rels)


PLACED = EdgeSpec("PLACED", "Customer", "Order", "orders", "customer_id", "id")


def test_diff_and_summary(spark):
    data = tables(spark)
    base = PropertyGraph.build(_spec({"name": "name"}, PLACED), data)
    same = evolution.diff_types(evolution.type_table(base), evolution.type_table(base))
    assert evolution.diff_summary(same).first().asDict() == {"summary": "No changes", "is_breaking": False}
    moved = PropertyGraph.build(
        _spec({"name": "name"}, replace(PLACED, target="Customer", target_key="customer_id")), data
    )
    diff = evolution.diff_types(evolution.type_table(base), evolution.type_table(moved))
    assert evolution.diff_summary(diff).first().asDict() == {"summary": "rels ~1", "is_breaking": True}
    fewer = GraphSpec(base.spec.nodes[:1], ())
    diff = evolution.diff_types(evolution.type_table(base), evolution.type_table(PropertyGraph.build(fewer, data)))
    assert evolution.diff_summary(diff).first()["summary"] == "nodes -1, rels -1"
    assert rows_of(evolution.impact(base, diff), "name", "affected", "estimated_seconds") == [
        ("Order", 5, 0.01), ("PLACED", 4, 0.01)
    ]


def test_snapshot_diff(spark):
    data = tables(spark)
    later = dict(data)
    later["customers"] = data["customers"].where("id <> 3").withColumn(
        "name", F.when(F.col("id") == 2, "Bob").otherwise(F.col("name"))
    )
    spec = _spec({"name": "name"}, PLACED)
    changes = evolution.diff_graphs(PropertyGraph.build(spec, data), PropertyGraph.build(spec, later))
    assert rows_of(changes, "kind", "type", "id", "change") == [
        ("edge", "PLACED", "3", "removed"), ("node", "Customer", "2", "modified"), ("node", "Customer", "3", "removed")
    ]


def test_migration_backfills(spark):
    data = tables(spark)
    base = PropertyGraph.build(_spec({}, PLACED), data)
    target = _spec({"name": "name"}, PLACED)
    untouched, plan = evolution.migrate(base, target, data, dry_run=True)
    assert untouched is base and plan["nodes_modified"] == ["Customer"]
    migrated, _ = evolution.migrate(base, target, data)
    assert ("Ann",) in rows_of(migrated.nodes("Customer"), "name")
    assert evolution.migrate(migrated, target, data)[0] is migrated


def _change(spec, **changed):
    """The spec with node or edge types replaced by name."""
    nodes = tuple(replace(n, **changed.get(n.label, {})) for n in spec.nodes)
    return GraphSpec(nodes, tuple(replace(e, **changed.get(e.name, {})) for e in spec.edges))


def test_migration_finds_every_kind_of_change(spark):
    data = tables(spark)
    spec = _spec({"name": "name"}, PLACED)
    base = PropertyGraph.build(spec, data)

    def steps(target, tables=data):
        return {k: v for k, v in evolution.migrate(base, target, tables, dry_run=True)[1].items() if v}

    key = PLACED.key
    assert steps(spec) == {}
    assert steps(_change(spec, Customer={"props": {}})) == {"nodes_modified": ["Customer"]}
    assert steps(_change(spec, Customer={"name_template": "<{id}>"})) == {"nodes_modified": ["Customer"]}
    assert steps(_change(spec, Order={"merge_order": ("total",)})) == {"nodes_modified": ["Order"]}
    assert steps(_change(spec, Order={"props": {"status": "status", "total": "total"}})) == {"nodes_modified": ["Order"]}
    assert steps(_change(spec, PLACED={"props": {"status": "status"}})) == {"edges_modified": [key]}
    assert steps(_change(spec, PLACED={"source_key": "coupon_id"})) == {"edges_modified": [key]}
    # the nodes themselves change: edges depend on them
    assert steps(_change(spec, Order={"key": "customer_id"})) == {"nodes_modified": ["Order"], "edges_dependent": [key]}
    wider = {**data, "orders": data["orders"].withColumn("status", F.lit(1))}
    assert steps(spec, wider) == {"nodes_modified": ["Order"]}
    other = {**data, "customers": data["customers"].withColumn("id", F.col("id").cast("int"))}
    assert steps(spec, other) == {"nodes_modified": ["Customer"], "edges_dependent": [key]}


def test_migration_leaves_no_edge_without_ends(spark):
    data = tables(spark)
    spec = _spec({"name": "name"}, PLACED)
    base = PropertyGraph.build(spec, data)
    without = GraphSpec(spec.nodes[:1], spec.edges)  # the edge type is still listed
    migrated, plan = evolution.migrate(base, without, data)
    assert plan["edges_removed"] == [PLACED.key] and migrated.edge_keys == []
    fewer = {**data, "customers": data["customers"].where("id < 3").withColumn("id", F.col("id").cast("int"))}
    migrated, plan = evolution.migrate(base, spec, fewer)
    assert plan["edges_dependent"] == [PLACED.key]
    assert rows_of(migrated.edges("PLACED"), "src", "dst") == [(1, 10), (1, 11), (2, 12)]
    counted = evolution.migration_counts(base, migrated, plan)
    assert rows_of(counted, "step", "cnt") == [("nodes_modified", 2), ("relationships_rebuilt", 3)]
    assert evolution.migrate(migrated, spec, fewer)[0] is migrated


def test_answer_scoring(spark):
    golden = spark.createDataFrame(
        [("1", "traverse", ["Pen", "ink"], ["Ann"]), ("2", "unsupported", [], []), ("3", "traverse", ["x"], [])],
        "qa_id string, category string, expected_keywords array<string>, expected_entities array<string>",
    )
    answers = spark.createDataFrame(
        [("1", "a", "A PEN for ann", None, 10, 0), ("2", "a", "unsupported question", None, 5, 0), ("3", "b", "x", "boom", 7, 9)],
        "qa_id string, mode string, answer string, error string, latency_ms long, tokens long",
    )
    scored = evaluation.score_answers(answers, golden)
    assert rows_of(scored, "qa_id", "keyword_score", "entity_score", "success") == [
        ("1", 0.5, 1.0, True), ("2", 1.0, 1.0, True), ("3", 1.0, 1.0, False)
    ]
    assert evaluation.compare_modes(scored).first()["recommendation"] == "a_only"


def _brute_admit(hits, limit, seconds):
    accepted, out = {}, {}
    for key, at, tie in sorted(hits, key=lambda h: (h[0], h[1], h[2])):
        live = [t for t in accepted.get(key, []) if t > at - seconds]
        out[tie] = len(live) < limit
        accepted[key] = live + [at] if out[tie] else live
    return out


def test_rate_limit_is_exact_with_a_hot_key(spark):
    rnd = random.Random(4)
    hits = [("hot" if rnd.random() < 0.6 else f"k{rnd.randrange(5)}", rnd.randrange(0, 4000), i) for i in range(1500)]
    df = spark.createDataFrame(hits, "key string, at long, tie long").select(
        "key", F.timestamp_seconds("at").alias("ts"), "tie"
    )
    want = _brute_admit(hits, 3, 60)
    got = ratelimit.admit(df, "key", "ts", "tie", 3, 60).collect()
    assert {r["tie"]: r["accepted"] for r in got} == want
    counted = logs.trailing_counts(df, "key", "ts", 60).collect()
    brute = {t: sum(1 for k2, a2, _ in hits if k2 == k and a - 60 < a2 <= a) for k, a, t in hits}
    assert {r["tie"]: r["in_window"] for r in counted} == brute


def test_rate_limit_stream_keeps_state_between_batches(spark, tmp_path):
    hits = [("k", t, t) for t in range(0, 200, 7)]
    df = spark.createDataFrame(hits, "key string, at long, tie long").select("key", F.timestamp_seconds("at").alias("ts"), "tie")
    folder = str(tmp_path / "in")
    for lo in (0, 70, 140):
        df.where((F.col("tie") >= lo) & (F.col("tie") < lo + 70)).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = windows.run_to_table(ratelimit.admit_stream(stream, "key", "ts", "tie", 3, 60))
    assert {r["tie"]: r["accepted"] for r in out.collect()} == _brute_admit(hits, 3, 60)


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_event_time_verdicts_do_not_depend_on_batches(spark, tmp_path, batches):
    rnd = random.Random(11)
    hits = [("hot" if rnd.random() < 0.5 else f"k{rnd.randrange(4)}", rnd.randrange(0, 3000), i) for i in range(400)]
    df = spark.createDataFrame(hits, "key string, at long, tie long").select("key", F.timestamp_seconds("at").alias("ts"), "tie", "at")
    folder = str(tmp_path / "in")
    number = F.floor((F.col("at") + F.pmod(F.xxhash64("tie"), F.lit(250))) * batches / 3250)
    for k in range(batches):
        df.where(number == k).drop("at").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("key string, ts timestamp, tie long").option("maxFilesPerTrigger", 1).parquet(folder)
    out = windows.run_to_table(ratelimit.admit_events(stream, "key", "ts", "tie", 3, 60, "5 minutes"))
    passed = max(at for _, at, _ in hits) - 300
    want = {tie: ok for tie, ok in _brute_admit(hits, 3, 60).items() if hits[tie][1] <= passed}
    assert {r["tie"]: r["accepted"] for r in out.collect()} == want


def test_percentile_interpolates(spark):
    log = spark.createDataFrame(
        [("t", v, False, None) for v in (10, 20, 30, 40)], "tenant_id string, latency_ms long, cached boolean, error string"
    )
    row = logs.query_analytics(log).first()
    assert row["p95_latency_ms"] == 38.5 and row["avg_latency_ms"] == 25.0


def test_ranking_helpers(spark):
    df = spark.createDataFrame([(1, "done", 5), (2, "run", None), (3, "done", 9), (4, "done", 7)], "id long, s string, at long")
    kept = ranking.keep_newest_finished(df, 2, ["done"], "s", "at", "id")
    assert rows_of(kept, "id") == [(2,), (3,), (4,)]
    assert ranking.latest_where(df.withColumn("t", F.lit("x")), ["t"], "id", F.col("s") == "done").first()["id"] == 4
    assert SPEC.node("Customer").table == "customers"


PEOPLE = TableSpec("people", (ColumnSpec("id", "BIGINT", nullable=False), ColumnSpec("name", "TEXT")))


def test_csv_quotes_breaks_and_tabs(spark, tmp_path):
    path = tmp_path / "people.csv"
    path.write_bytes(b'\xef\xbb\xbfid,name\n1,"say ""hi"", ok"\n\t2\t,"two\nlines"\n3,plain\n')
    raw, warnings = csv.load_csv(spark, str(path), PEOPLE)
    good, bad = csv.coerce(raw, PEOPLE)
    assert [tuple(r) for r in good.orderBy("id").collect()] == [(1, 'say "hi", ok'), (2, "two\nlines"), (3, "plain")]
    assert bad.count() == 0 and warnings == []


def test_csv_in_a_legacy_encoding(spark, tmp_path):
    path = tmp_path / "people.csv"
    path.write_bytes('id,name\n1,"주문, 하나"\n2,둘\n'.encode("cp949"))
    raw, warnings = csv.load_csv(spark, str(path), PEOPLE)
    good, _ = csv.coerce(raw, PEOPLE)
    assert [tuple(r) for r in good.orderBy("id").collect()] == [(1, "주문, 하나"), (2, "둘")]
    assert warnings == ["read as cp949"]


def test_csv_load_errors_are_rows(spark, tmp_path):
    given = {"people.csv": "id,name\n1,a\n", "empty.csv": "", "head.csv": "id,name\n", "key.csv": "name\nx\n", "odd.txt": "id\n1\n", "other.csv": "x\n1\n"}
    paths = []
    for name, text in given.items():
        (tmp_path / name).write_text(text)
        paths.append(str(tmp_path / name))
    specs = [TableSpec(n, PEOPLE.columns) for n in ("people", "empty", "head", "key", "odd.txt")]
    loaded, notes = csv.load_all(spark, paths + paths[:1], specs)
    got = {(r["table"], r["message"]) for r in notes.where("level = 'error'").collect()}
    assert got == {
        ("empty", "empty file"), ("head", "header without rows"), ("key", "missing required column(s): id"),
        ("odd.txt", "not a .csv file"), ("other", "no declared table has this name"), ("people", "table given twice"),
    }
    assert set(loaded) == {"people"}


def test_document_without_chunks_loses_its_old_ones(spark, tmp_path):
    kind = "tenant_id string, doc_id long, chunk_index int, text string"
    folder = str(tmp_path / "chunks")
    first = spark.createDataFrame([("a", 1, 0, "x"), ("a", 2, 0, "y"), ("b", 1, 0, "z")], kind)
    maintenance.write_chunks(first, folder, buckets=16)
    written = spark.createDataFrame([("a", 1), ("a", 2)], "tenant_id string, doc_id long")
    again = spark.createDataFrame([("a", 2, 0, "new")], kind)
    maintenance.write_chunks(again, folder, buckets=16, documents=written)
    got = spark.read.parquet(folder).select("tenant_id", "doc_id", "text").collect()
    assert sorted(map(tuple, got)) == [("a", 2, "new"), ("b", 1, "z")]


def test_documents_change_fail_and_shrink(spark, tmp_path):
    names = spark.createDataFrame([("alpha", "Word"), ("beta", "Word")], "name string, label string")
    kind = "doc_id long, filename string, content string, at long"
    source = tmp_path / "in"
    puts = [
        [(1, "z.txt", "alpha beta", 1), (2, "b.bin", "alpha", 1), (3, "c.txt", "alpha", 1)],
        [(1, "z.txt", "gone", 3), (1, "a.txt", "beta now", 4), (2, "b.txt", "alpha", 3), (3, "c.txt", "  ", 3)],
    ]
    folder, got = str(tmp_path / "out"), None
    for number, rows in enumerate(puts):
        part = str(source / str(number))
        spark.createDataFrame(rows, kind).write.parquet(part)
        stream = spark.readStream.schema(kind).parquet(part)
        got = ingest.ingest_documents(stream, names, folder, order=["at"], generation=number, strategy="fixed")
    rows = {r["doc_id"]: (r["filename"], r["status"]) for r in got["documents"].collect()}
    assert rows == {1: ("a.txt", "ready"), 2: ("b.txt", "ready"), 3: ("c.txt", "failed")}
    assert {(r["doc_id"], r["text"]) for r in got["chunks"].collect()} == {(1, "beta now"), (2, "alpha")}
    assert {(r["doc_id"], r["name"]) for r in got["mentions"].collect()} == {(1, "beta"), (2, "alpha")}
