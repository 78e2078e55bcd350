"""Catalogue: streaming operators, drained over the event and document tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.graph import union_all
from loomgraph.operators import logs
from loomgraph.plans import sqlparts as q
from loomgraph.plans.registry import checked
from loomgraph.plans.text_queries import _passages, _sql_fixed
from loomgraph.session import shared_dir
from loomgraph.streaming import ingest, ratelimit, windows

LIMIT, SECONDS = 2, 21_600

_ADMIT = f"""WITH RECURSIVE h AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
    FROM events),
  r(user_id, n, event_id, accepted, held) AS (SELECT user_id, n, event_id, true, [ts] FROM h WHERE n = 1
    UNION ALL SELECT h.user_id, h.n, h.event_id, len(list_filter(r.held, lambda t: t > h.ts - INTERVAL {SECONDS} SECOND)) < {LIMIT},
      CASE WHEN len(list_filter(r.held, lambda t: t > h.ts - INTERVAL {SECONDS} SECOND)) < {LIMIT}
        THEN list_append(list_filter(r.held, lambda t: t > h.ts - INTERVAL {SECONDS} SECOND), h.ts)
        ELSE list_filter(r.held, lambda t: t > h.ts - INTERVAL {SECONDS} SECOND) END
    FROM r JOIN h ON h.user_id = r.user_id AND h.n = r.n + 1)
  SELECT user_id, event_id, accepted FROM r"""


def _stream(w, name: str = "events"):
    rows = windows.read_table_stream(w.spark, w.folder, f"{name}.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows


def _in_batches(w, name: str, batches: int, ts: str = "ts", jitter: int = 240):
    """A table as a stream of several files, one per micro-batch, in about the order of time.

    Rows change places by up to ``jitter`` seconds, so neighbouring batches overlap.
    """
    rows = w.t(name).withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp")) + F.pmod(F.xxhash64("event_id"), F.lit(jitter * 1_000_000)))
    low, high = rows.agg(F.min("_at"), F.max("_at")).first()
    folder = shared_dir(w.spark, "batches")
    number = F.floor((F.col("_at") - low) * batches / (high - low + 1))
    for k in range(batches):  # one after the other: the source takes files in the order of writing
        rows.where(number == k).drop("_at").coalesce(1).write.mode("append").parquet(folder)
    stream = w.spark.readStream.schema(w.t(name).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def _wall(df):
    """Instants back to the zone-free times of the source."""
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])


@checked("x1_sliding_rate_limit", _ADMIT)
def _x1(w):
    hits = w.t("events").select("user_id", "ts", "event_id")
    return ratelimit.admit(hits, "user_id", "ts", "event_id", LIMIT, SECONDS).select("user_id", "event_id", "accepted")


@checked("x1_streaming_rate_limit", _ADMIT)
def _x1b(w):
    out = ratelimit.admit_stream(_stream(w), "user_id", "ts", "event_id", LIMIT, SECONDS)
    return windows.run_to_table(out).select("user_id", "event_id", "accepted")


@checked(
    "x1_event_time_rate_limit",
    f"SELECT a.* FROM ({_ADMIT}) a JOIN events e USING (event_id) WHERE e.ts <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)",
)
def _x1d(w):
    """Five overlapping micro-batches; verdicts of the last ten minutes are still open."""
    out = ratelimit.admit_events(_in_batches(w, "events", 5), "user_id", "ts", "event_id", LIMIT, SECONDS)
    return windows.run_to_table(out).select("user_id", "event_id", "accepted")


@checked(
    "x1_trailing_counts",
    f"""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '{SECONDS - 0.000001}' SECOND
          PRECEDING AND CURRENT ROW) AS in_window FROM events""".replace(
        f"INTERVAL '{SECONDS - 0.000001}' SECOND", f"to_microseconds({SECONDS * 1_000_000 - 1})"
    ),
)
def _x1c(w):
    return logs.trailing_counts(w.t("events"), "user_id", "ts", SECONDS).select("event_id", "in_window")


_CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


@checked(
    "x2_tumbling_counts",
    f"""SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS cnt,
          {q.sum_cents('value')} AS value_cents FROM (SELECT date_trunc('hour', ts) AS window_start, event_type, value FROM events) e
        WHERE window_start + INTERVAL 1 HOUR <= {_CLOSED} GROUP BY window_start, event_type""",
)
def _x2(w):
    total = F.sum(F.round(F.col("value") * 100).cast("long")).alias("value_cents")
    counts = windows.windowed_counts(_stream(w), "ts", "1 hour", by=["event_type"], measures=[total])
    return _wall(windows.run_to_table(counts))


@checked(
    "x2_sliding_counts",
    f"""SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, count(*) AS cnt FROM (
          SELECT unnest([s, s - INTERVAL 30 MINUTE]) AS window_start FROM (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS s FROM events) b) e
        WHERE window_start + INTERVAL 1 HOUR <= {_CLOSED} GROUP BY window_start""",
)
def _x2b(w):
    return _wall(windows.run_to_table(windows.windowed_counts(_stream(w), "ts", "1 hour", "30 minutes")))


@checked(
    "x3_sessions",
    f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER u < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS cut FROM events
          WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT user_id, ts, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
        SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS events FROM s
        GROUP BY user_id, n HAVING max(ts) + INTERVAL 6 HOUR <= {_CLOSED}""",
)
def _x3(w):
    return _wall(windows.run_to_table(windows.sessionize(_in_batches(w, "events", 4), "user_id", "ts", "6 hours")))


@checked(
    "x3_live_sessions",
    """SELECT user_id, created FROM (SELECT user_id, min(ts) AS created FROM events GROUP BY 1)
       WHERE (SELECT min(ts) + INTERVAL 12 HOUR FROM events) - created < INTERVAL 11 HOUR
       ORDER BY created DESC, user_id LIMIT 50""",
)
def _x3b(w):
    """First activity as creation time, seen half a day after the log begins."""
    sessions = w.t("events").groupBy("user_id").agg(F.min("ts").alias("created"))
    now = w.t("events").agg((F.min("ts") + F.expr("INTERVAL 12 HOURS")).alias("now")).first()["now"]  # one value
    return windows.live_sessions(sessions, F.lit(now), "created", "user_id", 11 * 3600, 50)


@checked(
    "x4_streaming_dedup",
    "SELECT DISTINCT user_id, event_type FROM events",
)
def _x4(w):
    rows = _stream(w).select("user_id", "event_type", "ts")
    return windows.run_to_table(windows.dedup(rows, ["user_id", "event_type"], "ts", "60 days")).select(
        "user_id", "event_type"
    )


@checked(
    "x5_streaming_graph_upsert",
    """SELECT user_id AS src, part AS dst, event_type, ts FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT)
         AS part FROM events) e QUALIFY row_number() OVER (PARTITION BY user_id, part ORDER BY ts DESC, event_type DESC) = 1""",
)
def _x5(w):
    """Customer-to-part edges, the latest event winning over several batches."""
    rows = _in_batches(w, "events", 4).select(
        F.col("user_id").alias("src"), F.get_json_object("props", "$.k").try_cast("long").alias("dst"), "event_type", "ts"
    )
    return _wall(ingest.upsert_graph(rows, shared_dir(w.spark, "edges"), ["src", "dst"], ["ts"], buckets=8))


_FINAL = """(SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN left(text, length(text) // 2) ELSE text END AS body FROM documents
  WHERE doc_id % 3 <> 1)"""
_FINAL_CHUNKS = _sql_fixed(_FINAL, 1000, 200)


@checked(
    "x6_streaming_document_ingest",
    f"""WITH c AS (SELECT * FROM {_FINAL_CHUNKS} x),
         m AS (SELECT c.doc_id, c.chunk_index, b.text AS name FROM c JOIN benchmark b ON contains(lower(c.text), lower(b.text)))
       SELECT 'documents' AS element, count(*) AS cnt, CAST(sum(doc_id) AS BIGINT) AS ids FROM documents
       UNION ALL SELECT 'failed', count(*), CAST(coalesce(sum(doc_id), 0) AS BIGINT) FROM documents
         WHERE doc_id % 3 = 1 OR doc_id NOT IN (SELECT doc_id FROM c)
       UNION ALL SELECT 'chunks', count(*), CAST(coalesce(sum(doc_id * 1000 + chunk_index), 0) AS BIGINT) FROM c
       UNION ALL SELECT 'mentions', count(*), CAST(coalesce(sum(doc_id * 1000 + chunk_index), 0) AS BIGINT) FROM m""",
)
def _x6(w):
    """All documents arrive; then a third comes again at half its length, a third under an unknown extension."""
    stream = _stream(w, "documents")
    text_file = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    third = F.col("doc_id") % 3
    first = stream.select("doc_id", text_file.alias("filename"), F.col("text").alias("content"))
    again = stream.where(third < 2).select(
        "doc_id",
        F.when(third == 0, text_file).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".bin"))).alias("filename"),
        F.when(third == 0, F.expr("left(text, length(text) div 2)")).otherwise(F.col("text")).alias("content"),
    )
    folder = shared_dir(w.spark, "ingest")
    ingest.ingest_documents(first, _passages(w), folder, strategy="fixed")
    got = ingest.ingest_documents(again, _passages(w), folder, generation=1, strategy="fixed")
    place = F.col("doc_id") * 1000 + F.col("chunk_index")
    rows = [
        got["documents"].select(F.lit("documents").alias("element"), F.col("doc_id").alias("i")),
        got["documents"].where("status = 'failed'").select(F.lit("failed").alias("element"), F.col("doc_id").alias("i")),
        got["chunks"].select(F.lit("chunks").alias("element"), place.alias("i")),
        got["mentions"].select(F.lit("mentions").alias("element"), place.alias("i")),
    ]
    return union_all(rows).groupBy("element").agg(F.count(F.lit(1)).alias("cnt"), F.sum("i").alias("ids"))


@checked(
    "x7_stream_static_enrichment",
    """SELECT event_id, user_id, c_name AS name, c_mktsegment AS segment FROM events LEFT JOIN customer ON c_custkey = user_id""",
)
def _x7(w):
    rows = _stream(w).select("event_id", "user_id")
    nodes = w.graph.nodes("Customer").select("id", "name", "segment")
    return windows.run_to_table(windows.enrich(rows, nodes, "user_id")).select("event_id", "user_id", "name", "segment")


