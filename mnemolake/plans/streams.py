"""Streaming queries: the given tables arrive as streams and are processed to the end."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemolake.operators import enrich
from mnemolake.plans.documents import HASH
from mnemolake.plans.views import Registry
from mnemolake.session import scratch_path
from mnemolake.streaming import jobs

registry = Registry()
add = registry.add


def source(t, name: str):
    return jobs.read_table_stream(t.spark, t.dir, f"{name}.parquet")


@add(
    "session_ttl",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_access,
    strftime(max(ts) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS expires_at, count(*) AS accesses FROM s GROUP BY user_id, sid""",
)
def _(t):
    return jobs.sessions(t.events)


@add("stream_sessions")
def _(t):
    """Closed sessions only: the last ones wait for the watermark."""
    path, check = scratch_path(t.spark, "sessions"), scratch_path(t.spark, "ck")
    write = lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}")
    jobs.run_available(jobs.sessions(source(t, "events"), late="1 hour"), write, check)
    return t.spark.read.parquet(path).drop("batch")


@add("stream_capture", """SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role, left(text, 100) ORDER BY turn) = 1""")
def _(t):
    path, check = scratch_path(t.spark, "capture"), scratch_path(t.spark, "ck")
    stream = source(t, "conversations").select("conv_id", F.col("turn").alias("seq"), "role", "text", F.lit(False).alias("full"))
    jobs.stream_capture(stream, path, check)
    jobs.stream_capture(stream, path, scratch_path(t.spark, "ck"))  # the same captures once more change nothing
    rows = jobs.captured_messages(t.spark.read.parquet(f"{path}/messages"))
    return rows.select("conv_id", F.col("seq").alias("turn"), "role", "text")


@add("stream_ingest", f"SELECT doc_id FROM (SELECT doc_id, {HASH} AS h FROM documents) QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id) = 1")
def _(t):
    path = scratch_path(t.spark, "ingest")
    stream = source(t, "documents").select("doc_id", F.col("doc_id").alias("seq"), "text", "source")
    jobs.stream_ingest(stream, path, scratch_path(t.spark, "ck"))
    return t.spark.read.parquet(path).select("doc_id")


@add("stream_enrich", "SELECT doc_id, 0 AS errors FROM documents WHERE trim(text) <> ''")
def _(t):
    path = scratch_path(t.spark, "enrich")
    stream = source(t, "documents").withColumn("filename", F.concat("source", F.lit("_"), "doc_id", F.lit(".txt")))
    jobs.stream_enrich(stream, lambda df: enrich.enrich_documents(df, t.taxonomy), path, scratch_path(t.spark, "ck"))
    return t.spark.read.parquet(f"{path}/enriched").select("doc_id", F.size("errors").alias("errors"))


@add("stream_sync", "SELECT page_id, url FROM pages")
def _(t):
    path, check = scratch_path(t.spark, "sync"), scratch_path(t.spark, "ck")
    jobs.stream_sync(source(t, "pages"), path, check)
    jobs.stream_sync(source(t, "pages"), path, check)  # nothing is newer: nothing is copied twice
    return t.spark.read.parquet(path).select("page_id", "url")


@add("stream_ledger", "SELECT event_id, event_type FROM events")
def _(t):
    path = scratch_path(t.spark, "ledger")
    jobs.stream_ledger(source(t, "events").select("event_id", "event_type"), path, scratch_path(t.spark, "ck"))
    return t.spark.read.schema("event_id long, event_type string").json(path)


ACTIVITY = """SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, 'u' || user_id AS actor, event_type AS kind, count(*) AS n
    FROM events GROUP BY ALL"""


def acted(df):
    return df.select("ts", F.concat(F.lit("u"), "user_id").alias("actor"), F.col("event_type").alias("kind"))


@add("stream_activity", ACTIVITY)
def _(t):
    path = scratch_path(t.spark, "activity")
    jobs.stream_activity(acted(source(t, "events")), path, scratch_path(t.spark, "ck"))
    return jobs.latest_counts(t.spark, path)
