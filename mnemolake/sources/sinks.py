"""Writing documents and the audit ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mnemolake.operators.identity import add_content_hash, dedupe_documents


def read_store(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored documents, or None before the first write."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(fs_path) or not list(fs.listStatus(fs_path)):
        return None
    return spark.read.parquet(path)


def write_documents(new: DataFrame, path: str, batch: int) -> DataFrame:
    """Append the documents that are new; returns (doc_id, existing_id, is_duplicate) of every row.

    A batch owns its folder, so running it again replaces its own output and nothing else.
    """
    store = read_store(new.sparkSession, path)
    if store is not None:
        store = store.filter(F.col("batch") < batch).select("doc_id", "text", "source", "seq")
    marked = dedupe_documents(new, store)
    fresh = new.join(marked.filter(~F.col("is_duplicate")).select("doc_id"), "doc_id", "left_semi")
    add_content_hash(fresh).write.mode("overwrite").partitionBy("source").parquet(f"{path}/batch={batch}")
    return marked.select("doc_id", "existing_id", "is_duplicate")


def ledger_append(events: DataFrame, path: str) -> None:
    """Append audit events as JSON lines."""
    events.write.mode("append").json(path)


LEDGER = "event_id string, recorded_at string, actor string, mode string, approved_item_count long, pending_review_count long"


def ledger_tail(spark: SparkSession, path: str, limit: int = 50, schema: str = LEDGER) -> tuple[DataFrame, DataFrame]:
    """The newest events, and totals over all events."""
    events = spark.read.schema(schema).json(path)
    tail = events.orderBy(F.desc("recorded_at"), F.desc("event_id")).limit(limit)
    totals = events.agg(
        F.count("*").alias("event_count"), F.max_by("event_id", F.struct("recorded_at", "event_id")).alias("last_event_id"),
        F.max("recorded_at").alias("last_recorded_at"), F.sum("approved_item_count").alias("approved_item_count"),
        F.sum("pending_review_count").alias("pending_review_count"),
    )
    return tail, totals
