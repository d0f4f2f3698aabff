"""Incremental pulls, ingest checks, import reports and job counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mnemolake.functions import fixed
from mnemolake.functions.text import strip


def normalize_ingest_batch(items: DataFrame, max_chars: int = fixed.MAX_INGEST_CHARS, max_items: int = fixed.MAX_INGEST_ITEMS) -> tuple[DataFrame, DataFrame]:
    """Accepted rows as documents, and rejected rows with a reason.

    ``items`` (batch_id, item_id, text, title, source, tags). A batch with an invalid item or too many items
    is rejected as a whole.
    """
    reason = F.when(~(F.length(F.coalesce("text", F.lit(""))) > 0), "missing text").when(F.length("text") > max_chars, "text too long")
    rows = items.withColumn("reason", reason)
    batches = rows.groupBy("batch_id").agg(
        F.count("*").alias("_n"), F.min(F.when(F.col("reason").isNotNull(), F.col("item_id"))).alias("_bad")
    )
    rows = rows.join(batches, "batch_id")
    why = F.coalesce(
        "reason", F.when(F.col("_n") > max_items, F.lit(f"more than {max_items} items")), F.when(F.col("_bad").isNotNull(), F.lit("batch has an invalid item"))
    )
    rows = rows.withColumn("reason", why).drop("_n", "_bad")
    has = F.coalesce("title", F.lit("")) != ""
    good = rows.filter("reason is null").select(
        "batch_id", "item_id",
        F.when(has, F.concat("title", F.lit("\n\n"), "text")).otherwise(F.col("text")).alias("text"),
        F.when(F.coalesce("source", F.lit("")) == "", "ingest").otherwise(F.col("source")).alias("source"),
        F.array_join(F.coalesce("tags", F.array().cast("array<string>")), ", ").alias("tags"),
    )
    return good, rows.filter("reason is not null").select("batch_id", "item_id", "reason")


def new_files_only(files: DataFrame, indexed: DataFrame) -> DataFrame:
    """Files not indexed yet with the same path and change time."""
    return files.join(indexed.select("path", "modified_at").distinct(), ["path", "modified_at"], "left_anti")


def incremental_sync(rows: DataFrame, cursor: str | None, started_at: str, failed: bool = False) -> tuple[DataFrame, str | None]:
    """Rows edited after the cursor, and the next cursor: the start of this run, or the old one if it failed."""
    fresh = rows if cursor is None else rows.filter(F.col("last_edited") > F.lit(cursor).cast("timestamp"))
    return fresh, cursor if failed else started_at


def sync_summary(outcomes: DataFrame) -> DataFrame:
    """Counts of a run; it succeeded when fewer items failed than were seen."""
    count = lambda v: F.count_if(F.col("outcome") == v)
    rows = outcomes.groupBy("connector").agg(
        F.count("*").alias("items"), count("indexed").alias("indexed"), count("updated").alias("updated"),
        count("duplicate").alias("duplicates"), count("error").alias("errors"),
    )
    return rows.withColumn("success", F.col("errors") < F.col("items"))


def media_registry(files: DataFrame) -> DataFrame:
    """Media files per connector, type and folder context with counts and bytes. ``files``: connector, path, size."""
    low = F.lower("path")
    ext = F.regexp_extract(low, r"\.([^./]+)$", 1)
    kind = (
        F.when(ext.isin(*fixed.PHOTO_EXTENSIONS), "photo").when(ext.isin(*fixed.VIDEO_EXTENSIONS), "video")
        .when(ext.isin(*fixed.AUDIO_EXTENSIONS), "audio")
    )
    context = F.lit("unknown")
    for name in ("profile", "photos_and_videos", "posts", "messages"):
        context = F.when(F.contains(low, F.lit(name + "/")), name).otherwise(context)
    rows = files.select("connector", "size", kind.alias("media_type"), context.alias("context")).filter("media_type is not null")
    return rows.groupBy("connector", "media_type", "context").agg(F.count("*").alias("files"), F.sum("size").alias("total_size"))


def media_totals(registry: DataFrame) -> DataFrame:
    n = lambda kind: F.sum(F.when(F.col("media_type") == kind, F.col("files")).otherwise(0))
    return registry.groupBy("connector").agg(
        n("photo").alias("photos"), n("video").alias("videos"), n("audio").alias("audio"), F.sum("total_size").alias("total_size")
    )


def import_report(files: DataFrame, indexed: DataFrame, deduped: DataFrame) -> DataFrame:
    """Outcome per file: unsupported, error, empty, already indexed, duplicate of another document, or indexed.

    ``files`` (doc_id, path, modified_at, extension, text, error); ``deduped`` from ``dedupe_documents``.
    """
    known = indexed.select("path", "modified_at", F.lit(True).alias("_known")).distinct()
    dup = deduped.select("doc_id", "existing_id", "is_duplicate")
    j = files.join(known, ["path", "modified_at"], "left").join(dup, "doc_id", "left")
    outcome = (
        F.when(~F.col("extension").isin(*fixed.TEXT_EXTENSIONS), "unsupported")
        .when(F.col("error").isNotNull(), "error")
        .when(strip(F.coalesce("text", F.lit(""))) == "", "empty")
        .when(F.coalesce("_known", F.lit(False)), "already indexed")
        .when(F.coalesce("is_duplicate", F.lit(False)), F.concat(F.lit("duplicate of "), F.col("existing_id")))
        .otherwise("indexed")
    )
    return j.select("doc_id", "path", outcome.alias("outcome"))


def job_status_counts(jobs: DataFrame) -> DataFrame:
    count = lambda v: F.count_if(F.col("status") == v).alias(v)
    return jobs.agg(count("queued"), count("processing"), count("completed"), count("failed")).withColumn(
        "active", F.col("queued") + F.col("processing") > 0
    )


def recent_jobs(jobs: DataFrame, limit: int = 50) -> DataFrame:
    """Processing first, then queued, then newest."""
    order = F.when(F.col("status") == "processing", 0).when(F.col("status") == "queued", 1).otherwise(2)
    return jobs.orderBy(order, F.desc("started_at"), F.desc("job_id")).limit(limit)
