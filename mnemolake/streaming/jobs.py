"""Structured Streaming forms of the incremental jobs.

State that may grow with the data lives in tables written per micro-batch, not in one key's memory: a batch
owns the folder ``batch=N`` of its output, so a batch that is run again replaces exactly its own rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from mnemolake.operators.common import first_per
from mnemolake.sources.sinks import read_store, write_documents


def read_table_stream(spark: SparkSession, folder: str, name: str, max_files: int | None = None) -> DataFrame:
    """A Parquet table as a stream, with the schema of what is there now; it may be one file or a folder of files."""
    # as a pattern the name fits a file and a folder alike: a plain path must be a folder, a name filter sees only files
    path = f"{folder}/{name[:-1]}[{name[-1]}]"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run a stream over everything that is there and stop; the checkpoint is the cursor of the next run."""
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def _run(job: Callable, *args) -> None:
    """A batch function must return nothing."""
    job(*args)


# --- capture ------------------------------------------------------------------------------------------------
def captured_messages(messages: DataFrame) -> DataFrame:
    """Current messages of every conversation: those since (and of) its last full capture."""
    last = messages.groupBy("conv_id").agg(F.max("generation").alias("_last"))
    return messages.join(last, "conv_id").filter(F.col("generation") == F.col("_last")).drop("_last")


def capture_batch(batch: DataFrame, path: str, batch_id: int) -> DataFrame:
    """Store one batch of captures; returns (conv_id, new_messages, event).

    A full capture (a run of full rows in the order of ``seq``) replaces the conversation by starting a new generation;
    of several, the last one counts, and what came before it goes. Other messages, also those after a full capture,
    are skipped when their role and first 100 characters are known already. ``batch``: conv_id, seq, role, text, full.
    """
    spark = batch.sparkSession
    stored = read_store(spark, f"{path}/messages")
    stored = None if stored is None else stored.filter(F.col("batch") < batch_id)
    generation = F.lit(batch_id + 1).cast("long")
    full = batch.groupBy("conv_id").agg(F.bool_or("full").alias("_full"), F.max(F.when(F.col("full"), F.col("seq"))).alias("_last"))
    marked = batch.join(full, "conv_id")
    # the last run of full rows begins after the last other row before its end
    before = marked.groupBy("conv_id").agg(F.max(F.when(~F.col("full") & (F.col("seq") < F.col("_last")), F.col("seq"))).alias("_before"))
    full = full.drop("_last")
    rows = marked.join(before, "conv_id").filter("_before is null or seq > _before").withColumn("head", F.left("text", F.lit(100)))
    if stored is None:
        known = spark.createDataFrame([], "conv_id long, generation long, role string, head string")
    else:
        known = captured_messages(stored).select("conv_id", "generation", "role", F.left("text", F.lit(100)).alias("head"))
    current = known.groupBy("conv_id").agg(F.max("generation").alias("_current"), F.count("*").alias("_had"))
    replaced = rows.filter(F.col("_full") & F.col("full")).select(
        "conv_id", "seq", "role", "text", generation.alias("generation")
    )
    appended = first_per(rows.filter(~F.col("full")), ["conv_id", "role", "head"], [F.col("seq")])
    seen = known.join(full.filter(~F.col("_full")).select("conv_id"), "conv_id", "left_semi").select("conv_id", "role", "head")
    seen = seen.unionByName(rows.filter(F.col("full")).select("conv_id", "role", "head")).distinct()
    appended = appended.join(seen, ["conv_id", "role", "head"], "left_anti").join(current, "conv_id", "left").select(
        "conv_id", "seq", "role", "text",
        F.when(F.col("_full"), generation).otherwise(F.coalesce("_current", F.lit(0))).cast("long").alias("generation"),
    )
    fresh = replaced.unionByName(appended)
    fresh.write.mode("overwrite").parquet(f"{path}/messages/batch={batch_id}")
    written = spark.read.parquet(f"{path}/messages/batch={batch_id}").groupBy("conv_id").agg(F.count("*").alias("_n"))
    events = full.join(written, "conv_id", "left").join(current, "conv_id", "left")
    had, n = F.coalesce("_had", F.lit(0)), F.coalesce("_n", F.lit(0))
    events = events.select(
        "conv_id", F.when(F.col("_full"), n - had).otherwise(n).alias("new_messages"),
        F.when(F.col("_had").isNull(), "new_message").otherwise("conversation_updated").alias("event"),
    )
    events.write.mode("overwrite").parquet(f"{path}/events/batch={batch_id}")
    return events


def stream_capture(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return run_available(stream, lambda df, n: _run(capture_batch, df, path, n), checkpoint)


# --- ingest and enrichment -------------------------------------------------------------------------------
def stream_ingest(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append new documents, dropping those whose hash was seen before. ``stream``: doc_id, seq, text, source."""
    return run_available(stream, lambda df, n: _run(write_documents, df, path, n), checkpoint)


def stream_enrich(
    stream: DataFrame, enrich: Callable[[DataFrame], DataFrame], path: str, checkpoint: str
) -> StreamingQuery:
    """Enrich every batch; rows with errors go to the dead-letter table. Failed tasks are retried by Spark.

    Each table is computed on its own: ``enrich`` tells the rows with errors before its work, so theirs costs one scan and
    no results have to be kept for a second look.
    """

    def each(df: DataFrame, n: int) -> None:
        out = enrich(df)
        out.filter(F.size("errors") == 0).write.mode("overwrite").parquet(f"{path}/enriched/batch={n}")
        out.filter(F.size("errors") > 0).select("doc_id", "errors").write.mode("overwrite").parquet(f"{path}/failed/batch={n}")

    return run_available(stream, each, checkpoint)


def stream_sync(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Copy what is new at the source; running it again pulls only newer files."""
    return run_available(stream, lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}"), checkpoint)


def stream_ledger(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append-only audit lines."""
    query = (
        stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


# --- sessions and activity ---------------------------------------------------------------------------------
def sessions(events: DataFrame, gap: str = "1 hour", late: str | None = None) -> DataFrame:
    """Sessions with a sliding time-out: every access extends the session of a user.

    Works on a table and, with ``late`` (how long to wait for late rows), on a stream. Rows without a time are left out;
    a null user is a user.
    """
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if not late:
        return stitched_sessions(rows, gap)
    grouped = rows.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(
        F.count("*").alias("accesses"), F.max("ts").alias("last_access")
    )
    return grouped.select(
        "user_id", F.col("w.start").alias("started_at"), "last_access", F.col("w.end").alias("expires_at"), "accesses"
    )


def stitched_sessions(rows: DataFrame, gap: str) -> DataFrame:
    """Sessions of a table from the first and last access of every stretch of time as long as the gap.

    Accesses within one stretch always belong together, so they are counted before the shuffle, and a user with
    most of all accesses costs one row per stretch. Only the edges of neighbouring stretches are then compared.
    """
    wait = F.expr(f"INTERVAL {gap}")
    stretches = rows.groupBy("user_id", F.window("ts", gap)["start"].alias("stretch")).agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n")
    )
    order = Window.partitionBy("user_id").orderBy("stretch")
    fresh = F.coalesce((F.col("first") > F.lag("last").over(order) + wait).cast("int"), F.lit(1))
    numbered = stretches.withColumn("fresh", fresh).withColumn("session", F.sum("fresh").over(order))
    return numbered.groupBy("user_id", "session").agg(
        F.min("first").alias("started_at"), F.max("last").alias("last_access"), F.sum("n").alias("accesses")
    ).select("user_id", "started_at", "last_access", (F.col("last_access") + wait).alias("expires_at"), "accesses")


def activity(events: DataFrame, window: str = "1 hour", late: str | None = None) -> DataFrame:
    """Counts per window, actor and kind."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if late else rows
    return rows.groupBy(F.window("ts", window).alias("w"), "actor", "kind").agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("window_start"), "actor", "kind", "n"
    )


def stream_activity(stream: DataFrame, path: str, checkpoint: str, window: str = "1 hour", late: str = "1 day") -> StreamingQuery:
    """Running counts: every batch writes the groups it changed; the latest row of a group counts."""
    write = lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}")
    return run_available(activity(stream, window, late), write, checkpoint, "update")


def latest_counts(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return first_per(rows, ["window_start", "actor", "kind"], [F.desc("batch")]).drop("batch")
