"""Counts and groupings over documents, conversations and files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from mnemolake.functions import fixed
from mnemolake.operators.retrieval import has_topic


def topic_counts(docs: DataFrame) -> DataFrame:
    """Documents per topic, most frequent first."""
    rows = docs.select(F.explode_outer("topics").alias("topic")).filter(F.col("topic").isNotNull())
    return rows.groupBy("topic").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc("topic"))


def documents_by_topic(docs: DataFrame, topic: str, page: int = 1, page_size: int = 20) -> DataFrame:
    found = docs.filter(has_topic(topic)).orderBy("doc_id")
    return found.offset((page - 1) * page_size).limit(page_size)


def find_by_entity(docs: DataFrame, field: str, name: str) -> DataFrame:
    """Documents whose entity list of a kind holds a name, without regard to case."""
    return docs.filter(F.exists(field, lambda e: F.lower(e) == name.lower()))


def capture_stats(messages: DataFrame, sites: DataFrame) -> DataFrame:
    """Conversations and messages per site (sites without any included) and overall."""
    per_conv = messages.groupBy("site", "conv_id").agg(F.count("*").alias("m"))
    per_site = per_conv.groupBy("site").agg(F.count("*").alias("conversations"), F.sum("m").alias("messages"))
    rows = sites.select("site").join(per_site, "site", "left").fillna(0)
    total = rows.agg(
        F.lit("all").alias("site"), F.sum("conversations").alias("conversations"), F.sum("messages").alias("messages")
    )
    return rows.unionByName(total)


def conversation_documents(messages: DataFrame, heads: DataFrame, part_turns: int = 1000) -> DataFrame:
    """One markdown document per conversation.

    ``heads``: conv_id, title, site_name, url, captured. Conversations of more than ``part_turns`` turns
    come in numbered parts, so none is ever gathered whole; the parts joined give the document.
    """
    block = lambda m: F.concat(
        F.when(m["role"] == "user", "**User:**").otherwise("**Assistant:**"), F.lit("\n"), m["text"], F.lit("\n")
    )
    part = F.floor(F.col("turn") / part_turns).alias("part")
    bodies = messages.groupBy("conv_id", part).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), block), "\n").alias("body"),
        F.count("*").alias("message_count"),
    )
    head = F.concat(
        F.lit("# "), F.col("title"), F.lit("\n\n**Source:** "), F.col("site_name"), F.lit(" Conversation\n**URL:** "),
        F.col("url"), F.lit("\n**Captured:** "), F.col("captured"), F.lit("\n\n---\n\n"),
    )
    head = F.when(F.col("part") == 0, head).otherwise("")
    return heads.join(bodies, "conv_id").select("conv_id", "part", F.concat(head, F.col("body")).alias("text"), "message_count")


def list_conversations(messages: DataFrame, site: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """Conversations, most recently updated first."""
    rows = messages.filter(F.col("site") == site) if site else messages
    convs = rows.groupBy("conv_id", "site").agg(F.max("ts").alias("updated_at"), F.count("*").alias("message_count"))
    return convs.orderBy(F.desc("updated_at"), F.asc("conv_id")).offset(offset).limit(limit)


def source_stats(sources: DataFrame) -> DataFrame:
    """``sources``: one row per source with items and bytes."""
    return sources.agg(
        F.sum("items").alias("item_count"), F.sum("bytes").alias("total_bytes"), F.count("*").alias("source_count")
    )


# --- files -------------------------------------------------------------------------------------------------
def _signal_text(name: Column) -> Column:
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", " "), F.lit(" "))


def classify_files(files: DataFrame) -> DataFrame:
    """Category of a file by whole-word signals in its name; the first category with most signals wins.

    ``files`` has (file_id, path, filename).
    """
    text = _signal_text(F.col("filename"))
    scored = []
    for order, (name, kind, risk, signals) in enumerate(fixed.FILE_CATEGORIES):
        words = [" " + s.replace("-", " ") + " " for s in signals]
        n = reduce(lambda a, b: a + b, [F.contains("_t", F.lit(w)).cast("int") for w in words]) if words else F.lit(0)
        scored.append(F.struct(
            n.alias("n"), F.lit(-order).alias("o"), F.lit(name).alias("category_id"), F.lit(kind).alias("kind"),
            F.lit(risk).alias("risk"),
        ))
    rows = files.withColumn("_t", text).withColumn("_b", F.array_max(F.array(*scored)))
    none = F.col("_b.n") == 0
    ext = F.lower(F.regexp_extract("filename", r"^.+(\.[^.]*)$", 1))
    return rows.select(
        "file_id",
        F.left(F.sha2("path", 256), F.lit(12)).alias("path_fingerprint"),
        ext.alias("extension"),
        F.when(none, "generic_text").otherwise(F.col("_b.category_id")).alias("category_id"),
        F.when(none, "summary").otherwise(F.col("_b.kind")).alias("recommended_memory_kind"),
        F.when(none, "low").otherwise(F.col("_b.risk")).alias("risk_level"),
        F.when(none, 0.35).otherwise(0.8).alias("confidence"),
        F.col("_b.n").alias("matched_signal_count"),
    )


def detect_schema(classified: DataFrame) -> DataFrame:
    """Counts per category, memory kind, extension and risk, as (facet, value, file_count, signals, review)."""
    facets = F.explode(F.array(*[
        F.struct(F.lit(f).alias("facet"), F.col(c).alias("value"))
        for f, c in (
            ("category", "category_id"), ("memory_kind", "recommended_memory_kind"), ("extension", "extension"),
            ("risk", "risk_level"),
        )
    ]))
    rows = classified.select(facets.alias("f"), "matched_signal_count", "risk_level")
    return rows.groupBy(F.col("f.facet").alias("facet"), F.col("f.value").alias("value")).agg(
        F.count("*").alias("file_count"),
        F.sum("matched_signal_count").alias("matched_signal_count"),
        F.when(F.max("matched_signal_count") > 0, 0.8).otherwise(0.35).alias("confidence"),
        F.bool_or((F.col("f.facet") == "category") & (F.col("risk_level") == "high")).alias("review_required"),
    )
