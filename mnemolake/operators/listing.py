"""Listing, lookups, corpus counts and safe projections."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from mnemolake.functions import fixed
from mnemolake.functions.text import clean_excerpt, preview


def list_documents(
    docs: DataFrame, page: int = 1, page_size: int = 20, sort_by: str = "created_at", descending: bool = True
) -> DataFrame:
    """One page of the listing. Ids are compared as text when sorting by id; ties break by id."""
    key = F.col("doc_id").cast("string") if sort_by == "id" else F.col(sort_by)
    order = key.desc_nulls_last() if descending else key.asc_nulls_last()
    return docs.orderBy(order, F.col("doc_id")).offset((page - 1) * page_size).limit(page_size)


def list_documents_after(
    docs: DataFrame, last_value, last_id, page_size: int = 20, sort_by: str = "created_at"
) -> DataFrame:
    """Next page after a known row (descending): deep pages need no skipped rows."""
    key = F.col(sort_by)
    after = (key < F.lit(last_value)) | ((key == F.lit(last_value)) & (F.col("doc_id") > F.lit(last_id)))
    return docs.filter(after).orderBy(key.desc_nulls_last(), F.col("doc_id")).limit(page_size)


def page_stats(docs: DataFrame, page: int, page_size: int) -> DataFrame:
    """Totals of a paged listing in one row."""
    total = docs.agg(F.count("*").alias("total"))
    pages = F.greatest(F.ceil(F.col("total") / page_size), F.lit(1))
    return total.select(
        "total",
        F.lit(page).alias("page"),
        F.lit(page_size).alias("page_size"),
        pages.alias("total_pages"),
        (F.lit(page) < pages).alias("has_next"),
        F.lit(page > 1).alias("has_prev"),
    )


def get_documents(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")


def documents_chronological(docs: DataFrame, date_column: str = "created_at") -> DataFrame:
    return docs.orderBy(F.col(date_column).asc_nulls_first(), F.col("doc_id"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    return docs.agg(
        F.count("*").alias("document_count"), F.count_distinct("content_hash").alias("unique_hashes")
    )


def previews(docs: DataFrame) -> DataFrame:
    """The three preview lengths in use: memory, maintenance, cited excerpt."""
    text = F.col("text")
    return docs.select(
        "doc_id",
        preview(text, 500).alias("memory_preview"),
        preview(text, 280).alias("maintenance_preview"),
        clean_excerpt(text).alias("excerpt"),
    )


def sanitize_map(metadata: Column, drop_people: bool = True) -> Column:
    """Drop session keys (and person lists) from an open metadata map."""
    banned = fixed.PII_SESSION_KEYS + (fixed.PERSON_KEYS if drop_people else ())
    return F.map_filter(metadata, lambda k, _: ~k.isin(*banned))


def sanitize_json(text: Column, drop_people: bool = True) -> Column:
    """The same for a JSON text, at any depth: object members with a banned key disappear, whatever their value.

    Only texts that name a banned key (or escape characters, which could hide one) are parsed, in Arrow batches. Of
    those, texts that are no valid JSON become null rather than leak.
    """
    banned = frozenset(fixed.PII_SESSION_KEYS + (fixed.PERSON_KEYS if drop_people else ()))

    def clean(value):
        if isinstance(value, dict):
            return {k: clean(v) for k, v in value.items() if k not in banned}
        return [clean(v) for v in value] if isinstance(value, list) else value

    def one(raw):
        try:
            return None if raw is None else json.dumps(clean(json.loads(raw)), ensure_ascii=False)
        except (ValueError, RecursionError):
            return None

    @F.pandas_udf("string")
    def parsed(texts: pd.Series) -> pd.Series:
        return pd.Series([one(t) for t in texts], dtype=object)

    names = "|".join(f'"{key}"' for key in sorted(banned))
    return F.when(text.rlike(names + r"|\\u"), parsed(text)).otherwise(text)


def context_metadata(metadata: Column, context: str = "llm") -> Column:
    """Metadata for model context: when it has personal data, redacted paths replace originals."""
    if context != "llm":
        return metadata
    empty = F.create_map().cast("map<string,string>")

    def swap(redacted: str, shown: str) -> Column:
        return F.when(
            F.map_contains_key(metadata, redacted), F.create_map(F.lit(shown), metadata[redacted])
        ).otherwise(empty)

    def dropped(key: Column) -> Column:
        return (
            (key == "original_transcript")
            | ((key == "original_image_path") & F.map_contains_key(metadata, "redacted_image_path"))
            | ((key == "original_audio_path") & F.map_contains_key(metadata, "redacted_audio_path"))
        )

    safe = F.map_concat(
        F.map_filter(metadata, lambda k, _: ~dropped(k)),
        swap("redacted_image_path", "image_path"),
        swap("redacted_audio_path", "audio_path"),
    )
    return F.when(F.lower(metadata["has_pii"]) == "true", safe).otherwise(metadata)


PUBLIC_MEMORY_COLUMNS = (
    "doc_id", "kind", "workspace", "memory_key", "state", "version", "value_hash", "created_at", "expires_at",
    "expired", "score", "content_preview",
)
PUBLIC_SUMMARY_COLUMNS = (
    "kind", "workspace", "memory_key", "state", "version", "value_hash", "created_at", "expires_at",
    "source_document_id",
)


def public_memory_view(memories: DataFrame) -> DataFrame:
    """Memory columns that may leave the system."""
    return memories.select(*[c for c in PUBLIC_MEMORY_COLUMNS if c in memories.columns])


def public_memory_summary(memories: DataFrame) -> DataFrame:
    """Memory metadata without content or relation payloads."""
    count = F.coalesce(F.size("relations"), F.lit(0))
    return memories.select(*PUBLIC_SUMMARY_COLUMNS, F.greatest(count, F.lit(0)).alias("relation_count"))
