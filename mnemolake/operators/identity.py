"""Content identity, duplicates and mutation of the document table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mnemolake.functions.hashing import body_text, content_hash, fingerprint
from mnemolake.functions.text import SPACE
from mnemolake.operators.common import first_per, with_group


def add_content_hash(docs: DataFrame) -> DataFrame:
    return docs.withColumn("content_hash", content_hash(F.col("text"), F.col("source")))


def dedupe_documents(new: DataFrame, existing: DataFrame | None = None, chunks: DataFrame | None = None) -> DataFrame:
    """Mark every new document that repeats an earlier one (in the batch, the store, or a stored chunk).

    The first occurrence wins; ``seq`` gives the order of arrival. The winner of each hash comes from
    an aggregate (copies collapse before the shuffle), so a text with very many copies stays cheap.
    """
    pick = ["doc_id", "seq", "content_hash"]
    rows = add_content_hash(new).withColumn("_tier", F.lit(1))
    stored = [
        add_content_hash(d).select(F.col("doc_id"), F.lit(0).alias("_tier"), F.col("seq"), "content_hash")
        for d in (existing, chunks)
        if d is not None
    ]
    pool = rows.select("doc_id", "_tier", "seq", "content_hash")
    for other in stored:
        pool = pool.unionByName(other)
    winners = pool.groupBy("content_hash").agg(
        F.min(F.struct("_tier", "seq", "doc_id")).alias("_winner")
    )
    joined = rows.select(*pick).join(winners, "content_hash")
    return joined.select(
        "doc_id",
        "content_hash",
        F.col("_winner.doc_id").alias("existing_id"),
        ((F.col("_winner._tier") == 0) | (F.col("_winner.doc_id") != F.col("doc_id"))).alias("is_duplicate"),
    )


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """One row per member of a group of two or more documents with the same normalized text.

    Members are rows, not a collected list: a group may hold a large share of the corpus.
    """
    # blank documents go first, and the fingerprint is never null: no filter computes it a second time
    some = F.rlike(body_text(F.col("text"), F.col("title")), F.lit(f"[^{SPACE[1:-1]}]"))
    rows = docs.filter(some).select("doc_id", "title", fingerprint(F.col("text"), F.col("title")).alias("fingerprint"))
    groups = (
        rows.groupBy("fingerprint")
        .agg(F.count("*").alias("group_size"), F.min("doc_id").alias("first_doc_id"))
        .filter("group_size >= 2")
    )
    return rows.join(groups, "fingerprint").select(
        F.concat(F.lit("duplicate_group:"), F.left("fingerprint", F.lit(12))).alias("group_id"),
        F.left("fingerprint", F.lit(16)).alias("fingerprint"),
        "doc_id",
        "title",
        "group_size",
        "first_doc_id",
    )


def dedupe_messages(messages: DataFrame, key_chars: int = 100) -> DataFrame:
    """Keep the first message per conversation, role and leading characters of its text."""
    keyed = messages.withColumn("_head", F.left("text", F.lit(key_chars)))
    return first_per(keyed, ["conv_id", "role", "_head"], [F.col("turn")]).drop("_head")


def merge_metadata(docs: DataFrame, updates: DataFrame, now: str) -> DataFrame:
    """Shallow overwrite of the metadata map; optional new text; stamps ``updated_at``.

    Several updates of one id are applied in the order of their ``seq`` column (without one they count as
    simultaneous and the largest value of a key wins): the last value of each key and the last text remain.
    """
    order = F.col("seq") if "seq" in updates.columns else F.lit(0)
    rows = updates.select("doc_id", order.alias("_seq"), "metadata", "text")
    keys = rows.select("doc_id", "_seq", F.explode("metadata").alias("k", "v"))
    last = keys.groupBy("doc_id", "k").agg(F.max(F.struct("_seq", "v")).alias("l"))
    maps = last.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "l.v"))).alias("_new"))
    texts = rows.groupBy("doc_id").agg(F.max(F.when(F.col("text").isNotNull(), F.struct("_seq", "text"))).alias("_t"))
    u = texts.join(maps, "doc_id", "left").select("doc_id", "_new", F.col("_t.text").alias("_text"))
    empty = F.create_map().cast("map<string,string>")
    merged = F.map_concat(
        F.coalesce("metadata", empty), F.coalesce("_new", empty), F.create_map(F.lit("updated_at"), F.lit(now))
    )
    hit = F.col("_hit").isNotNull()
    joined = docs.join(u.withColumn("_hit", F.lit(True)), "doc_id", "left")
    return joined.select(
        "doc_id",
        F.coalesce("_text", "text").alias("text"),
        F.when(hit, merged).otherwise(F.col("metadata")).alias("metadata"),
    )


def delete_documents(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Remove documents and the chunks that belong to them."""
    gone = ids.select(F.col("doc_id").alias("_gone")).distinct()
    own = F.coalesce(F.col("parent_id"), F.col("doc_id")) == F.col("_gone")
    return docs.join(gone, own, "left_anti").join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")


def undirected_edge_dedupe(edges: DataFrame) -> DataFrame:
    """Drop self loops; (a, b) and (b, a) are one edge."""
    return (
        edges.filter(F.col("a") != F.col("b"))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )


def group_sizes(docs: DataFrame, by: list[str]) -> DataFrame:
    return with_group(docs, by, F.count("*").alias("group_size"))
