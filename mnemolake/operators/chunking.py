"""Split long documents into overlapping chunks that end at sentence ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mnemolake.functions import fixed
from mnemolake.functions.text import let


def chunk_spans(text: Column, size: int, overlap: int) -> Column:
    """Array of (start, end) offsets.

    Each step looks back from ``start + size`` over the last fifth of the window for . ! ? or a line
    break and ends the chunk right after the last one found; the next chunk starts ``overlap`` earlier.
    """
    floor = size * 4 // 5  # no boundary is accepted at or before start + floor
    shortest = floor + 2 - overlap
    if shortest <= 0:
        raise ValueError("overlap must be smaller than the shortest chunk")
    state = "struct<pos:int,done:boolean,spans:array<struct<start:int,end:int>>>"
    zero = F.struct(
        F.lit(0).alias("pos"),
        F.lit(False).alias("done"),
        F.array().cast("array<struct<start:int,end:int>>").alias("spans"),
    ).cast(state)

    def spans(length: Column) -> Column:
        def step(acc: Column, _: Column) -> Column:
            pos = acc["pos"]
            hard = pos + size
            tail = F.substring(text, pos + floor + 2, F.lit(size - floor))
            mark = F.when(hard < length, F.length(F.regexp_extract(tail, r"(?s)^.*[.!?\n]", 0)))
            end = let(
                mark,
                lambda m: F.when(m.isNull(), length).when(m > 0, pos + floor + 1 + m).otherwise(hard).cast("int"),
            )
            moved = let(
                end,
                lambda e: F.struct(
                    (e - overlap).alias("pos"),
                    (e >= length).alias("done"),
                    F.array_append(acc["spans"], F.struct(pos.alias("start"), e.alias("end"))).alias("spans"),
                ).cast(state),
            )
            return F.when(acc["done"], acc).otherwise(moved)

        steps = F.sequence(F.lit(0), F.floor(length / shortest).cast("int") + 1)
        return F.aggregate(steps, zero, step)["spans"]

    return let(F.length(text), spans)


def chunk_documents(
    docs: DataFrame,
    threshold: int = fixed.CHUNK_THRESHOLD,
    size: int = fixed.CHUNK_SIZE,
    overlap: int = fixed.CHUNK_OVERLAP,
) -> DataFrame:
    """Chunks of all documents longer than ``threshold``. No shuffle: every document is cut in place."""
    long_docs = docs.filter(F.length("text") > threshold)
    spans = long_docs.select(
        F.col("doc_id").alias("parent_id"),
        "text",
        F.posexplode_outer(chunk_spans(F.col("text"), size, overlap)).alias("chunk_index", "span"),
    )
    return spans.select(
        F.concat_ws("#", "parent_id", "chunk_index").alias("chunk_id"),
        "parent_id",
        "chunk_index",
        F.col("span.start").alias("char_start"),
        F.col("span.end").alias("char_end"),
        F.col("text").substr(F.col("span.start") + 1, F.col("span.end") - F.col("span.start")).alias("text"),
    )


def chunk_parents(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per chunked parent: number of chunks, full length and chunk ids in order.

    A parent's id list is as long as its own text allows, so it stays within one row.
    """
    listed = chunks.groupBy("parent_id").agg(
        F.count("*").alias("chunk_count"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id"))), lambda c: c["chunk_id"]
        ).alias("chunk_ids"),
    )
    return (
        docs.select(F.col("doc_id").alias("parent_id"), F.length("text").alias("full_text_length"))
        .join(listed, "parent_id")
        .withColumn("is_parent", F.lit(True))
    )


def document_chunks(chunks: DataFrame, parents: DataFrame) -> DataFrame:
    """Chunks of the given parents, ordered by parent and position."""
    return chunks.join(parents.select("parent_id").distinct(), "parent_id", "left_semi").orderBy(
        "parent_id", "chunk_index"
    )
