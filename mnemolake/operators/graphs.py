"""Knowledge graph of documents, topics and entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mnemolake.operators.common import top_k

TYPE_ORDER = ("person", "organization", "location", "technology")


def knowledge_graph(
    docs: DataFrame,
    entities: DataFrame,
    min_connections: int = 2,
    limit_documents: int | None = None,
    entities_per_type: int = 15,
    topic_edges_per_doc: int = 3,
    entity_edges_per_doc: int = 5,
) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges. Ties break by name.

    ``docs`` (doc_id, title, topics), ``entities`` (doc_id, entity_type, name). The best entities per type are
    picked before the minimum of connections applies; a document's entity edges go to persons first, then
    organizations, locations and technologies, most connected first.
    """
    if limit_documents is not None:
        docs = docs.orderBy(F.desc_nulls_last("doc_date"), F.asc("doc_id")).limit(limit_documents)
    ids = docs.select("doc_id")
    topic = F.explode_outer(F.transform("topics", lambda x: F.lower(x)))
    has_topic = docs.select("doc_id", topic.alias("name")).filter("name is not null and trim(name) <> ''").distinct()
    topics = has_topic.groupBy("name").agg(F.count("*").alias("n")).filter(F.col("n") >= min_connections)
    topic_edges = top_k(has_topic.join(topics, "name"), ["doc_id"], [F.desc("n"), F.asc("name")], topic_edges_per_doc, "r").select(
        F.concat(F.lit("topic_"), "name").alias("source"), "doc_id", F.lit("has_topic").alias("type")
    )
    has_entity = entities.join(ids, "doc_id", "left_semi").select(
        "doc_id", "entity_type", F.lower(F.trim("name")).alias("name")
    ).filter("name <> ''").distinct()
    counted = has_entity.groupBy("entity_type", "name").agg(F.count("*").alias("n"))
    picked = top_k(counted, ["entity_type"], [F.desc("n"), F.asc("name")], entities_per_type, "r").drop("r")
    picked = picked.filter(F.col("n") >= min_connections)
    order = F.array_position(F.array(*[F.lit(x) for x in TYPE_ORDER]), F.col("entity_type"))
    entity_edges = top_k(
        has_entity.join(picked, ["entity_type", "name"]).withColumn("o", order), ["doc_id"],
        [F.col("o"), F.desc("n"), F.asc("name")], entity_edges_per_doc, "r",
    ).select(
        F.concat("entity_type", F.lit("_"), "name").alias("source"), "doc_id", F.concat(F.lit("has_"), "entity_type").alias("type")
    )
    edges = topic_edges.unionByName(entity_edges).select("source", F.concat(F.lit("doc_"), "doc_id").alias("target"), "type")
    nodes = (
        docs.select(F.concat(F.lit("doc_"), "doc_id").alias("id"), F.col("title").alias("label"), F.lit("document").alias("type"), F.lit(0).cast("long").alias("n"))
        .unionByName(topics.select(F.concat(F.lit("topic_"), "name").alias("id"), F.initcap("name").alias("label"), F.lit("topic").alias("type"), "n"))
        .unionByName(picked.select(F.concat("entity_type", F.lit("_"), "name").alias("id"), F.initcap("name").alias("label"), F.col("entity_type").alias("type"), "n"))
    )
    ends = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id")))
    degree = ends.groupBy("id").agg(F.count("*").alias("degree"))
    nodes = nodes.join(degree, "id", "left").select(
        "id", "label", "type", F.coalesce("degree", "n").alias("connection_count")
    )
    return nodes, edges


def graph_facets(filters: DataFrame) -> DataFrame:
    """Documents per content type and domain."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in ("content_type", "domain")]))
    return filters.select(each.alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


def graph_focus(edges: DataFrame, chosen: DataFrame, max_edges: int) -> DataFrame:
    """Edges touching chosen nodes, at most ``max_edges`` per endpoint in input order.

    Order-free form: an edge stays if it is among the first of both of its endpoints.
    """
    ids = chosen.select("id").distinct()
    left = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
    right = edges.join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    touching = left.unionByName(right).distinct()
    a = top_k(touching, ["source"], [F.col("target"), F.col("type")], max_edges, "ra").drop("ra")
    b = top_k(touching, ["target"], [F.col("source"), F.col("type")], max_edges, "rb").drop("rb")
    return a.join(b, ["source", "target", "type"], "left_semi")


def document_details(docs: DataFrame, chunks: DataFrame, lists: DataFrame) -> DataFrame:
    """Per document: chunks, characters with chunks, topics and entity counts."""
    parts = chunks.groupBy(F.col("parent_id").alias("doc_id")).agg(
        F.count("*").alias("chunk_count"), F.sum(F.length("text")).alias("chunk_chars")
    )
    j = docs.join(parts, "doc_id", "left").join(lists, "doc_id", "left")
    zero = F.lit(0)
    return j.select(
        F.concat(F.lit("doc_"), "doc_id").alias("id"), F.col("title").alias("label"),
        F.coalesce("chunk_count", zero).alias("chunk_count"),
        (F.length("text") + F.coalesce("chunk_chars", zero)).alias("text_length"),
        F.array_sort("topics").alias("topics"),
        F.coalesce(F.size("organizations"), zero).alias("organizations"),
        F.coalesce(F.size("locations"), zero).alias("locations"),
    )


def name_details(mentions: DataFrame, samples: int = 5) -> DataFrame:
    """Per topic or entity: number of documents and the first few of them.

    ``mentions`` (kind, name, doc_id). Samples are ranked rows, so a name of very many documents is not
    collected.
    """
    each = mentions.select("kind", F.lower("name").alias("name"), "doc_id").distinct()
    counts = each.groupBy("kind", "name").agg(F.count("*").alias("document_count"))
    few = top_k(each, ["kind", "name"], [F.asc("doc_id")], samples)
    listed = few.groupBy("kind", "name").agg(F.array_sort(F.collect_list("doc_id")).alias("sample_documents"))
    return counts.join(listed, ["kind", "name"])
