"""Typed memory: versioned facts per (workspace, key) with audit events and relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mnemolake.functions import fixed
from mnemolake.functions.dates import iso
from mnemolake.functions.hashing import short_hash
from mnemolake.functions.text import collapse_ws, preview, strip
from mnemolake.operators.common import bucketed_row_number, first_per, top_k
from mnemolake.operators.retrieval import bm25_search

KEY = ["workspace", "memory_key"]


def normalized(name: Column) -> Column:
    return F.replace(F.lower(strip(name)), F.lit("-"), F.lit("_"))


def render_text(kind: Column, state: Column, workspace: Column, key: Column, version: Column, content: Column) -> Column:
    """The stored text of a memory. It names the version, so a revision is a new text."""
    label = F.initcap(F.replace(kind, F.lit("_"), F.lit(" ")))
    return F.concat(
        label, F.lit(" memory ("), state, F.lit(")\nWorkspace: "), workspace, F.lit("\nMemory key: "), key,
        F.lit("\nVersion: "), version.cast("string"), F.lit("\n\n"), content,
    )


def value_hash(content: Column) -> Column:
    return F.sha2(collapse_ws(content), 256)


def is_expired(as_of: str) -> Column:
    return F.coalesce(F.col("expires_at") < F.lit(as_of).cast("timestamp"), F.lit(False))


def check_writes(writes: DataFrame) -> DataFrame:
    """Add ``problem``: why a write cannot be stored; empty text when it can."""
    blank = lambda c: F.coalesce(strip(F.col(c)) == "", F.lit(True))
    return writes.withColumn(
        "problem",
        F.when(~normalized(F.col("kind")).isin(*fixed.MEMORY_KINDS), "unsupported kind")
        .when(~normalized(F.col("state")).isin(*fixed.MEMORY_STATES), "unsupported state")
        .when(blank("content"), "empty content")
        .when(blank("workspace"), "empty workspace")
        .when(blank("actor"), "empty actor")
        .when(F.length(strip(F.col("memory_key"))) > 240, "key too long")
        .otherwise(""),
    )


def build_memories(writes: DataFrame, existing: DataFrame) -> DataFrame:
    """Turn valid writes into memory records with version, hashes and one audit event each.

    ``writes``: kind, state, content, workspace, actor, memory_key (may be null), ttl_days,
    source_document_id, reason, created_at, seq. The next version of a key is the stored maximum plus the
    write's place among the batch's writes of that key.
    """
    w = check_writes(writes).filter(F.col("problem") == "").drop("problem")
    w = w.select(
        "*",
        normalized(F.col("kind")).alias("_kind"),
        normalized(F.col("state")).alias("_state"),
        strip(F.col("content")).alias("_content"),
        strip(F.col("workspace")).alias("_workspace"),
        strip(F.col("actor")).alias("_actor"),
        F.nullif(strip(F.col("memory_key")), F.lit("")).alias("_key"),
    ).drop("kind", "state", "content", "workspace", "actor", "memory_key")
    for name in ("kind", "state", "content", "workspace", "actor"):
        w = w.withColumnRenamed(f"_{name}", name)
    seed = F.concat_ws(":", "workspace", "kind", "content")
    w = w.withColumn(
        "memory_key", F.coalesce("_key", F.concat("kind", F.lit(":"), short_hash(seed, 12)))
    ).drop("_key")
    stored = existing.groupBy(*KEY).agg(F.max("version").alias("_max"))
    w = bucketed_row_number(w, KEY, F.to_date("created_at"), [F.col("created_at"), F.col("seq")], "_nth")
    w = w.join(stored, KEY, "left")
    w = w.withColumn("version", F.coalesce("_max", F.lit(0)) + F.col("_nth")).drop("_max", "_nth")
    w = w.withColumn("value_hash", value_hash(F.col("content")))
    w = w.withColumn(
        "expires_at",
        F.when(F.coalesce("ttl_days", F.lit(0)) != 0, F.timestamp_add("DAY", F.col("ttl_days"), F.col("created_at"))),
    )
    w = w.withColumn("event_type", F.when(F.col("version") == 1, "memory.created").otherwise("memory.revised"))
    event_seed = F.concat_ws(
        ":", "workspace", "memory_key", "version", "event_type", iso(F.col("created_at")), "value_hash"
    )
    return w.select(
        "seq",
        "kind",
        "state",
        "content",
        "workspace",
        "actor",
        "memory_key",
        "version",
        "value_hash",
        "created_at",
        "expires_at",
        "source_document_id",
        "event_type",
        short_hash(event_seed, 24).alias("event_id"),
        "reason",
        F.concat(F.lit("typed_memory:"), "workspace", F.lit(":"), "memory_key").alias("source"),
        F.array_sort(F.array_distinct(F.array(F.lit("typed-memory"), "kind", "state"))).alias("topics"),
        render_text(
            F.col("kind"), F.col("state"), F.col("workspace"), F.col("memory_key"), F.col("version"), F.col("content")
        ).alias("text"),
    )


def memory_filter(
    memories: DataFrame,
    as_of: str,
    workspace: str | None = None,
    kind: str | None = None,
    memory_key: str | None = None,
    states: tuple[str, ...] = ("accepted",),
    include_expired: bool = False,
) -> DataFrame:
    """Governed view: accepted and unexpired unless asked otherwise."""
    rows = memories.withColumn("expired", is_expired(as_of)).filter(F.col("state").isin(*states))
    for column, wanted in (("workspace", workspace), ("kind", kind), ("memory_key", memory_key)):
        if wanted:
            rows = rows.filter(F.col(column) == wanted.strip())
    return rows if include_expired else rows.filter(~F.col("expired"))


def memory_search(
    memories: DataFrame, as_of: str, limit: int = 20, hits: DataFrame | None = None, queries: DataFrame | None = None, **filters
) -> DataFrame:
    """First ``limit`` governed records, newest first; with ``queries`` the best governed records of each by keywords.

    ``hits`` (query_id, doc_id, score) takes the scores of another search; records it does not hold are not found.
    """
    rows = memory_filter(memories, as_of, **filters).withColumn("content_preview", preview(F.col("content"), 500))
    if queries is not None:
        hits = bm25_search(queries, memories.select("doc_id", F.col("content").alias("text")), limit, among=rows)
    if hits is None:
        return rows.orderBy(F.desc("created_at"), F.asc("doc_id")).limit(limit)
    found = rows.join(hits.select("query_id", "doc_id", "score"), "doc_id")
    return top_k(found, ["query_id"], [F.desc("score"), F.asc("doc_id")], limit)


def memory_timeline(memories: DataFrame, as_of: str, keys: DataFrame | None = None) -> DataFrame:
    """Every version of the keys (all states, expired too) with its event and the key's current pointer.

    Ordered by key, version and time; unknown keys give one row with a reason.
    """
    rows = memories.withColumn("expired", is_expired(as_of))
    if keys is not None:
        rows = keys.select(*KEY).distinct().join(rows, KEY, "left")
    current = memory_current(memories, as_of).select(
        *KEY, F.col("version").alias("current_version"), F.col("state").alias("current_state")
    )
    found = F.col("doc_id").isNotNull()
    return (
        rows.join(current, KEY, "left")
        .select(
            *KEY,
            "doc_id",
            "version",
            "state",
            "expired",
            "created_at",
            F.when(found, F.when(F.col("version") == 1, "memory.created").otherwise("memory.revised")).alias("event_type"),
            value_hash(F.col("content")).alias("value_hash"),
            "current_version",
            "current_state",
            F.when(found, "").otherwise("memory_key_not_found").alias("reason_code"),
        )
        .orderBy(*KEY, "version", "created_at")
    )


def memory_current(memories: DataFrame, as_of: str) -> DataFrame:
    """Current record per key: accepted and unexpired, else unexpired, else any; then highest version."""
    rows = memories.withColumn("expired", is_expired(as_of))
    tier = F.when(F.col("expired"), 2).when(F.col("state") == "accepted", 0).otherwise(1)
    return first_per(rows, KEY, [tier, F.desc("version"), F.desc("created_at")])


# --- graph --------------------------------------------------------------------------------------------
def _relations(records: DataFrame) -> DataFrame:
    rel = records.select("workspace", "memory_key", "created_at", "doc_id", F.posexplode("relations").alias("pos", "r"))
    target = F.nullif(strip(F.col("r.target_key")), F.lit(""))
    kind = F.coalesce(F.nullif(strip(F.col("r.type")), F.lit("")), F.lit("related_to"))
    kind = F.replace(F.lower(kind), F.lit(" "), F.lit("_"))
    label = F.coalesce(F.nullif(F.col("r.label"), F.lit("")), F.replace(kind, F.lit("_"), F.lit(" ")))
    return rel.select(
        "workspace", "memory_key", "created_at", "doc_id", "pos", target.alias("target_key"), kind.alias("type"),
        label.alias("label"), F.col("r.label").alias("raw_label"),
    ).filter(F.col("target_key").isNotNull())


def centered(records: DataFrame, key: str) -> DataFrame:
    """Records of a key, of the keys it points to and of the keys that point to it."""
    rel = _relations(records).select("workspace", "memory_key", "target_key")
    ids = (
        records.filter(F.col("memory_key") == key).select(*KEY)
        .unionByName(rel.filter(F.col("memory_key") == key).select("workspace", F.col("target_key").alias("memory_key")))
        .unionByName(rel.filter(F.col("target_key") == key).select(*KEY))
        .distinct()
    )
    return records.join(ids, KEY, "left_semi")


def memory_graph(
    memories: DataFrame, as_of: str, center: str | None = None, **filters
) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the relation graph, one graph per workspace.

    For records of one key the newest gives the node; relation targets without a record become external
    nodes; an edge id is kept once, its newest relation gives the label.
    """
    records = memory_filter(memories, as_of, **filters)
    if center:
        records = centered(records, center)
    newest = F.struct("created_at", "doc_id")
    payload = F.struct("kind", "state", "version", "doc_id", preview(F.col("content"), 500).alias("label"))
    own = records.groupBy(*KEY).agg(F.max_by(payload, newest).alias("p"))
    memory_nodes = own.select(
        "workspace", F.concat(F.lit("memory:"), "memory_key").alias("id"), F.lit("memory").alias("type"), "p.kind",
        "p.state", "p.version", "p.label",
    )
    rel = _relations(records)
    outside = rel.join(own.select("workspace", F.col("memory_key").alias("target_key")), ["workspace", "target_key"], "left_anti")
    oldest = F.struct("created_at", "doc_id", "pos")
    external = (
        outside.groupBy("workspace", "target_key")
        .agg(F.min_by(F.coalesce(F.nullif("raw_label", F.lit("")), "target_key"), oldest).alias("label"))
        .select(
            "workspace", F.concat(F.lit("memory:"), "target_key").alias("id"), F.lit("external_memory").alias("type"),
            F.lit(None).cast("string").alias("kind"), F.lit("unknown").alias("state"),
            F.lit(None).cast("long").alias("version"), "label",
        )
    )
    sourced = records.filter("source_document_id is not null")
    document_id = F.concat(F.lit("document:"), "source_document_id")
    documents = sourced.select(
        "workspace", document_id.alias("id"), F.lit("source_document").alias("type"),
        F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("state"),
        F.lit(None).cast("long").alias("version"), F.concat(F.lit("Source document "), "source_document_id").alias("label"),
    ).distinct()
    nodes = memory_nodes.unionByName(external).unionByName(documents)

    source_id = F.concat(F.lit("memory:"), "memory_key")
    edges = rel.select(
        "workspace", source_id.alias("source"), F.concat(F.lit("memory:"), "target_key").alias("target"), "type", "label",
        F.struct("created_at", "doc_id", "pos").alias("o"),
    ).unionByName(
        sourced.select(
            "workspace", source_id.alias("source"), document_id.alias("target"), F.lit("source_document").alias("type"),
            F.lit("source document").alias("label"), F.struct("created_at", "doc_id", F.lit(-1).alias("pos")).alias("o"),
        )
    )
    edges = edges.groupBy("workspace", "source", "target", "type").agg(F.max_by("label", "o").alias("label"))
    edge_id = F.concat("source", F.lit("->"), "target", F.lit(":"), "type")
    return nodes, edges.select("workspace", edge_id.alias("id"), "source", "target", "type", "label")


# --- governance summaries -------------------------------------------------------------------------------
def workspace_info(memories: DataFrame, as_of: str) -> DataFrame:
    """Totals per workspace; one event per stored record."""
    rows = memories.withColumn("expired", is_expired(as_of))
    return rows.groupBy("workspace").agg(
        F.count("*").alias("total_record_count"),
        F.count_if((F.col("state") == "accepted") & ~F.col("expired")).alias("active_record_count"),
        F.count_if("expired").alias("expired_record_count"),
        F.count("*").alias("event_count"),
        F.min("created_at").alias("oldest_event_at"),
        F.max("created_at").alias("newest_event_at"),
    )


def workspace_counts(memories: DataFrame) -> DataFrame:
    """Counts by kind, state and actor as rows (workspace, facet, value, n)."""
    facets = F.explode(
        F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).alias("value")) for f in ("kind", "state", "actor")])
    )
    rows = memories.select("workspace", facets.alias("f")).filter("f.value is not null")
    return rows.groupBy("workspace", F.col("f.facet").alias("facet"), F.col("f.value").alias("value")).agg(
        F.count("*").alias("n")
    )


def actor_activity(
    memories: DataFrame, workspace: str | None = None, actor: str | None = None, limit: int | None = 50
) -> DataFrame:
    """Audit events, the newest ``limit`` in order, or all of them."""
    rows = memories
    if workspace:
        rows = rows.filter(F.col("workspace") == workspace)
    if actor:
        rows = rows.filter(F.col("actor") == actor)
    order = [F.desc("created_at"), F.desc("version"), F.asc("doc_id")]
    rows = rows.select("doc_id", "actor", *KEY, "version", "state", "kind", "created_at")
    return rows if limit is None else rows.orderBy(*order).limit(limit)


def activity_summary(activity: DataFrame) -> DataFrame:
    """Counts of the given events."""
    return activity.agg(
        F.count("*").alias("event_count"),
        F.count_distinct("actor").alias("actor_count"),
        F.count_distinct("memory_key").alias("memory_count"),
        F.min("created_at").alias("oldest_event_at"),
        F.max("created_at").alias("newest_event_at"),
    )
