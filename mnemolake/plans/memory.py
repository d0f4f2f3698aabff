"""Typed-memory queries over the conversation table."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemolake.operators import identity, memory as m
from mnemolake.plans.retrieval import bm25_sql, topk
from mnemolake.plans.views import Registry, sql

registry = Registry()
add = registry.add

AS_OF = "2026-06-01 12:00:00"
NOW = f"TIMESTAMP '{AS_OF}'"
EXPIRED = f"coalesce(expires_at < {NOW}, false)"
FLAT = r"trim(regexp_replace(content, '\s+', ' ', 'g'))"
STRIPPED = r"regexp_replace(content, '^\s+|\s+$', '', 'g')"


def when(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S') AS {column}"


def preview(limit: int) -> str:
    return f"CASE WHEN length({FLAT}) <= {limit} THEN {FLAT} ELSE rtrim(left({FLAT}, {limit - 3})) || '...' END"


def writes(t):
    """Later turns arrive as writes; assistants give no key; the kind comes in mixed spelling."""
    conv = F.col("conv_id")
    return t.memories.filter("turn >= 2").select(
        F.col("doc_id").alias("seq"),
        F.concat(F.initcap(F.replace("kind", F.lit("_"), F.lit("-"))), F.lit(" ")).alias("kind"),
        F.upper("state").alias("state"),
        "content",
        "workspace",
        "actor",
        F.when(F.col("actor") != "assistant", F.col("memory_key")).alias("memory_key"),
        F.when(conv % 5 == 0, 30).alias("ttl_days"),
        "source_document_id",
        F.lit("captured").alias("reason"),
        "created_at",
    )


@add(
    "build_memories",
    sql(
        "memory_v",
        rf"""w AS (SELECT doc_id AS seq, kind, state, {STRIPPED} AS content, workspace, actor, conv_id, created_at,
            CASE WHEN actor <> 'assistant' THEN memory_key
                 ELSE kind || ':' || left(sha256(workspace || ':' || kind || ':' || {STRIPPED}), 12) END AS memory_key
            FROM memory_v WHERE turn >= 2),
        s AS (SELECT workspace, memory_key, max(version) AS mv FROM memory_v WHERE turn < 2 GROUP BY ALL),
        v AS (SELECT w.*, coalesce(mv, 0) + row_number() OVER (PARTITION BY w.workspace, w.memory_key
            ORDER BY created_at, seq) AS version, sha256({FLAT}) AS value_hash FROM w LEFT JOIN s USING (workspace, memory_key)),
        e AS (SELECT *, CASE WHEN version = 1 THEN 'memory.created' ELSE 'memory.revised' END AS event_type FROM v)
        SELECT seq, kind, state, workspace, memory_key, version, value_hash, event_type,
        left(sha256(workspace || ':' || memory_key || ':' || version || ':' || event_type || ':' ||
            strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') || ':' || value_hash), 24) AS event_id,
        coalesce(CASE WHEN conv_id % 5 = 0 THEN strftime(created_at + INTERVAL 30 DAY, '%Y-%m-%d %H:%M:%S') END, '') AS expires_at,
        array_to_string(list_sort([kind, state, 'typed-memory']), '|') AS topics,
        array_to_string(list_transform(string_split(kind, '_'), lambda x: upper(x[1]) || x[2:]), ' ') || ' memory (' || state
        || ')' || chr(10) || 'Workspace: ' || workspace || chr(10) || 'Memory key: ' || memory_key || chr(10) ||
        'Version: ' || version || chr(10) || chr(10) || content AS text FROM e""",
    ),
)
def _(t):
    out = m.build_memories(writes(t), t.memories.filter("turn < 2"))
    expires = F.coalesce(F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("expires_at")
    return out.select(
        "seq", "kind", "state", "workspace", "memory_key", "version", "value_hash", "event_type", "event_id", expires,
        "topics", "text",
    )


@add(
    "memory_search",
    sql(
        "memory_v",
        f"""SELECT doc_id, kind, memory_key, version, {when('created_at')}, {preview(500)} AS content_preview FROM memory_v
        WHERE workspace = 'ws1' AND state IN ('accepted', 'candidate') AND NOT {EXPIRED}
        ORDER BY memory_v.created_at DESC, doc_id LIMIT 20""",
    ),
)
def _(t):
    out = m.memory_search(t.memories, AS_OF, workspace="ws1", states=("accepted", "candidate"))
    return out.select("doc_id", "kind", "memory_key", "version", "created_at", "content_preview")


@add(
    "memory_search_ranked",
    sql(
        "queries_v memory_v",
        f"""mem AS (SELECT doc_id, content AS text FROM memory_v), {bm25_sql('mem')},
        ok AS (SELECT query_id, doc_id, bm.score FROM bm JOIN memory_v USING (doc_id)
            WHERE state = 'accepted' AND NOT {EXPIRED})
        SELECT query_id, doc_id, score, rank FROM ({topk('ok', 20)})""",
    ),
)
def _(t):
    return m.memory_search(t.memories, AS_OF, 20, queries=t.queries).select("query_id", "doc_id", "score", "rank")


CURRENT = f"""cur AS (SELECT * FROM memory_v QUALIFY row_number() OVER (PARTITION BY workspace, memory_key ORDER BY
    CASE WHEN {EXPIRED} THEN 2 WHEN state = 'accepted' THEN 0 ELSE 1 END, version DESC, created_at DESC) = 1)"""


@add(
    "memory_timeline",
    sql(
        "memory_v",
        f"""{CURRENT} SELECT a.workspace, a.memory_key, a.doc_id, a.version, a.state, {EXPIRED.replace('expires_at', 'a.expires_at')} AS expired,
        strftime(a.created_at, '%Y-%m-%d %H:%M:%S') AS created_at,
        CASE WHEN a.version = 1 THEN 'memory.created' ELSE 'memory.revised' END AS event_type,
        sha256({FLAT.replace('content', 'a.content')}) AS value_hash, cur.version AS current_version,
        cur.state AS current_state, '' AS reason_code
        FROM memory_v a JOIN cur USING (workspace, memory_key)""",
    ),
)
def _(t):
    return m.memory_timeline(t.memories, AS_OF)


@add(
    "memory_current",
    sql("memory_v", f"{CURRENT} SELECT workspace, memory_key, doc_id, version, state, {EXPIRED} AS expired FROM cur"),
)
def _(t):
    return m.memory_current(t.memories, AS_OF).select("workspace", "memory_key", "doc_id", "version", "state", "expired")


def with_relations(t):
    rel = F.struct(
        F.col("target_key").alias("target_key"),
        F.when(F.col("turn") == 1, F.lit("Depends On")).alias("type"),
        F.lit(None).cast("string").alias("label"),
    )
    none = F.array().cast("array<struct<target_key:string,type:string,label:string>>")
    return t.memories.withColumn("relations", F.when(F.col("target_key").isNotNull(), F.array(rel)).otherwise(none))


GRAPH = f"""rec AS (SELECT * FROM memory_v WHERE state = 'accepted' AND NOT {EXPIRED}),
    rel AS (SELECT *, CASE WHEN turn = 1 THEN 'depends_on' ELSE 'related_to' END AS etype FROM rec WHERE target_key IS NOT NULL)"""
NODES = f"""own AS (SELECT * FROM rec QUALIFY row_number() OVER (PARTITION BY workspace, memory_key
        ORDER BY created_at DESC, doc_id DESC) = 1)
    SELECT workspace, 'memory:' || memory_key AS id, 'memory' AS type, kind, state, version, {preview(500)} AS label FROM own
    UNION ALL SELECT DISTINCT workspace, 'memory:' || target_key, 'external_memory', '', 'unknown', 0, target_key FROM rel
        WHERE (workspace, target_key) NOT IN (SELECT (workspace, memory_key) FROM rec)
    UNION ALL SELECT DISTINCT workspace, 'document:' || source_document_id, 'source_document', '', '', 0,
        'Source document ' || source_document_id FROM rec WHERE source_document_id IS NOT NULL"""
EDGES = """e AS (SELECT DISTINCT workspace, 'memory:' || memory_key AS source, 'memory:' || target_key AS target, etype AS type,
        replace(etype, '_', ' ') AS label FROM rel
    UNION SELECT workspace, 'memory:' || memory_key, 'document:' || source_document_id, 'source_document', 'source document'
        FROM rec WHERE source_document_id IS NOT NULL)
    SELECT workspace, source || '->' || target || ':' || type AS id, source, target, type, label FROM e"""


def shown(nodes):
    return nodes.fillna({"kind": "", "state": "", "version": 0})


@add("memory_graph_nodes", sql("memory_v", f"{GRAPH}, {NODES}"))
def _(t):
    return shown(m.memory_graph(with_relations(t), AS_OF)[0])


@add("memory_graph", sql("memory_v", f"{GRAPH}, {EDGES}"))
def _(t):
    return m.memory_graph(with_relations(t), AS_OF)[1]


CENTER = GRAPH.replace("rec AS", "all_rec AS").replace("FROM rec WHERE target_key", "FROM all_rec WHERE target_key").replace(
    "rel AS", "all_rel AS"
) + """, ids AS (SELECT workspace, memory_key FROM all_rec WHERE memory_key = 'key/3'
    UNION SELECT workspace, target_key FROM all_rel WHERE memory_key = 'key/3'
    UNION SELECT workspace, memory_key FROM all_rel WHERE target_key = 'key/3'),
    rec AS (SELECT * FROM all_rec WHERE (workspace, memory_key) IN (SELECT (workspace, memory_key) FROM ids)),
    rel AS (SELECT * FROM all_rel WHERE (workspace, memory_key) IN (SELECT (workspace, memory_key) FROM ids))"""


@add("memory_graph_centered", sql("memory_v", f"{CENTER}, {EDGES}"))
def _(t):
    return m.memory_graph(with_relations(t), AS_OF, center="key/3")[1]


@add(
    "workspace_info",
    sql(
        "memory_v",
        f"""SELECT workspace, count(*) AS total_record_count,
        count(*) FILTER (state = 'accepted' AND NOT {EXPIRED}) AS active_record_count,
        count(*) FILTER ({EXPIRED}) AS expired_record_count, count(*) AS event_count,
        strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS oldest_event_at,
        strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS newest_event_at FROM memory_v GROUP BY workspace""",
    ),
)
def _(t):
    return m.workspace_info(t.memories, AS_OF)


@add(
    "workspace_counts",
    sql(
        "memory_v",
        """SELECT workspace, 'kind' AS facet, kind AS value, count(*) AS n FROM memory_v GROUP BY ALL
        UNION ALL SELECT workspace, 'state', state, count(*) FROM memory_v GROUP BY ALL
        UNION ALL SELECT workspace, 'actor', actor, count(*) FROM memory_v GROUP BY ALL""",
    ),
)
def _(t):
    return m.workspace_counts(t.memories)


ACTIVITY = """act AS (SELECT doc_id, actor, workspace, memory_key, version, state, kind, created_at FROM memory_v
    WHERE actor = 'user' ORDER BY created_at DESC, version DESC, doc_id LIMIT 50)"""


@add(
    "actor_activity",
    sql("memory_v", f"{ACTIVITY} SELECT doc_id, actor, workspace, memory_key, version, state, kind, {when('created_at')} FROM act"),
)
def _(t):
    return m.actor_activity(t.memories, actor="user")


@add(
    "actor_activity_summary",
    sql(
        "memory_v",
        f"""SELECT count(*) AS event_count, count(DISTINCT actor) AS actor_count,
        count(DISTINCT memory_key) AS memory_count, strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS oldest_event_at,
        strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS newest_event_at FROM memory_v WHERE actor = 'user'""",
    ),
)
def _(t):
    return m.activity_summary(m.actor_activity(t.memories, actor="user", limit=None))


@add(
    "memory_write_dedupe",
    sql("memory_v", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, turn < 2 AS is_duplicate FROM memory_v"),
)
def _(t):
    text = m.render_text(*[F.col(c) for c in ("kind", "state", "workspace", "memory_key", "version", "content")])
    source = F.concat(F.lit("typed_memory:"), "workspace", F.lit(":"), "memory_key")
    rows = t.memories.select(
        F.col("doc_id").cast("string").alias("doc_id"), F.col("doc_id").alias("seq"), text.alias("text"),
        source.alias("source"), "turn",
    )
    # the early turns are stored; all turns are written again: a replay repeats its version, a revision does not
    return identity.dedupe_documents(rows.drop("turn"), rows.filter("turn < 2").drop("turn")).select(
        "doc_id", "is_duplicate"
    )
