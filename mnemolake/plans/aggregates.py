"""Counts over documents, conversations and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemolake.functions import fixed
from mnemolake.operators import aggregates as a, retrieval as r
from mnemolake.plans.views import Registry, sql

registry = Registry()
add = registry.add


@add("topic_counts", sql("docs_v", "SELECT topic, count(*) AS n FROM (SELECT unnest(topics) AS topic FROM docs_v) GROUP BY topic"))
def _(t):
    return a.topic_counts(t.docs)


@add("topic_network", sql("docs_v", "SELECT topic, count(*) AS n FROM (SELECT unnest(topics) AS topic FROM docs_v) GROUP BY topic"))
def _(t):
    return a.topic_counts(t.docs)


@add(
    "documents_by_topic",
    sql("docs_v", "SELECT doc_id, title FROM docs_v WHERE list_contains(topics, 'de') ORDER BY doc_id LIMIT 20 OFFSET 20"),
)
def _(t):
    return a.documents_by_topic(t.docs, "DE", 2).select("doc_id", "title")


@add(
    "find_by_entity",
    sql("entities_v", "SELECT DISTINCT doc_id FROM entities_v WHERE entity_type = 'organization' AND lower(name) = 'lichkeit' OR entity_type = 'location' AND lower(name) = 'thating'"),
)
def _(t):
    found = a.find_by_entity(t.entity_lists, "organizations", "LichKeit")
    return found.unionByName(a.find_by_entity(t.entity_lists, "locations", "Thating")).select("doc_id").distinct()


SITE = "CASE conv_id % 2 WHEN 0 THEN 'chatgpt' ELSE 'claude' END"
TS = "TIMESTAMP '2026-01-01' + CAST(conv_id * 10 + turn AS INTEGER) * INTERVAL 1 HOUR"


def messages(t):
    site = F.when(F.col("conv_id") % 2 == 0, "chatgpt").otherwise("claude")
    ts = F.timestamp_add("HOUR", (F.col("conv_id") * 10 + F.col("turn")).cast("int"), F.lit("2026-01-01").cast("timestamp"))
    return t.conversations.withColumn("site", site).withColumn("ts", ts)


@add(
    "capture_stats",
    f"""WITH s AS (SELECT unnest(['chatgpt', 'claude', 'gemini']) AS site), m AS (SELECT {SITE} AS site, conv_id FROM conversations),
    r AS (SELECT s.site, count(DISTINCT conv_id) AS conversations, count(conv_id) AS messages FROM s LEFT JOIN m USING (site) GROUP BY s.site)
    SELECT * FROM r UNION ALL SELECT 'all', sum(conversations)::BIGINT, sum(messages)::BIGINT FROM r""",
)
def _(t):
    sites = t.spark.createDataFrame(list(fixed.CAPTURE_SITES), "site string, site_name string")
    return a.capture_stats(messages(t), sites)


@add(
    "conversation_documents",
    f"""WITH b AS (SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN '**User:**' ELSE '**Assistant:**' END || chr(10) || text || chr(10),
        chr(10) ORDER BY turn) AS body, count(*) AS message_count, strftime(max({TS}), '%Y-%m-%dT%H:%M:%SZ') AS cap FROM conversations GROUP BY conv_id)
    SELECT conv_id, 0 AS part, '# Chat ' || conv_id || chr(10) || chr(10) || '**Source:** ' || CASE conv_id % 2 WHEN 0 THEN 'ChatGPT' ELSE 'Claude' END
    || ' Conversation' || chr(10) || '**URL:** https://chat.example.com/c/' || conv_id || chr(10) || '**Captured:** ' || cap || chr(10) || chr(10)
    || '---' || chr(10) || chr(10) || body AS text, message_count FROM b""",
)
def _(t):
    msgs = messages(t)
    names = t.spark.createDataFrame(list(fixed.CAPTURE_SITES), "site string, site_name string")
    heads = (
        msgs.groupBy("conv_id", "site").agg(F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured"))
        .join(names, "site")
        .select(
            "conv_id", F.concat(F.lit("Chat "), "conv_id").alias("title"), "site_name",
            F.concat(F.lit("https://chat.example.com/c/"), "conv_id").alias("url"), "captured",
        )
    )
    return a.conversation_documents(msgs, heads)


@add(
    "list_conversations",
    f"""SELECT conv_id, {SITE} AS site, strftime(max({TS}), '%Y-%m-%d %H:%M:%S') AS updated_at, count(*) AS message_count
    FROM conversations WHERE {SITE} = 'claude' GROUP BY conv_id ORDER BY max({TS}) DESC, conv_id LIMIT 10 OFFSET 5""",
)
def _(t):
    return a.list_conversations(messages(t), "claude", 10, 5)


@add(
    "source_stats",
    """SELECT sum(items)::BIGINT AS item_count, sum(bytes)::BIGINT AS total_bytes, count(*) AS source_count
    FROM (SELECT source, count(*) AS items, sum(strlen(text)) AS bytes FROM documents GROUP BY source)""",
)
def _(t):
    per = t.documents.groupBy("source").agg(F.count("*").alias("items"), F.sum(F.octet_length("text")).alias("bytes"))
    return a.source_stats(per)


# file names made of a signal word per document: each category occurs, some names carry two signals
SIGNALS = [s for _, _, _, signals in fixed.FILE_CATEGORIES for s in signals]
NAMES = "[" + ", ".join(f"'{s}'" for s in SIGNALS) + "]"
FILES = f"""files AS (SELECT doc_id AS file_id, 'in/' || f AS path, f AS filename FROM (SELECT doc_id,
    {NAMES}[1 + doc_id % {len(SIGNALS)}] || '_' || CASE WHEN doc_id % 3 = 0 THEN {NAMES}[1 + (doc_id * 7) % {len(SIGNALS)}] ELSE 'x' || source END
    || CASE WHEN doc_id % 2 = 0 THEN '.PDF' ELSE '.txt' END AS f FROM documents))"""
PAD = r"' ' || regexp_replace(lower(filename), '[^\p{L}\p{N}]', ' ', 'g') || ' '"


def _count(signals) -> str:
    return " + ".join(f"CAST(contains(t, ' {s.replace('-', ' ')} ') AS INTEGER)" for s in signals) or "0"


CLASSIFY = f"""{FILES}, c AS (SELECT *, {', '.join(f'{_count(s)} AS n_{n}' for n, _, _, s in fixed.FILE_CATEGORIES)}
        FROM (SELECT *, {PAD} AS t FROM files)),
    g AS (SELECT *, greatest({', '.join('n_' + n for n, *_ in fixed.FILE_CATEGORIES)}) AS n FROM c),
    k AS (SELECT *, CASE WHEN n = 0 THEN 'generic_text' {' '.join(f"WHEN n_{n} = n THEN '{n}'" for n, *_ in fixed.FILE_CATEGORIES)} END AS category_id FROM g),
    cl AS (SELECT file_id, left(sha256(path), 12) AS path_fingerprint, lower(regexp_extract(filename, '^.+(\\.[^.]*)$', 1)) AS extension, category_id,
        CASE category_id {' '.join(f"WHEN '{n}' THEN '{k}'" for n, k, *_ in fixed.FILE_CATEGORIES)} END AS recommended_memory_kind,
        CASE category_id {' '.join(f"WHEN '{n}' THEN '{r}'" for n, _, r, _ in fixed.FILE_CATEGORIES)} END AS risk_level,
        CASE WHEN n = 0 THEN 0.35 ELSE 0.8 END::DOUBLE AS confidence, n AS matched_signal_count FROM k)"""


def files(t):
    names = F.array(*[F.lit(s) for s in SIGNALS])
    d = F.col("doc_id")
    pick = lambda e: F.element_at(names, (e % len(SIGNALS) + 1).cast("int"))
    name = F.concat(
        pick(d), F.lit("_"), F.when(d % 3 == 0, pick(d * 7)).otherwise(F.concat(F.lit("x"), "source")),
        F.when(d % 2 == 0, ".PDF").otherwise(".txt"),
    )
    rows = t.documents.select(d.alias("file_id"), name.alias("filename"))
    return rows.withColumn("path", F.concat(F.lit("in/"), "filename"))


@add("classify_files", f"WITH {CLASSIFY} SELECT * FROM cl")
def _(t):
    return a.classify_files(files(t))


@add(
    "detect_schema",
    f"""WITH {CLASSIFY}, f AS (SELECT 'category' AS facet, category_id AS value, matched_signal_count AS m, risk_level AS r FROM cl
        UNION ALL SELECT 'memory_kind', recommended_memory_kind, matched_signal_count, risk_level FROM cl
        UNION ALL SELECT 'extension', extension, matched_signal_count, risk_level FROM cl
        UNION ALL SELECT 'risk', risk_level, matched_signal_count, risk_level FROM cl)
    SELECT facet, value, count(*) AS file_count, sum(m)::BIGINT AS matched_signal_count,
    CASE WHEN max(m) > 0 THEN 0.8 ELSE 0.35 END::DOUBLE AS confidence, bool_or(facet = 'category' AND r = 'high') AS review_required
    FROM f GROUP BY facet, value""",
)
def _(t):
    return a.detect_schema(a.classify_files(files(t)))
