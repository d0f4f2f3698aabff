"""Maintenance, health and knowledge-graph queries over the whole document table."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemolake.operators import chunking, enrich, graphs, upkeep as u
from mnemolake.plans.documents import CHUNKS, FLAT
from mnemolake.plans.enrichment import CONTENT_TYPE, UNDER, domain_sql, quoted
from mnemolake.plans.views import AS_OF, Registry, sql

registry = Registry()
add = registry.add

NOW = f"DATE '{AS_OF}'"


@add("stale_sources", sql("docs_v", f"SELECT doc_id, title, source, {NOW} - doc_date AS age_days FROM docs_v WHERE {NOW} - doc_date > 90"))
def _(t):
    return u.stale_sources(t.docs, AS_OF).select("doc_id", "title", "source", "age_days")


@add("undated_sources", sql("docs_v", "SELECT doc_id, title FROM docs_v WHERE doc_date IS NULL"))
def _(t):
    return u.undated_sources(t.docs).select("doc_id", "title")


# German documents write entity names in two parts, so variants of a label occur
MENTIONS = """men AS (SELECT doc_id, CASE entity_type WHEN 'organization' THEN 0 ELSE 1 END AS ord, entity_type,
    CASE WHEN lang = 'de' THEN left(name, 3) || '-' || substring(name, 4) ELSE name END AS label FROM entities_v JOIN documents USING (doc_id))"""


def mentions(t):
    named = t.entities.join(t.documents.select("doc_id", "lang"), "doc_id")
    split = F.concat(F.left("name", F.lit(3)), F.lit("-"), F.substring("name", 4, 1000))
    return named.select(
        "doc_id", F.when(F.col("entity_type") == "organization", 0).otherwise(1).alias("ord"), "entity_type",
        F.when(F.col("lang") == "de", split).otherwise(F.col("name")).alias("label"),
    )


ENTITY = f"""{MENTIONS}, mk AS (SELECT *, regexp_replace(lower(label), '[^a-z0-9]+', '', 'g') AS key FROM men),
    ml AS (SELECT key, lower(label) AS low, arg_min(label, (doc_id, ord)) AS label, arg_min(entity_type, (doc_id, ord)) AS entity_type,
        min((doc_id, ord)) AS seen FROM mk WHERE length(key) >= 2 GROUP BY key, lower(label)),
    mg AS (SELECT key, count(*) AS label_count, arg_min(entity_type, seen) AS entity_type,
        arg_min(label, (-length(regexp_replace(label, '[^A-Z]', '', 'g')), length(label), label)) AS canonical_label FROM ml GROUP BY key HAVING count(*) >= 2),
    ec AS (SELECT 'entity_consolidation:' || key AS id, any_value(mg.entity_type) AS entity_type, any_value(canonical_label) AS canonical_label,
        any_value(label_count) AS label_count, count(DISTINCT doc_id) AS doc_count FROM mg JOIN mk USING (key) GROUP BY key)"""


@add("entity_consolidation", sql("docs_v entities_v", f"{ENTITY} SELECT * FROM ec"))
def _(t):
    return u.entity_consolidation(mentions(t))


REPL = f"""dterm AS (SELECT doc_id, doc_date, {NOW} - doc_date > 90 AS stale, unnest(list_distinct(list_filter(regexp_extract_all(
        lower(title || ' ' || text || ' ' || array_to_string(topics, ' ')), '[a-z0-9]+'), lambda x: length(x) >= 3))) AS term FROM docs_v WHERE doc_date IS NOT NULL),
    pairs AS (SELECT s.doc_id AS replaces_doc_id, f.doc_id AS candidate_doc_id, count(*) AS overlap, any_value(f.doc_date - s.doc_date) AS freshness_delta_days
        FROM dterm s JOIN dterm f USING (term) WHERE s.stale AND NOT f.stale AND f.doc_date > s.doc_date GROUP BY 1, 2),
    repl AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY replaces_doc_id ORDER BY overlap DESC, candidate_doc_id) = 1)"""


@add("replacement_candidates", sql("docs_v", f"{REPL} SELECT * FROM repl"))
def _(t):
    return u.replacement_candidates(t.docs, AS_OF)


DUP = f"""fp AS (SELECT doc_id, sha256({FLAT}) AS f FROM docs_v), dg AS (SELECT f FROM fp GROUP BY f HAVING count(*) >= 2)"""
SUMMARY = f"""{ENTITY}, {REPL}, {DUP}, summ AS (SELECT count(*) AS document_count, count(*) FILTER ({NOW} - doc_date > 90) AS stale_source_count,
    count(*) FILTER (doc_date IS NULL) AS undated_source_count, (SELECT count(*) FROM dg) AS duplicate_group_count,
    (SELECT count(*) FROM ec) AS entity_consolidation_count, (SELECT count(*) FROM repl) AS replacement_candidate_count FROM docs_v)"""
VIEWS = "docs_v entities_v"


@add("maintenance_snapshot", sql(VIEWS, f"{SUMMARY} SELECT * FROM summ"))
def _(t):
    return u.snapshot_summary(t.docs, mentions(t), AS_OF)


ITEMS = f"""items AS (SELECT 'refresh_stale_sources' AS type, doc_id FROM docs_v WHERE {NOW} - doc_date > 90
    UNION SELECT 'add_source_dates', doc_id FROM docs_v WHERE doc_date IS NULL
    UNION SELECT 'deduplicate_documents', doc_id FROM fp WHERE f IN (SELECT f FROM dg)
    UNION SELECT 'consolidate_entities', doc_id FROM mk WHERE key IN (SELECT key FROM mg))"""
KINDS = "kinds(job_order, type, severity, reason, suggested_tool) AS (VALUES " + ", ".join(
    f"({o}, {quoted(k)}, {quoted(s)}, {quoted(r)}, {quoted(tool)})" for o, k, s, r, tool in u.JOBS
) + ")"
JOBS = f"""{ENTITY}, {DUP}, {ITEMS}, {KINDS}, js AS (SELECT type, count(*) AS item_count, sum(doc_id)::BIGINT AS s FROM items GROUP BY type),
    jobs AS (SELECT type || ':' || left(sha256(type || ':' || item_count || ':' || s || ':' || reason), 12) AS id, job_order, type, severity, reason,
        suggested_tool, item_count FROM js JOIN kinds USING (type))"""


def jobs(t):
    return u.maintenance_jobs(u.job_items(t.docs, mentions(t), AS_OF))


@add("maintenance_jobs", sql(VIEWS, f"{JOBS} SELECT * FROM jobs"))
def _(t):
    return jobs(t)


TARGET = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in u.INTENTS.items()) + " END"
OPERATION = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in u.INTENTS.items()) + " END"
PLAN = f"""{JOBS}, plan AS (SELECT 0.0::DOUBLE AS job_order, 'recurring_freshness_scan' AS type, CASE WHEN (SELECT count(*) FROM jobs) > 0 THEN 'medium' ELSE 'low' END AS severity,
        'read_only' AS execution_mode, 'maintenance_check' AS target, 'run_command' AS operation, (SELECT count(*) FROM docs_v) AS item_count, false AS requires_review
    UNION ALL SELECT 0.5, 'connector_sync_review', 'medium', 'review_required', 'connector_sources', 'sync_after_operator_review', n, true
        FROM (SELECT count(DISTINCT source) AS n FROM docs_v WHERE doc_date IS NULL OR {NOW} - doc_date > 90) WHERE n > 0
    UNION ALL SELECT job_order, type, severity, 'review_required', {TARGET}, {OPERATION}, item_count, true FROM jobs)"""


@add("maintenance_plan", sql(VIEWS, f"{PLAN} SELECT * FROM plan"))
def _(t):
    return u.maintenance_plan(t.docs, jobs(t), AS_OF).drop("reason")


APPLY = f"""{PLAN}, ap0 AS (SELECT *, row_number() OVER (ORDER BY job_order) AS execution_order FROM plan),
    ap AS (SELECT 'maintenance_apply:' || left(sha256(type || ':' || execution_order || ':' || operation), 12) AS id, execution_order, type AS job_type, severity,
        requires_review, CASE WHEN requires_review THEN 'pending_review' ELSE 'ready' END AS status, target, operation, item_count FROM ap0)"""


@add("maintenance_apply", sql(VIEWS, f"{APPLY} SELECT * FROM ap"))
def _(t):
    return u.maintenance_apply(u.maintenance_plan(t.docs, jobs(t), AS_OF))


AT = "2026-06-01T12:00:00Z"


@add(
    "ledger_event",
    sql(VIEWS, f"""{APPLY}, pk AS (SELECT count(*) AS total_item_count, count(*) FILTER (requires_review) AS review_item_count, 0 AS approved_item_count,
            count(*) FILTER (status = 'pending_review') AS pending_review_count, string_agg(DISTINCT operation, ',' ORDER BY operation) AS operations,
            'maintenance_batch:' || left(sha256('maintenance_batch:' || string_agg(id, ',' ORDER BY execution_order) || ':dry_run'), 12) AS batch_id FROM ap),
        sc AS (SELECT string_agg(x, ',' ORDER BY x) AS status_counts FROM (SELECT status || '=' || count(*) AS x FROM ap GROUP BY status)),
        tc AS (SELECT string_agg(x, ',' ORDER BY x) AS target_counts FROM (SELECT target || '=' || count(*) AS x FROM ap GROUP BY target))
        SELECT 'maintenance_ledger:' || left(sha256('maintenance_ledger:' || batch_id || ',ops-team,{AT}:record'), 12) AS event_id, '{AT}' AS recorded_at,
        'ops-team' AS actor, batch_id, 'dry_run' AS mode, total_item_count, review_item_count, approved_item_count, pending_review_count, status_counts,
        target_counts, operations FROM pk, sc, tc"""),
)
def _(t):
    items = u.maintenance_apply(u.maintenance_plan(t.docs, jobs(t), AS_OF))
    return u.ledger_event(items, "ops team", AT)


HEALTH = f"""{SUMMARY}, hp AS (SELECT *, round_even(least(35.0, 35.0 * stale_source_count / greatest(1, document_count)), 0)::BIGINT AS stale_penalty,
        round_even(least(20.0, 20.0 * undated_source_count / greatest(1, document_count)), 0)::BIGINT AS undated_penalty,
        least(20, duplicate_group_count * 10) AS duplicate_penalty, least(15, entity_consolidation_count * 5) AS entity_penalty,
        least(10, replacement_candidate_count * 2) AS replacement_penalty FROM summ),
    hs AS (SELECT *, greatest(0, 100 - stale_penalty - undated_penalty - duplicate_penalty - entity_penalty - replacement_penalty) AS health_score FROM hp)"""


@add(
    "health_score",
    sql(VIEWS, f"{HEALTH} SELECT *, CASE WHEN health_score >= 90 THEN 'excellent' WHEN health_score >= 75 THEN 'good' WHEN health_score >= 50 THEN 'needs_attention' ELSE 'critical' END AS status FROM hs"),
)
def _(t):
    return u.health_score(u.snapshot_summary(t.docs, mentions(t), AS_OF))


GATES = (
    ("freshness", "stale_source_count", "stale sources need refresh"), ("dates", "undated_source_count", "undated sources need date metadata"),
    ("duplicates", "duplicate_group_count", "duplicate groups need consolidation"),
    ("entity_consolidation", "entity_consolidation_count", "safe entity label variants need consolidation"),
    ("replacement_candidates", "replacement_candidate_count", "fresh replacement candidates should be reviewed"),
)


@add(
    "health_gates",
    sql(VIEWS, f"{SUMMARY} " + " UNION ALL ".join(
        f"SELECT '{g}' AS gate, {c} = 0 AS passed, CASE WHEN {c} = 0 THEN 'healthy' ELSE '{m}' END AS message FROM summ" for g, c, m in GATES
    )),
)
def _(t):
    return u.health_gates(u.snapshot_summary(t.docs, mentions(t), AS_OF))


# --- knowledge graph -----------------------------------------------------------------------------------------
KG = """ht AS (SELECT DISTINCT doc_id, lower(topic) AS name FROM (SELECT doc_id, unnest(topics) AS topic FROM docs_v)),
    tc AS (SELECT name, count(*) AS n FROM ht GROUP BY name HAVING count(*) >= 2),
    te AS (SELECT 'topic_' || name AS source, 'doc_' || doc_id AS target, 'has_topic' AS type FROM ht JOIN tc USING (name)
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, name) <= 3),
    he AS (SELECT DISTINCT doc_id, entity_type, lower(name) AS name FROM entities_v),
    ec AS (SELECT * FROM (SELECT entity_type, name, count(*) AS n FROM he GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY entity_type ORDER BY n DESC, name) <= 15),
    pk AS (SELECT * FROM ec WHERE n >= 2),
    ee AS (SELECT entity_type || '_' || name AS source, 'doc_' || doc_id AS target, 'has_' || entity_type AS type FROM he JOIN pk USING (entity_type, name)
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CASE entity_type WHEN 'organization' THEN 2 ELSE 3 END, n DESC, name) <= 5),
    kge AS (SELECT * FROM te UNION ALL SELECT * FROM ee)"""


@add("knowledge_graph", sql(VIEWS, f"{KG} SELECT * FROM kge"))
def _(t):
    return graphs.knowledge_graph(t.docs, t.entities)[1]


@add(
    "knowledge_graph_nodes",
    sql(VIEWS, f"""{KG}, dg AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM kge UNION ALL SELECT target FROM kge) GROUP BY id),
        nn AS (SELECT 'doc_' || doc_id AS id, title AS label, 'document' AS type, 0 AS n FROM docs_v
            UNION ALL SELECT 'topic_' || name, upper(name[1]) || name[2:], 'topic', n FROM tc
            UNION ALL SELECT entity_type || '_' || name, upper(name[1]) || name[2:], entity_type, n FROM pk)
        SELECT id, label, type, coalesce(degree, n) AS connection_count FROM nn LEFT JOIN dg USING (id)"""),
)
def _(t):
    return graphs.knowledge_graph(t.docs, t.entities)[0]


@add(
    "graph_facets",
    f"""WITH {UNDER}, f AS (SELECT {CONTENT_TYPE} AS content_type, {domain_sql()} AS domain FROM un)
    SELECT 'content_type' AS facet, content_type AS value, count(*) AS n FROM f GROUP BY ALL UNION ALL SELECT 'domain', domain, count(*) FROM f GROUP BY ALL""",
)
def _(t):
    return graphs.graph_facets(enrich.document_filters(t.docs))


@add(
    "graph_focus",
    sql(VIEWS, f"""{KG}, tch AS (SELECT DISTINCT * FROM kge WHERE source IN ('topic_de', 'topic_band0') OR target IN (SELECT 'doc_' || doc_id FROM labels WHERE toxic = 1))
        SELECT source, target, type FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY target, type) AS a,
        row_number() OVER (PARTITION BY target ORDER BY source, type) AS b FROM tch) WHERE a <= 25 AND b <= 25"""),
)
def _(t):
    chosen = t.labels.filter("toxic = 1").select(F.concat(F.lit("doc_"), "doc_id").alias("id")).unionByName(
        t.spark.createDataFrame([("topic_de",), ("topic_band0",)], "id string")
    )
    return graphs.graph_focus(graphs.knowledge_graph(t.docs, t.entities)[1], chosen, 25)


@add(
    "graph_node_details",
    f"""WITH {CHUNKS.rstrip()}, c AS (SELECT parent_id AS doc_id, count(*) AS n, sum(length(text)) AS k FROM chunks GROUP BY parent_id),
    e AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '[A-Z][a-z]{{5,}}')) AS names FROM documents)
    SELECT 'doc_' || d.doc_id AS id, 'Doc ' || d.doc_id AS label, coalesce(n, 0) AS chunk_count, (length(text) + coalesce(k, 0))::BIGINT AS text_length,
    array_to_string(list_sort([lang, 'band' || (n_chars // 2000)]), '|') AS topics, len(list_filter(names, lambda x: length(x) % 2 = 0)) AS organizations,
    len(list_filter(names, lambda x: length(x) % 2 = 1)) AS locations FROM documents d LEFT JOIN c USING (doc_id) JOIN e USING (doc_id)""",
)
def _(t):
    return graphs.document_details(t.docs, chunking.chunk_documents(t.documents), t.entity_lists)


@add(
    "graph_name_details",
    sql(VIEWS, """m AS (SELECT DISTINCT 'topic' AS kind, lower(topic) AS name, doc_id FROM (SELECT doc_id, unnest(topics) AS topic FROM docs_v)
            UNION SELECT entity_type, lower(name), doc_id FROM entities_v)
        SELECT kind, name, count(*) AS document_count, array_to_string(list_sort(list(doc_id))[1:5], '|') AS sample_documents FROM m GROUP BY kind, name"""),
)
def _(t):
    topics = t.docs.select(F.lit("topic").alias("kind"), F.explode("topics").alias("name"), "doc_id")
    named = t.entities.select(F.col("entity_type").alias("kind"), "name", "doc_id")
    return graphs.name_details(topics.unionByName(named))
