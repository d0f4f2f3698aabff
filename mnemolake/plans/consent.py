"""Consent queries. Topics of a document come from its language, so several categories occur."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemolake.functions import fixed
from mnemolake.operators import consent as c
from mnemolake.operators.retrieval import bm25_search
from mnemolake.plans.retrieval import bm25_sql, topk
from mnemolake.plans.views import AS_OF, Registry, sql

registry = Registry()
add = registry.add

LANG_TOPICS = {"en": "Work", "de": "public healthcare plans", "fr": "family trip", "es": "poetry"}
LANG_CATEGORIES = {"en": "work", "de": "health", "fr": "family", "es": "general"}


def docs(t):
    topic = F.create_map(*[F.lit(x) for kv in LANG_TOPICS.items() for x in kv])[F.col("lang")]
    return t.docs.withColumn("topics", F.array(topic, F.concat(F.lit("band"), F.floor(F.col("n_chars") / 2000))))


CAT = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LANG_CATEGORIES.items()) + " END"
CONS = f"cons AS (SELECT *, {CAT} AS cat FROM docs_v)"


def allowed_sql(name: str) -> str:
    allowed, blocked, _, relative = fixed.CONSENT_PRESETS[name]
    quoted = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
    parts = ["true"]
    if blocked:
        parts.append(f"cat NOT IN {quoted(blocked)}")
    if allowed:
        parts.append(f"cat IN {quoted(allowed)}")
    if relative:
        parts.append(f"(doc_date IS NULL OR doc_date >= DATE '{AS_OF}' - 90)")
    return " AND ".join(parts)


@add("topics_to_categories", sql("docs_v", f"SELECT doc_id, {CAT} AS categories FROM docs_v"))
def _(t):
    return docs(t).select("doc_id", c.categories(F.col("topics")).alias("categories"))


@add("consent_category", sql("docs_v", f"{CONS} SELECT doc_id FROM cons WHERE {allowed_sql('balanced')}"))
def _(t):
    rules = c.preset_rules("balanced")
    return c.consent_category(docs(t), rules["allowed"], rules["blocked"]).select("doc_id")


DOC_RULE = "doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND source NOT IN ('src1', 'src2')"


def document_rules(t):
    return {"blocked_ids": t.labels.filter("toxic = 1"), "blocked_sources": ("src1", "src2")}


@add("consent_document", sql("docs_v", f"SELECT doc_id FROM docs_v WHERE {DOC_RULE}"))
def _(t):
    return c.consent_document(docs(t), **document_rules(t)).select("doc_id")


@add("consent_document_allowed", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(t):
    return c.consent_document(docs(t), allowed_ids=t.labels.filter("quality = 1"), blocked_sources=("src1",)).select("doc_id")


@add("consent_time", sql("docs_v", f"SELECT doc_id FROM docs_v WHERE doc_date IS NULL OR doc_date BETWEEN DATE '{AS_OF}' - 180 AND DATE '2026-03-01'"))
def _(t):
    return c.consent_time(docs(t), AS_OF, relative="-6m", before="2026-03-01").select("doc_id")


STAGE = f"""{CONS}, stg AS (SELECT doc_id, CASE WHEN NOT ({allowed_sql('work_only')} OR {allowed_sql('health_focus')}) THEN 'category'
    WHEN NOT ({DOC_RULE}) THEN 'document' WHEN NOT (doc_date IS NULL OR doc_date >= DATE '{AS_OF}' - 180) THEN 'time' ELSE 'kept' END AS stage FROM cons)"""


def staged(t):
    allowed = set(fixed.CONSENT_PRESETS["work_only"][0]) | set(fixed.CONSENT_PRESETS["health_focus"][0])
    return c.consent_stage(docs(t), AS_OF, allowed, (), document_rules(t), {"relative": "-6m"})


@add("consent_filter", sql("docs_v", f"{STAGE} SELECT doc_id, stage FROM stg"))
def _(t):
    return staged(t).select("doc_id", "stage")


@add("consent_filter_stats", sql("docs_v", f"{STAGE} SELECT stage, count(*) AS n FROM stg GROUP BY stage"))
def _(t):
    return c.consent_stats(staged(t))


@add(
    "consent_presets",
    sql(
        "docs_v",
        f"{CONS} " + " UNION ALL ".join(
            f"SELECT '{n}' AS preset, '{'|'.join(p[2])}' AS exposed_pii_types, count(*) FILTER ({allowed_sql(n)}) AS kept, count(*) AS total FROM cons"
            for n, p in fixed.CONSENT_PRESETS.items()
        ),
    ),
)
def _(t):
    return c.preset_reach(docs(t), AS_OF)


@add(
    "consented_search",
    sql(
        "queries_v docs_v",
        f"""{bm25_sql()}, {STAGE}, ok AS (SELECT query_id, doc_id, bm.score FROM bm JOIN stg USING (doc_id) WHERE stage = 'kept')
        SELECT query_id, doc_id, score, rank FROM ({topk('ok', 10)})""",
    ),
)
def _(t):
    return c.consented_search(t.queries, t.documents, staged(t))


@add(
    "consented_search_stats",
    sql(
        "queries_v docs_v",
        f"""{bm25_sql()}, {STAGE} SELECT query_id, stage, count(*) AS n FROM ({topk('bm', 30)}) b JOIN stg USING (doc_id) GROUP BY ALL""",
    ),
)
def _(t):
    return c.held_back(bm25_search(t.queries, t.documents, 30), staged(t))


@add(
    "pii_decision",
    sql(
        "entity_tokens",
        r"""vals AS (SELECT doc_id, 'PERSON' AS pii_type, name AS value FROM entity_tokens
            UNION ALL SELECT doc_id, 'EMAIL_ADDRESS', unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) FROM documents
            UNION ALL SELECT doc_id, 'CREDIT_CARD', unnest(regexp_extract_all(text, '[0-9]{16}')) FROM documents),
        r AS (SELECT *, CASE WHEN pii_type = 'CREDIT_CARD' THEN 'critical_pii'
            WHEN pii_type = 'PERSON' AND (contains(lower(value), 'ing') OR contains('thing', lower(value)) OR lower(value) = 'ineaed') THEN 'entity_protected:Thing'
            ELSE '' END AS a FROM vals)
        SELECT doc_id, pii_type, value, CASE WHEN a = 'critical_pii' THEN a
            WHEN pii_type = 'PERSON' AND (contains(lower(value), 'thing') OR contains('thing', lower(value)) OR lower(value) = 'ineaed') THEN 'entity_protected:Thing'
            WHEN pii_type = 'PERSON' AND (contains(lower(value), 'einheit') OR contains('einheit', lower(value))) THEN 'entity_exposed:Einheit'
            WHEN pii_type = 'EMAIL_ADDRESS' THEN 'pii_type_exposed' ELSE 'pii_type_anonymized' END AS reason,
        NOT (pii_type = 'EMAIL_ADDRESS' OR (pii_type = 'PERSON' AND (contains(lower(value), 'einheit') OR contains('einheit', lower(value)))
            AND NOT (contains(lower(value), 'thing') OR contains('thing', lower(value)) OR lower(value) = 'ineaed'))) AS anonymize FROM r""",
    ),
)
def _(t):
    found = lambda kind, pattern: t.documents.select(
        "doc_id", F.lit(kind).alias("pii_type"), F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("value")
    )
    values = (
        found("PERSON", "[A-Z][a-z]{5,}").distinct()
        .unionByName(found("EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"))
        .unionByName(found("CREDIT_CARD", "[0-9]{16}"))
    )
    return c.pii_decision(values, ("EMAIL_ADDRESS", "CREDIT_CARD"), (("Thing", ("Ineaed",)),), (("Einheit", ()),))
