"""Cited-evidence queries: every benchmark text is a question over the whole document table."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemolake.functions import fixed
from mnemolake.functions.text import clean_excerpt
from mnemolake.operators import reasoning as rs, retrieval as r
from mnemolake.plans.enrichment import quoted
from mnemolake.plans.retrieval import COVER, bm25_sql, topk
from mnemolake.plans.views import AS_OF, Registry, sql
from mnemolake.session import stored_rows

registry = Registry()
add = registry.add

STOP = "(" + ", ".join(quoted(w) for w in fixed.STOP_WORDS_REASONING) + ")"
CITE = rf"""{bm25_sql()}, cand AS (SELECT query_id, doc_id, score AS first_score, rank AS first_rank FROM ({topk('bm', 72)})),
    rr AS (SELECT c.query_id, c.doc_id, round({COVER}, 6) AS score, first_rank FROM cand c JOIN queries_v q USING (query_id) JOIN documents d USING (doc_id)),
    wide AS ({topk('rr', 24, 'score DESC, first_rank')}),
    flat AS (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS f FROM docs_v),
    cite_all AS (SELECT query_id, doc_id, title, CASE WHEN length(f) <= 700 THEN f ELSE rtrim(left(f, 699)) || '...' END AS excerpt,
        round(wide.score, 4) AS score, doc_date AS date, source, topics[2] AS topic, row_number() OVER (PARTITION BY query_id ORDER BY wide.score DESC, doc_id) AS rank
        FROM wide JOIN flat USING (doc_id) WHERE f <> ''),
    cite AS (SELECT * FROM cite_all WHERE rank <= 8),
    qtk AS (SELECT query_id, text, regexp_extract_all(lower(text), '[a-z0-9]+') AS tk FROM queries_v),
    terms AS (SELECT query_id, text AS question, list_filter(tk, lambda x, i: length(x) >= 3 AND x NOT IN {STOP} AND list_position(tk, x) = i) AS terms FROM qtk),
    corpus AS (SELECT query_id, string_agg(lower(title || ' ' || excerpt), ' ' ORDER BY rank) AS c FROM cite GROUP BY query_id),
    b AS (SELECT query_id, question, terms, list_filter(terms, lambda x: contains(coalesce(c, ''), x)) AS found,
        list_filter(terms, lambda x: NOT contains(coalesce(c, ''), x)) AS missing,
        'answer:' || left(sha256(question), 16) AS answer FROM terms LEFT JOIN corpus USING (query_id))"""


def results(t, k: int = 24):
    # stored: the hits are read by every table of the evidence, and the texts are joined to them without a shuffle
    hits = stored_rows(r.rerank(t.queries, t.documents, r.bm25_search(t.queries, t.documents, 72), k), "reranked")
    rows = hits.select("query_id", "doc_id", "score").join(t.docs, "doc_id").withColumn("date", F.date_format("doc_date", "yyyy-MM-dd"))
    excerpt = clean_excerpt(F.col("text"))
    names = F.array_distinct(F.regexp_extract_all("excerpt", F.lit("[A-Z][a-z]{5,}"), F.lit(0)))
    rows = rows.withColumn("excerpt", excerpt).withColumn("names", names).select(
        "query_id", "score", "doc_id", "title", "text", "date", "source", "topics",
        F.filter("names", lambda n: F.length(n) % 2 == 0).alias("organizations"),
        F.filter("names", lambda n: F.length(n) % 2 == 1).alias("locations"),
        F.filter("names", lambda n: F.endswith(n, F.lit("er"))).alias("persons"),
        F.regexp_extract_all("excerpt", F.lit("[A-Z][a-z]{2,4}"), F.lit(0)).alias("entities"),
    )
    return stored_rows(rows, "results")


def bundled(t, found=None):
    # several tables are derived from the bundle: keep it once it is computed
    return rs.bundle(t.queries, rs.citations(results(t) if found is None else found)).persist()


VIEWS = "queries_v docs_v"
DATE = "coalesce(strftime(date, '%Y-%m-%d'), '') AS date"


def day(name):
    return F.coalesce(F.date_format(name, "yyyy-MM-dd"), F.lit("")).alias(name)


@add("citations", sql(VIEWS, f"{CITE} SELECT query_id, rank, doc_id, title, excerpt, score, {DATE}, source, topic AS topics FROM cite"))
def _(t):
    out = rs.citations(results(t))
    return out.select("query_id", "rank", "doc_id", "title", "excerpt", "score", day("date"), "source", "topics")


COVERAGE = """cov AS (SELECT b.query_id, count(doc_id) AS source_count, count(date) AS dated_source_count,
    count(*) FILTER (score >= 0.7) AS strong_source_count FROM b LEFT JOIN cite USING (query_id) GROUP BY b.query_id)"""


@add(
    "coverage",
    sql(VIEWS, f"{CITE}, {COVERAGE} SELECT cov.*, array_to_string(found, '|') AS query_terms_found, array_to_string(missing, '|') AS query_terms_missing FROM cov JOIN b USING (query_id)"),
)
def _(t):
    return rs.coverage(bundled(t))


FRESH = f"""fr AS (SELECT b.query_id, min(date) AS mn, max(date) AS mx, count(*) FILTER (DATE '{AS_OF}' - date > 90) AS s,
    count(*) FILTER (doc_id IS NOT NULL AND date IS NULL) AS u FROM b LEFT JOIN cite USING (query_id) GROUP BY b.query_id),
    fresh AS (SELECT query_id, coalesce(strftime(mn, '%Y-%m-%d'), '') AS oldest_source_date, coalesce(strftime(mx, '%Y-%m-%d'), '') AS newest_source_date,
    s AS stale_source_count, u AS undated_source_count, array_to_string(list_filter([
        CASE WHEN s > 0 THEN s || CASE WHEN s = 1 THEN ' source is' ELSE ' sources are' END || ' older than 90 days' END,
        CASE WHEN u > 0 THEN u || CASE WHEN u = 1 THEN ' source has' ELSE ' sources have' END || ' no date metadata' END], lambda x: x IS NOT NULL), '|') AS warnings FROM fr)"""


def fresh(t, b):
    out = rs.freshness(b, AS_OF)
    return out.select("query_id", day("oldest_source_date"), day("newest_source_date"), "stale_source_count", "undated_source_count", "warnings")


@add("freshness", sql(VIEWS, f"{CITE}, {FRESH} SELECT * FROM fresh"))
def _(t):
    return fresh(t, bundled(t))


GAPS = """gap AS (SELECT query_id, CASE WHEN source_count = 0 THEN 'No supporting sources were found.' ELSE array_to_string(list_filter([
    CASE WHEN len(missing) > 0 THEN 'No source explicitly mentions: ' || array_to_string(missing, ', ') END,
    CASE WHEN strong_source_count = 0 THEN 'No high-confidence source crossed the strong evidence threshold.' END], lambda x: x IS NOT NULL), '|') END AS gaps
    FROM cov JOIN b USING (query_id))"""


@add("gaps", sql(VIEWS, f"{CITE}, {COVERAGE}, {GAPS} SELECT * FROM gap"))
def _(t):
    return rs.gaps(bundled(t))


def cues(column: str, words) -> str:
    return f"regexp_matches(lower({column}), '{'|'.join(words)}')"


CONTRA = f"""con AS (SELECT l.query_id, l.doc_id AS left_doc_id, r.doc_id AS right_doc_id, l.rank AS left_rank, r.rank AS right_rank,
        list_filter(terms, lambda x: list_contains(regexp_extract_all(lower(l.excerpt), '[a-z0-9]+'), x)
            AND list_contains(regexp_extract_all(lower(r.excerpt), '[a-z0-9]+'), x)) AS shared
        FROM cite l JOIN cite r ON l.query_id = r.query_id AND l.rank < r.rank JOIN b ON b.query_id = l.query_id
        WHERE ({cues('l.excerpt', fixed.POSITIVE_CUES)} AND {cues('r.excerpt', fixed.NEGATIVE_CUES)})
           OR ({cues('l.excerpt', fixed.NEGATIVE_CUES)} AND {cues('r.excerpt', fixed.POSITIVE_CUES)})),
    contra AS (SELECT query_id, left_doc_id, right_doc_id, left_rank, right_rank, array_to_string(shared[1:3], ' ') AS topic FROM con WHERE len(shared) >= 2)"""


@add("contradictions", sql(VIEWS, f"{CITE}, {CONTRA} SELECT * FROM contra"))
def _(t):
    return rs.contradictions(bundled(t))


BRIEF = r"""brief AS (SELECT b.query_id, CASE WHEN count(doc_id) > 0 THEN 'Found ' || count(doc_id) || ' supporting source(s). Strongest source, ' || arg_min(title, (-score, rank))
    || ', says: ' || string_split(regexp_replace(arg_min(excerpt, (-score, rank)), '([.!?])\s+', '\1' || chr(9246), 'g'), chr(9246))[1] ELSE '' END AS answer_brief
    FROM b LEFT JOIN cite USING (query_id) GROUP BY b.query_id)"""


@add("answer_brief", sql(VIEWS, f"{CITE}, {BRIEF} SELECT * FROM brief"))
def _(t):
    return rs.answer_brief(bundled(t)).fillna({"answer_brief": ""})


CONCEPTS = """con0 AS (SELECT query_id, answer, 'citation:' || doc_id AS citation, found, lower(topic) AS concept FROM cite JOIN b USING (query_id)
        UNION SELECT query_id, answer, 'citation:' || doc_id, found, unnest(list_filter(found, lambda x: contains(lower(title || ' ' || excerpt), x)
            AND regexp_matches(x, '[a-z]'))) FROM cite JOIN b USING (query_id))"""
CGRAPH = f"""{CONCEPTS}, ce AS (SELECT query_id, answer AS source, 'citation:' || doc_id AS target, 'cites' AS type FROM cite JOIN b USING (query_id)
    UNION SELECT query_id, citation, 'concept:' || concept, 'mentions' FROM con0
    UNION SELECT query_id, answer, 'concept:' || concept, 'covers' FROM con0 WHERE list_contains(found, concept)
    UNION SELECT query_id, 'citation:' || left_doc_id, 'citation:' || right_doc_id, 'contradicts' FROM contra)"""


@add("citation_graph", sql(VIEWS, f"{CITE}, {CONTRA}, {CGRAPH} SELECT query_id, source || '->' || target || ':' || type AS id, source, target, type FROM ce"))
def _(t):
    return rs.citation_graph(bundled(t))[1]


@add(
    "citation_graph_nodes",
    sql(VIEWS, f"""{CITE}, {CONCEPTS} SELECT query_id, answer AS id, 'answer' AS type, 'Think answer' AS label FROM b
        UNION ALL SELECT query_id, 'citation:' || doc_id, 'citation', title FROM cite
        UNION ALL SELECT DISTINCT query_id, 'concept:' || concept, 'concept', concept FROM con0"""),
)
def _(t):
    return rs.citation_graph(bundled(t))[0]


def any_of(column: str, words) -> str:
    return f"regexp_matches({column}, '{'|'.join(words)}')"


ENTS = f"""en0 AS (SELECT query_id, answer, doc_id, rank, regexp_extract_all(excerpt, '[A-Z][a-z]{{5,}}') AS names,
        regexp_extract_all(excerpt, '[A-Z][a-z]{{2,4}}') AS loose FROM cite JOIN b USING (query_id)),
    en1 AS (SELECT query_id, answer, doc_id, rank, unnest(names) AS label, generate_subscripts(names, 1) AS i, 0 AS free FROM en0
        UNION ALL SELECT query_id, answer, doc_id, rank, unnest(loose), generate_subscripts(loose, 1), 1 FROM en0),
    en2 AS (SELECT *, CASE WHEN free = 0 AND length(label) % 2 = 0 THEN 'organization' WHEN free = 0 THEN 'location'
        WHEN {any_of('lower(label)', fixed.ORGANIZATION_MARKS)} THEN 'organization' WHEN {any_of('lower(label)', fixed.TECHNOLOGY_MARKS)} THEN 'technology'
        ELSE 'named_entity' END AS entity_type, CASE WHEN free = 1 THEN 3 WHEN length(label) % 2 = 0 THEN 1 ELSE 2 END AS grp FROM en1),
    en3 AS (SELECT * FROM en2 QUALIFY row_number() OVER (PARTITION BY query_id, rank, entity_type, lower(label) ORDER BY grp, i) = 1),
    ents AS (SELECT query_id, answer, 'citation:' || doc_id AS citation, rank, label, entity_type, 'entity:' || entity_type || ':' || lower(label) AS entity_id,
        row_number() OVER (PARTITION BY query_id, rank ORDER BY grp, i) AS pos FROM en3)"""


@add(
    "entity_graph",
    sql(VIEWS, f"""{CITE}, {ENTS}, ee AS (SELECT query_id, answer AS source, 'citation:' || doc_id AS target, 'cites' AS type FROM cite JOIN b USING (query_id)
        UNION SELECT query_id, citation, entity_id, 'mentions_entity' FROM ents
        UNION SELECT query_id, answer, entity_id, 'answers_with_entity' FROM ents
        UNION SELECT l.query_id, l.entity_id, r.entity_id, 'co_occurs' FROM ents l JOIN ents r ON l.query_id = r.query_id AND l.rank = r.rank AND l.pos < r.pos)
        SELECT query_id, source || '->' || target || ':' || type AS id, source, target, type FROM ee"""),
)
def _(t):
    return rs.entity_graph(bundled(t))[1]


@add(
    "entity_graph_nodes",
    sql(VIEWS, f"""{CITE}, {ENTS} SELECT query_id, answer AS id, 'answer' AS type, 'Think answer' AS label FROM b
        UNION ALL SELECT query_id, 'citation:' || doc_id, 'citation', title FROM cite
        UNION ALL SELECT query_id, entity_id, 'entity', arg_min(label, (rank, pos)) FROM ents GROUP BY query_id, entity_id"""),
)
def _(t):
    return rs.entity_graph(bundled(t))[0]


@add(
    "entity_counts",
    sql(VIEWS, f"""{CITE}, {ENTS} SELECT query_id, entity_type, count(*) AS n FROM ents GROUP BY ALL
        UNION ALL SELECT query_id, 'redacted_person', sum(len(list_filter(list_distinct(names), lambda x: ends_with(x, 'er'))))::BIGINT AS n FROM en0
        GROUP BY query_id HAVING n > 0"""),
)
def _(t):
    return rs.entity_counts(bundled(t))


@add(
    "infer_entity_type",
    f"""WITH w AS (SELECT DISTINCT label FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z][a-z]+(?: [A-Z][a-z]+)?')) AS label FROM documents)),
    x AS (SELECT label, CASE WHEN length(label) > 100 THEN '' WHEN {any_of('lower(label)', fixed.ORGANIZATION_MARKS)} THEN 'organization' WHEN {any_of('lower(label)', fixed.TECHNOLOGY_MARKS)} THEN 'technology'
        WHEN regexp_matches(label, '\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+){{1,3}}\\b') THEN '' ELSE 'named_entity' END AS entity_type FROM w) SELECT * FROM x""",
)
def _(t):
    found = F.regexp_extract_all("text", F.lit("[A-Za-z][a-z]+(?: [A-Z][a-z]+)?"), F.lit(0))
    labels = t.documents.select(F.explode(found).alias("label")).distinct()
    return labels.select("label", F.coalesce(rs.infer_entity_type(F.col("label")), F.lit("")).alias("entity_type"))


ACTIONS = f"""a0 AS (
    SELECT query_id, 'refresh_stale_citation' AS type, 'high' AS severity, 'Source is older than 90 days' AS reason, 'search_documents' AS suggested_tool,
        CAST(doc_id AS VARCHAR) AS ids, question || ' ' || title || ' ' || topic AS rq FROM cite JOIN b USING (query_id) WHERE DATE '{AS_OF}' - date > 90
    UNION ALL SELECT query_id, 'add_source_date', 'medium', 'Source has no date metadata', 'write_memory', CAST(doc_id AS VARCHAR), question || ' ' || title || ' ' || source
        FROM cite JOIN b USING (query_id) WHERE date IS NULL
    UNION ALL SELECT query_id, 'retrieve_missing_context', 'medium', 'No source explicitly covers: ' || array_to_string(missing, ', '), 'think', '',
        question || ' ' || array_to_string(missing, ' ') FROM b WHERE len(missing) > 0
    UNION ALL SELECT query_id, 'improve_low_confidence_evidence', 'medium', 'No cited source crossed the strong evidence threshold', 'search_documents',
        (SELECT string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank) FROM cite c WHERE c.query_id = b.query_id), trim(question || ' ' || array_to_string(found, ' '))
        FROM b JOIN cov USING (query_id) WHERE source_count > 0 AND strong_source_count = 0
    UNION ALL SELECT query_id, 'resolve_contradiction', 'high', 'Sources disagree on ' || topic, 'think', left_doc_id || ',' || right_doc_id, question || ' ' || topic
        FROM contra JOIN b USING (query_id)),
    act AS (SELECT query_id, type, severity, reason, suggested_tool, ids, rq AS repair_query, type || ':' || left(sha256(type || ':' || ids || ':' || rq), 12) AS action_id FROM a0)"""
ALL = f"{CITE}, {COVERAGE}, {CONTRA}, {ACTIONS}"


@add("citation_maintenance", sql(VIEWS, f"{ALL} SELECT query_id, type, severity, reason, suggested_tool, replace(ids, ',', '|') AS citation_doc_ids, repair_query, action_id FROM act"))
def _(t):
    return rs.citation_maintenance(bundled(t), AS_OF)


TERMS_OF = "list_distinct(list_filter(regexp_extract_all(lower({p}.title || ' ' || {p}.excerpt || ' ' || {p}.topic), '[a-z0-9]+'), lambda x: length(x) >= 3))"
REPL = f"""rp AS (SELECT c.query_id, c.doc_id AS replaces_doc_id, n.doc_id AS candidate_doc_id, n.title, n.date, n.score, n.rank, n.date - c.date AS delta,
        len(list_intersect({TERMS_OF.format(p='c')}, {TERMS_OF.format(p='n')})) AS overlap
        FROM cite c JOIN cite_all n ON n.query_id = c.query_id AND n.date > c.date WHERE DATE '{AS_OF}' - c.date > 90),
    repl AS (SELECT * FROM rp WHERE overlap > 0 QUALIFY row_number() OVER (PARTITION BY query_id, replaces_doc_id ORDER BY round(score + overlap, 6) DESC, rank) = 1)"""


def replacements(b, found):
    return rs.citation_replacements(b, rs.citations(found, 24), AS_OF)


@add("citation_replacements", sql(VIEWS, f"{CITE}, {REPL} SELECT query_id, replaces_doc_id, candidate_doc_id, title, {DATE}, score, delta AS freshness_delta_days FROM repl"))
def _(t):
    found = results(t)
    return replacements(bundled(t, found), found)


@add(
    "maintenance_graph",
    sql(VIEWS, f"""{ALL}, {REPL}, mg AS (SELECT query_id, answer AS source, 'action:' || action_id AS target, 'needs_maintenance' AS type FROM act JOIN b USING (query_id)
        UNION SELECT query_id, 'action:' || action_id, 'citation:' || unnest(string_split(ids, ',')), 'repairs' FROM act WHERE ids <> ''
        UNION SELECT query_id, 'candidate:' || candidate_doc_id, 'citation:' || replaces_doc_id, 'can_replace' FROM repl)
        SELECT query_id, source || '->' || target || ':' || type AS id, source, target, type FROM mg"""),
)
def _(t):
    found = results(t)
    b = bundled(t, found)
    return rs.maintenance_graph(b, rs.citation_maintenance(b, AS_OF), replacements(b, found))


@add(
    "think",
    sql(VIEWS, f"""{ALL}, {FRESH}, {GAPS}, {BRIEF}, pr AS (SELECT query_id, CASE WHEN bool_or(severity = 'high') THEN 'high' ELSE 'medium' END AS priority,
            count(*) AS action_count FROM act GROUP BY query_id)
        SELECT query_id, answer_brief, source_count, strong_source_count, stale_source_count, gaps, coalesce(priority, 'none') AS priority,
        coalesce(action_count, 0) AS action_count FROM brief JOIN cov USING (query_id) JOIN fresh USING (query_id) JOIN gap USING (query_id) LEFT JOIN pr USING (query_id)"""),
)
def _(t):
    parts = rs.think(t.queries, results(t), AS_OF)
    on = "query_id"
    out = (
        parts["answers"].join(parts["coverage"].select(on, "source_count", "strong_source_count"), on)
        .join(parts["freshness"].select(on, "stale_source_count"), on).join(parts["gaps"], on).join(parts["priority"], on, "left")
    )
    return out.fillna({"priority": "none", "action_count": 0, "answer_brief": ""})
