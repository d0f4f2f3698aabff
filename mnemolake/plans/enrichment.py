"""Enrichment queries over the whole document table."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemolake.functions import fixed
from mnemolake.functions.text import query_terms, sentences, stem, strip, tokens
from mnemolake.operators import enrich as e
from mnemolake.operators.retrieval import bm25_search
from mnemolake.plans.retrieval import bm25_sql, topk
from mnemolake.plans.views import Registry, sql

registry = Registry()
add = registry.add


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(words) -> str:
    return "(" + ", ".join(quoted(w) for w in words) + ")"


def ascii_only(column: str, stand_in: str) -> str:
    """RE2 knows only ASCII words: other letters become a stand-in that counts as part of a word."""
    return f"regexp_replace({column}, '[^\\x00-\\x7F]', '{stand_in}', 'g')"


@add("tokenize", "SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents)")
def _(t):
    toks = tokens(F.col("text"))
    return t.documents.select("doc_id", F.size(toks).alias("n"), F.md5(F.array_join(toks, " ")).alias("digest"))


def terms_sql(words) -> str:
    return f"""array_to_string(list_filter(t, lambda x, i: length(x) >= 3 AND x NOT IN {in_list(words)}
        AND list_position(t, x) = i), '|')"""


@add(
    "query_terms",
    f"""SELECT item_id, {terms_sql(fixed.STOP_WORDS_REASONING)} AS reasoning_terms, {terms_sql(fixed.STOP_WORDS_COVERAGE)} AS coverage_terms
    FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM benchmark)""",
)
def _(t):
    return t.benchmark.select(
        "item_id",
        query_terms(F.col("text")).alias("reasoning_terms"),
        query_terms(F.col("text"), fixed.STOP_WORDS_COVERAGE).alias("coverage_terms"),
    )


def stem_sql(column: str) -> str:
    rules = " ".join(
        f"WHEN ends_with({column}, '{s}') AND length({column}) > {len(s) + 1} THEN left({column}, length({column}) - {len(s)}) || '{r}'"
        for s, r in fixed.STEM_RULES
    )
    return f"CASE WHEN length({column}) <= 3 THEN {column} {rules} ELSE {column} END"


@add(
    "stem",
    f"SELECT word, {stem_sql('word')} AS stem FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM documents)",
)
def _(t):
    words = t.documents.select(F.explode(tokens(F.col("text"))).alias("word")).distinct()
    return words.select("word", stem(F.col("word")).alias("stem"))


SPLIT = r"""'[\s,.:;!?()\[\]{}"''/\\]+'"""
TOPICS = f"""words AS (SELECT doc_id, word, pos FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos
        FROM (SELECT doc_id, regexp_split_to_array(lower(text), {SPLIT}) AS w FROM documents)) WHERE length(word) >= 2),
    stems AS (SELECT stem, arg_min(topic, keyword) AS topic FROM (SELECT {stem_sql('keyword')} AS stem, keyword, topic FROM taxonomy_v) GROUP BY stem),
    found AS (SELECT doc_id, pos, coalesce(x.topic, s.topic) AS topic, coalesce(x.weight, 0) AS ew,
        CASE WHEN x.topic IS NULL THEN 1 ELSE 0 END AS sn
        FROM words LEFT JOIN taxonomy_v x ON x.keyword = word LEFT JOIN stems s ON s.stem = {stem_sql('word')}),
    sc AS (SELECT doc_id, topic, round((sum(ew) + 0.8::DOUBLE * sum(sn))::DOUBLE, 6) AS score, count(*) AS hits, min(pos) AS pos
        FROM found WHERE topic IS NOT NULL GROUP BY ALL),
    rk AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS second FROM sc WINDOW w AS (PARTITION BY doc_id ORDER BY score DESC, pos, topic)),
    kt AS (SELECT doc_id, string_agg(topic, '|' ORDER BY r) FILTER (r <= 3) AS topics, max(CASE WHEN r = 1 THEN topic END) AS primary_topic,
        max(CASE WHEN r = 1 THEN round(least(0.95::DOUBLE, (CASE WHEN score >= 10 THEN 0.9 WHEN score >= 6 THEN 0.8 WHEN score >= 3 THEN 0.65
            WHEN score >= 1.5 THEN 0.5 ELSE 0.35 END)::DOUBLE * (CASE WHEN second / score > 0.8 THEN 0.7 WHEN second / score > 0.6 THEN 0.85 ELSE 1 END)::DOUBLE
            + (CASE WHEN hits >= 5 THEN 0.1 WHEN hits >= 3 THEN 0.05 ELSE 0 END)::DOUBLE), 6) END) AS confidence FROM rk GROUP BY doc_id),
    kw AS (SELECT d.doc_id, CASE WHEN length(trim(text)) < 3 OR kt.doc_id IS NULL THEN 'general' ELSE topics END AS topics,
        CASE WHEN length(trim(text)) < 3 OR kt.doc_id IS NULL THEN 'general' ELSE primary_topic END AS primary_topic,
        CASE WHEN length(trim(text)) < 3 THEN 0.0 WHEN kt.doc_id IS NULL THEN 0.2 ELSE confidence END::DOUBLE AS confidence,
        CASE WHEN length(trim(text)) < 3 THEN 'empty_text' WHEN kt.doc_id IS NULL THEN 'keyword_no_match' ELSE 'weighted_keyword_match' END AS method
        FROM documents d LEFT JOIN kt USING (doc_id))"""


@add("keyword_topics", sql("taxonomy_v", f"{TOPICS} SELECT * FROM kw"))
def _(t):
    return e.keyword_topics(t.documents, t.taxonomy)


EMBED = """cent AS (SELECT topic, list(x ORDER BY i) AS v FROM (SELECT topic, i, avg(x::DOUBLE) AS x FROM
        (SELECT 't' || (label % 5) AS topic, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
        GROUP BY topic, i) GROUP BY topic),
    es AS (SELECT doc_id, topic, round(list_dot_product(d.v, c.v) / (sqrt(list_dot_product(d.v, d.v)) * sqrt(list_dot_product(c.v, c.v))), 6) AS s
        FROM doc_vec_v d, cent c),
    er AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, topic) AS r FROM es),
    em AS (SELECT doc_id, coalesce(string_agg(topic, '|' ORDER BY r) FILTER (s > 0.3 AND r <= 3), 'general') AS topics,
        coalesce(max(CASE WHEN r = 1 AND s > 0.3 THEN topic END), 'general') AS primary_topic, max(s) AS confidence,
        CASE WHEN max(s) > 0.3 THEN 'embedding_similarity' ELSE 'embedding_low_match' END AS method FROM er GROUP BY doc_id)"""


def topic_vectors(t):
    named = t.vectors.withColumn("topic_name", F.concat(F.lit("t"), F.col("label") % 5))
    return e.centroids(named, "topic_name")


@add("embedding_topics", sql("doc_vec_v", f"{EMBED} SELECT * FROM em"))
def _(t):
    return e.embedding_topics(t.doc_vectors, topic_vectors(t))


@add(
    "merge_topics",
    sql(
        "taxonomy_v doc_vec_v",
        f"""{TOPICS}, {EMBED}, j AS (SELECT doc_id, kw.topics AS kt_, kw.primary_topic AS kp, kw.confidence AS kc, kw.method AS km,
            em.topics AS et_, em.primary_topic AS ep, em.confidence AS ec, em.method AS emm FROM kw LEFT JOIN em USING (doc_id)),
        c AS (SELECT *, CASE WHEN km = 'empty_text' THEN 'k' WHEN kp <> 'general' AND kc >= 0.6 THEN 'k'
            WHEN ec > 0.4 AND kp <> 'general' THEN 'm' WHEN ec > 0.4 THEN 'e' WHEN kp <> 'general' THEN 'k' ELSE 'f' END AS way FROM j),
        u AS (SELECT doc_id, topic, min(o) AS o, round(sum(w), 6) AS w FROM (
            SELECT doc_id, unnest(string_split(kt_, '|')) AS topic, generate_subscripts(string_split(kt_, '|'), 1) AS o, kc * 0.6::DOUBLE AS w FROM c
            UNION ALL SELECT doc_id, unnest(string_split(et_, '|')), 100 + generate_subscripts(string_split(et_, '|'), 1), ec * 0.4::DOUBLE FROM c)
            GROUP BY ALL),
        ur AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, o) AS r FROM u),
        mm AS (SELECT doc_id, string_agg(topic, '|' ORDER BY r) FILTER (r <= 3) AS mt, max(CASE WHEN r = 1 THEN topic END) AS mp,
            least(0.95::DOUBLE, max(w)) AS mc FROM ur GROUP BY doc_id)
        SELECT doc_id, CASE way WHEN 'k' THEN kt_ WHEN 'm' THEN mt WHEN 'e' THEN et_ ELSE 'general' END AS topics,
        CASE way WHEN 'k' THEN kp WHEN 'm' THEN mp WHEN 'e' THEN ep ELSE 'general' END AS primary_topic,
        CASE way WHEN 'k' THEN kc WHEN 'm' THEN mc WHEN 'e' THEN ec ELSE 0.2 END::DOUBLE AS confidence,
        CASE way WHEN 'k' THEN km WHEN 'm' THEN 'keyword_embedding_merged' WHEN 'e' THEN emm ELSE 'fallback' END AS method
        FROM c JOIN mm USING (doc_id)""",
    ),
)
def _(t):
    return e.merge_topics(
        e.keyword_topics(t.documents, t.taxonomy), e.embedding_topics(t.doc_vectors, topic_vectors(t))
    )


STRIP = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
SENTS = rf"""raw AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(9246), 'g'),
        chr(9246)), lambda x: {STRIP.format(c='x')}), lambda x: length(x) > 20) AS k FROM documents),
    sent AS (SELECT doc_id, len(k) AS total, unnest(k) AS s, generate_subscripts(k, 1) - 1 AS i FROM raw)"""
CUES = " + ".join(f"CAST(contains(lower(s), {quoted(w)}) AS INTEGER)" for w in fixed.CUE_WORDS)
SENT_SCORE = rf"""scored AS (SELECT *, CASE WHEN i < 3 THEN 3 - i ELSE 0 END + CASE WHEN total > 5 AND i >= total - 2 THEN 2 ELSE 0 END
    + CASE WHEN length(s) > 50 AND length(s) < 200 THEN 2 WHEN length(s) > 200 THEN 1 ELSE 0 END + 2 * ({CUES})
    + least(3, len(list_filter(regexp_split_to_array(s, '\s+')[2:], lambda w: regexp_matches(w, '^\p{{Lu}}'))))
    + CAST(regexp_matches({ascii_only('s', '0')}, '\b[a-z]+[A-Z][a-zA-Z]*\b') AS INTEGER)
    + CAST(regexp_matches({ascii_only('s', '0')}, '\b[a-z]+_[a-z]+\b') AS INTEGER) AS score FROM sent)"""


@add(
    "key_sentences",
    f"""WITH {SENTS}, {SENT_SCORE}, o AS (SELECT *, total // 3 AS third, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS ord FROM scored),
    f AS (SELECT doc_id, arg_min(s, ord) AS f FROM o WHERE i < third GROUP BY doc_id),
    m AS (SELECT o.doc_id, arg_min(s, ord) AS m FROM o JOIN f USING (doc_id) WHERE i >= third AND i < 2 * third AND s <> f GROUP BY o.doc_id),
    l AS (SELECT o.doc_id, arg_min(s, ord) AS l FROM o JOIN f USING (doc_id) LEFT JOIN m USING (doc_id)
        WHERE i >= 2 * third AND s <> f AND s IS DISTINCT FROM m GROUP BY o.doc_id),
    p AS (SELECT o.doc_id, s, min(CASE WHEN s = f THEN -3 WHEN s = m THEN -2 WHEN s = l THEN -1 ELSE ord END) AS pr
        FROM o JOIN f USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN l USING (doc_id) WHERE total > 10 GROUP BY o.doc_id, s),
    pick AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY pr) AS r FROM p
        UNION ALL SELECT doc_id, s, ord FROM o WHERE total <= 10)
    SELECT d.doc_id, coalesce(string_agg(s, '|' ORDER BY r) FILTER (r <= 5), left(any_value(d.text), 500)) AS key_sentences
    FROM documents d LEFT JOIN pick USING (doc_id) GROUP BY d.doc_id""",
)
def _(t):
    return e.key_sentences(t.documents, 5)


@add("key_sentences_chunked")
def _(t):
    return e.key_sentences_chunked(t.documents.filter(F.length("text") > 1000), 5)


WORDS_OF = r"regexp_split_to_array(x, '\s+')"
ENTITY_SQL = rf"""es0 AS (SELECT doc_id, text, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(9246), 'g'), chr(9246)) AS ss FROM documents),
    w AS (SELECT doc_id, unnest(flatten(list_transform(ss, lambda x: list_filter(list_transform(list_filter(
        list_filter(regexp_split_to_array({STRIP.format(c='x')}, '\s+'), lambda y: y <> '')[2:], lambda y: length(y) > 2),
        lambda y: regexp_replace(y, '[^\p{{L}}\p{{N}}_]', '', 'g')), lambda y: regexp_matches(y, '^\p{{Lu}}.*\p{{Ll}}'))))) AS e FROM es0),
    a AS (SELECT doc_id, {ascii_only('text', '0')} AS x FROM documents),
    ents AS (SELECT DISTINCT doc_id, e FROM (SELECT * FROM w
        UNION ALL SELECT doc_id, unnest(regexp_extract_all(x, '\b[a-z]+[A-Z][a-zA-Z]*\b')) FROM a
        UNION ALL SELECT doc_id, unnest(regexp_extract_all(x, '\b[a-z]+_[a-z_]+\b')) FROM a
        UNION ALL SELECT doc_id, unnest(regexp_extract_all(x, '\b[A-Z][A-Z_]{{2,}}\b')) FROM a
        UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, {quoted(fixed.QUOTED)}, 1)) FROM documents)),
    er AS (SELECT doc_id, e, row_number() OVER (PARTITION BY doc_id ORDER BY
        -((length(lower(text)) - length(replace(lower(text), lower(e), ''))) / length(e)), e) AS r FROM ents JOIN documents USING (doc_id))"""


@add(
    "key_entities",
    f"""WITH {ENTITY_SQL} SELECT d.doc_id, CASE WHEN length(any_value(text)) < 20 THEN '' ELSE
        coalesce(string_agg(e, '|' ORDER BY r) FILTER (r <= 10), '') END AS entities
    FROM documents d LEFT JOIN er USING (doc_id) GROUP BY d.doc_id""",
)
def _(t):
    return e.key_entities(t.documents)


def all_of(column: str, patterns, group: int = 0, ci: bool = True) -> str:
    flags = "(?i)" if ci else ""
    return " || ".join(f"regexp_extract_all({column}, {quoted(flags + p)}, {group})" for p in patterns)


def first10(expr: str) -> str:
    return f"list_filter({expr}, lambda x, i: list_position({expr}, x) = i)[1:10]"


DATES_RE2 = all_of("u", fixed.DATE_PATTERNS[:-1]) + r" || regexp_extract_all(u, '\b(\d{4})(?:\s|$|[,.])', 1)"
NO_NAMES = in_list(fixed.NO_PERSON_WORDS)
TECH_SQL = " || ".join(
    "CASE WHEN regexp_matches(u, {p}) THEN [{n}] ELSE []::VARCHAR[] END".format(
        p=quoted(r"(?i)\b\Q" + n + r"\E\b"), n=quoted(n)
    )
    for n in fixed.TECHNOLOGY_NAMES
)
STRUCTURED = f"""sx AS (SELECT doc_id, text, {ascii_only('text', '_')} AS u, {ascii_only('text', '0')} AS z FROM documents),
    sr AS (SELECT doc_id, text, u, {all_of('z', [fixed.PERSON_TITLE_PATTERN], 1, False)} ||
            list_filter({all_of('z', fixed.PERSON_CONTEXT_PATTERNS, 1, False)}, lambda x: length(x) > 2 AND x NOT IN {NO_NAMES}) AS persons,
        {all_of('z', [fixed.ORGANIZATION_PATTERN], 1, False)} || {all_of('z', fixed.ORGANIZATION_CONTEXT_PATTERNS, 1, True)} AS orgs,
        list_filter({all_of('z', [fixed.LOCATION_PATTERN], 1, False)}, lambda x: length(x) > 2) AS places,
        {DATES_RE2} AS dates, {all_of('u', fixed.TIME_PATTERNS)} AS times, {all_of('u', fixed.TEMPORAL_PATTERNS)} AS temporal_refs,
        {all_of('u', fixed.QUANTITY_PATTERNS)} AS quantities,
        list_transform({all_of('u', fixed.ACTIVITY_PATTERNS)}, lambda x: lower(x)) AS activities,
        {TECH_SQL} || list_filter({all_of('z', [fixed.CAMEL_CASE_STRICT, fixed.SNAKE_CASE_STRICT], 0, False)}, lambda x: length(x) > 3) AS technologies FROM sx),
    sm AS (SELECT doc_id, {first10('persons')} AS persons, {first10('orgs')} AS organizations,
        list_filter(places, lambda x, i: list_position(places, x) = i AND NOT list_contains(persons, x) AND NOT list_contains(orgs, x))[1:10] AS locations,
        {first10('dates')} AS dates, {first10('times')} AS times, {first10('temporal_refs')} AS temporal_refs,
        {first10('quantities')} AS quantities, {first10('activities')} AS activities, {first10('technologies')} AS technologies FROM sr)"""
FIELDS = ("persons", "organizations", "locations", "dates", "times", "temporal_refs", "quantities", "activities", "technologies")


def hits(column: str, patterns) -> str:
    return " + ".join(f"CAST(regexp_matches({column}, {quoted(p)}) AS INTEGER)" for p in patterns)


UNDER = f"""un AS (SELECT doc_id, source, {ascii_only('text', '_')} AS u, {ascii_only('lower(text)', '_')} AS lu, lower(text) AS low FROM documents)"""
DOC_TYPE = "CASE " + " ".join(
    f"WHEN {hits('lu' if low else 'u', ps)} >= 2 THEN '{name}'" for name, low, ps in fixed.DOCUMENT_TYPES
) + " ELSE 'general' END"


@add(
    "structured_metadata",
    f"""WITH {STRUCTURED}, {UNDER} SELECT doc_id, {', '.join(f"array_to_string({f}, '|') AS {f}" for f in FIELDS)},
    {DOC_TYPE} AS document_type FROM sm JOIN un USING (doc_id)""",
)
def _(t):
    return e.structured_metadata(t.documents)


@add(
    "merge_ner",
    sql(
        "",
        f"""{STRUCTURED}, n0 AS (SELECT doc_id, regexp_extract_all(text, '[A-Z][a-z]{{5,}}') AS names FROM documents),
        n AS (SELECT doc_id, list_filter(names, lambda x, i: length(x) % 2 = 0 AND list_position(names, x) = i) AS o,
            list_filter(names, lambda x, i: length(x) % 2 = 1 AND list_position(names, x) = i) AS l FROM n0),
        b AS (SELECT doc_id, o || organizations AS o, l || locations AS l FROM sm JOIN n USING (doc_id))
        SELECT doc_id, array_to_string({first10('o')}, '|') AS organizations, array_to_string({first10('l')}, '|') AS locations FROM b""",
    ),
)
def _(t):
    return e.merge_ner(e.structured_metadata(t.documents), t.entity_lists).select("doc_id", "organizations", "locations")


@add("document_type", f"WITH {UNDER} SELECT doc_id, {DOC_TYPE} AS document_type FROM un")
def _(t):
    return e.lowered(t.documents).select("doc_id", e.document_type(F.col("text"), F.col("_low")).alias("document_type"))


CONTENT_TYPE = "CASE " + " ".join(
    f"WHEN ({hits('lu' if low else 'u', ps)}) >= 1 {'AND false' if named else ''} THEN '{kind}'"
    for kind, low, named, ps in reversed(fixed.CONTENT_TYPE_PATTERNS)
) + " ELSE 'note' END"


def domain_sql() -> str:
    scores = {n: "(" + " + ".join(f"CAST(contains(low, {quoted(w)}) AS INTEGER)" for w in ws) + ")" for n, ws in fixed.DOMAIN_WORDS}
    top = f"greatest({', '.join(scores.values())})"
    return f"CASE WHEN {top} < 2 THEN 'personal' " + " ".join(f"WHEN {s} = {top} THEN '{n}'" for n, s in scores.items()) + " END"


@add("document_filters", f"WITH {UNDER} SELECT doc_id, {CONTENT_TYPE} AS content_type, {domain_sql()} AS domain FROM un")
def _(t):
    return e.document_filters(t.docs)


def first_all(expr: str) -> str:
    return f"list_filter({expr}, lambda x, i: list_position({expr}, x) = i)"


QTECH = " || ".join(
    "CASE WHEN regexp_matches(u, {p}) THEN [{n}] ELSE []::VARCHAR[] END".format(
        p=quoted(r"(?i)\b\Q" + n + r"\E\b"), n=quoted(n)
    )
    for n in fixed.QUERY_TECHNOLOGIES
)
HINT = "CASE " + " ".join(f"WHEN regexp_matches(lu, {quoted(p)}) THEN '{n}'" for n, p in fixed.DOC_TYPE_HINTS) + " ELSE '' END"


@add(
    "analyze_query",
    rf"""WITH src AS (SELECT 'b' || item_id AS query_id, text FROM benchmark UNION ALL SELECT conv_id || '.' || turn, text FROM conversations),
    q AS (SELECT query_id, text, {ascii_only('text', '_')} AS u, {ascii_only('lower(text)', '_')} AS lu, {ascii_only('text', '0')} AS z FROM src),
    a AS (SELECT *, {hits('lu', fixed.FILTER_PHRASES)} > 0 AS intent, {QTECH} AS tech,
        list_filter({all_of('z', fixed.QUERY_PERSON_PATTERNS, 1, False)}, lambda x: length(x) > 2 AND x NOT IN {in_list(fixed.QUERY_NO_PERSON_WORDS)}) AS p0,
        {all_of('u', fixed.QUERY_DATE_PATTERNS)} AS dates, {HINT} AS hint,
        len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS words FROM q),
    b AS (SELECT *, {first_all('p0')} AS persons FROM a),
    c AS (SELECT *, list_filter({all_of('z', fixed.QUERY_ORGANIZATION_PATTERNS, 1, False)}, lambda x: length(x) > 2 AND NOT list_contains(persons, x)) AS orgs FROM b),
    d AS (SELECT *, list_filter({all_of('z', [fixed.QUERY_LOCATION_PATTERN], 1, False)}, lambda x: length(x) > 2 AND NOT list_contains(persons, x)
        AND NOT list_contains(orgs, x)) AS locs, round(least(1.0, CASE WHEN intent THEN 0.4 ELSE 0 END + CASE WHEN len(persons) > 0 THEN 0.2 ELSE 0 END
        + CASE WHEN len(tech) = 1 THEN 0.15 ELSE 0 END + CASE WHEN hint <> '' THEN 0.15 ELSE 0 END + CASE WHEN len(orgs) > 0 THEN 0.1 ELSE 0 END
        + CASE WHEN words <= 5 AND (len(persons) > 0 OR len(tech) > 0) THEN 0.2 ELSE 0 END)::DOUBLE, 6) AS fc FROM c)
    SELECT query_id, array_to_string(persons, '|') AS persons, array_to_string(orgs, '|') AS organizations, array_to_string(locs, '|') AS locations,
    array_to_string(tech, '|') AS technologies, array_to_string(dates, '|') AS dates, hint AS doc_type_hint, fc AS filter_confidence,
    fc > 0.5 AS use_filters FROM d""",
)
def _(t):
    chats = t.conversations.select(F.concat_ws(".", "conv_id", "turn").alias("query_id"), "text")
    asked = t.benchmark.select(F.concat(F.lit("b"), "item_id").alias("query_id"), "text").unionByName(chats)
    return e.analyze_query(asked)


def hit_pairs(t):
    hits = bm25_search(t.queries, t.documents)
    return hits.join(t.queries.select("query_id", F.col("text").alias("query")), "query_id").join(
        t.documents.select("doc_id", "text"), "doc_id"
    ).select("query_id", "doc_id", "query", "text")


@add(
    "passage_window",
    sql(
        "queries_v",
        rf"""{bm25_sql()}, pw AS (SELECT h.query_id, h.doc_id, d.text, string_split(regexp_replace(d.text, '([.!?])\s+', '\1' || chr(9246), 'g'), chr(9246)) AS ss,
            list_distinct(list_filter(regexp_extract_all(lower(q.text), '[\p{{L}}\p{{N}}_]+'), lambda x: length(x) > 2)) AS words
            FROM ({topk('bm', 10)}) h JOIN queries_v q USING (query_id) JOIN documents d USING (doc_id)),
        sx AS (SELECT query_id, doc_id, words, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM pw),
        sb AS (SELECT query_id, doc_id, max(n) AS n, arg_min(i, (-n, i)) AS best_at FROM (SELECT query_id, doc_id, i,
            len(list_filter(words, lambda w: contains(lower(s), w))) AS n FROM sx) GROUP BY query_id, doc_id),
        j AS (SELECT *, array_to_string(ss[greatest(best_at - 1, 1):best_at + 2], ' ') AS win, left(text, 500) AS head FROM pw JOIN sb USING (query_id, doc_id))
        SELECT query_id, doc_id, CASE WHEN length(text) <= 500 THEN text WHEN n > 0 THEN
            CASE WHEN length(win) > 500 THEN regexp_replace(left(win, 500), '\s+$', '') || '...' ELSE win END
            WHEN length(regexp_extract(head, '(?s)^.*\.')) - 1 > 250 THEN regexp_extract(head, '(?s)^.*\.')
            ELSE regexp_replace(head, '\s+$', '') || '...' END AS excerpt,
        CASE WHEN length(text) <= 500 THEN 1.0 WHEN n > 0 THEN round(least(0.7, 0.3 + 0.1 * n), 6) ELSE 0.3 END::DOUBLE AS confidence,
        CASE WHEN length(text) <= 500 THEN 'full' ELSE 'window' END AS method FROM j""",
    ),
)
def _(t):
    return e.passage_window(hit_pairs(t))


@add(
    "passage_embedding",
    sql(
        "queries_v vec_n query_vec_v",
        rf"""{bm25_sql()}, {SENTS}, sv AS (SELECT doc_id, i AS pos, s AS sentence, CAST(e.embedding AS DOUBLE[]) AS v FROM sent
            JOIN embeddings e ON e.vec_id = (doc_id * 31 + i) % (SELECT n FROM vec_n)),
        x AS (SELECT h.query_id, h.doc_id, pos, sentence, round(list_dot_product(q.v, sv.v)
            / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(sv.v, sv.v))), 6) AS sim
            FROM ({topk('bm', 10)}) h JOIN query_vec_v q USING (query_id) JOIN sv USING (doc_id)),
        r AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY sim DESC, pos) <= 3),
        g AS (SELECT query_id, doc_id, string_agg(sentence, ' ' ORDER BY pos) AS e, round(avg(sim), 6) AS confidence FROM r GROUP BY ALL)
        SELECT query_id, doc_id, CASE WHEN length(e) > 500 THEN regexp_replace(left(e, 500), '\s+$', '') || '...' ELSE e END AS excerpt,
        confidence, confidence > 0.3 AS used FROM g""",
    ),
)
def _(t):
    hits = bm25_search(t.queries, t.documents)
    kept = F.filter(F.transform(sentences(F.col("text")), lambda s: strip(s)), lambda s: F.length(s) > 20)
    # only the documents that were hit are cut into sentences
    found = t.documents.join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    sents = found.select("doc_id", F.posexplode(kept).alias("pos", "sentence"))
    n = t.embeddings.agg(F.count("*")).scalar()
    vectors = sents.withColumn("vec_id", (F.col("doc_id") * 31 + F.col("pos")) % n).join(
        t.embeddings.select("vec_id", F.col("embedding").alias("vector")), "vec_id"
    )
    pairs = hits.join(t.query_vectors.select("query_id", "embedding"), "query_id")
    return e.passage_embedding(pairs.select("query_id", "doc_id", "embedding"), vectors)


@add("enrich_documents")
def _(t):
    return e.enrich_documents(t.docs, t.taxonomy)
