"""Identity, duplicates, chunking and listing over the document table."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemolake.operators import chunking, identity, listing
from mnemolake.plans.views import Registry, sql

registry = Registry()
add = registry.add

HASH = "sha256(CASE WHEN coalesce(source, '') = '' THEN text ELSE source || ':' || text END)"
FLAT = r"trim(regexp_replace(lower(CASE WHEN coalesce(text, '') = '' THEN coalesce(title, '') ELSE text END), '\s+', ' ', 'g'))"
# chunk recurrence, one row per step
CHUNKS = r"""RECURSIVE steps AS (
    SELECT doc_id, text, length(text) AS n, 0 AS idx, 0 AS pos, CASE WHEN length(text) <= 1000 THEN length(text)
        WHEN length(regexp_extract(substring(text, 802, 200), '(?s)^.*[.!?\n]')) > 0
        THEN 801 + length(regexp_extract(substring(text, 802, 200), '(?s)^.*[.!?\n]')) ELSE 1000 END AS fin
    FROM documents WHERE length(text) > 2000
    UNION ALL
    SELECT doc_id, text, n, idx + 1, fin - 150, CASE WHEN fin - 150 + 1000 >= n THEN n
        WHEN length(regexp_extract(substring(text, fin - 150 + 802, 200), '(?s)^.*[.!?\n]')) > 0
        THEN fin - 150 + 801 + length(regexp_extract(substring(text, fin - 150 + 802, 200), '(?s)^.*[.!?\n]'))
        ELSE fin - 150 + 1000 END
    FROM steps WHERE fin - 150 < n - 150),
chunks AS (SELECT doc_id || '#' || idx AS chunk_id, doc_id AS parent_id, idx AS chunk_index, pos AS char_start,
    fin AS char_end, substring(text, pos + 1, fin - pos) AS text FROM steps)
"""


@add("content_hash", f"SELECT doc_id, {HASH} AS content_hash FROM documents")
def _(t):
    return identity.add_content_hash(t.documents).select("doc_id", "content_hash")


# the store holds the first half of the sources, their chunks included; the other half arrives
STORED = "CAST(substring(source, 4) AS INTEGER) < 10"


@add(
    "dedupe_documents",
    f"""WITH {CHUNKS}, pool AS (
        SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN {STORED} THEN 0 ELSE 1 END AS tier, doc_id AS seq, {HASH} AS h
        FROM documents
        UNION ALL SELECT c.chunk_id, 0, c.parent_id, sha256(d.source || ':' || c.text)
        FROM chunks c JOIN documents d ON d.doc_id = c.parent_id WHERE {STORED}),
    win AS (SELECT h, arg_min(id, (tier, seq, id)) AS existing_id, min(tier) AS tier FROM pool GROUP BY h)
    SELECT doc_id, win.h AS content_hash, existing_id, win.tier = 0 OR existing_id <> CAST(doc_id AS VARCHAR) AS is_duplicate
    FROM (SELECT doc_id, {HASH} AS h FROM documents WHERE NOT {STORED}) n JOIN win ON win.h = n.h""",
)
def _(t):
    docs = t.documents.select(F.col("doc_id").cast("string").alias("id"), "doc_id", "text", "source")
    stored = F.expr(STORED)
    rows = docs.select(F.col("id").alias("doc_id"), F.col("doc_id").alias("seq"), "text", "source", stored.alias("s"))
    chunks = chunking.chunk_documents(t.documents.filter(stored)).join(
        t.documents.select(F.col("doc_id").alias("parent_id"), "source"), "parent_id"
    )
    chunk_rows = chunks.select(F.col("chunk_id").alias("doc_id"), F.col("parent_id").alias("seq"), "text", "source")
    out = identity.dedupe_documents(rows.filter("not s").drop("s"), rows.filter("s").drop("s"), chunk_rows)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


@add(
    "duplicate_groups",
    sql(
        "docs_v",
        f"""fp AS (SELECT doc_id, title, sha256({FLAT}) AS f FROM docs_v WHERE {FLAT} <> ''),
        g AS (SELECT f, count(*) AS group_size, min(doc_id) AS first_doc_id FROM fp GROUP BY f HAVING count(*) >= 2)
        SELECT 'duplicate_group:' || left(f, 12) AS group_id, left(f, 16) AS fingerprint, doc_id, title, group_size,
        first_doc_id FROM fp JOIN g USING (f)""",
    ),
)
def _(t):
    return identity.duplicate_groups(t.docs)


@add(
    "dedupe_messages",
    """SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (
        PARTITION BY conv_id, role, left(text, 100) ORDER BY turn) = 1""",
)
def _(t):
    return identity.dedupe_messages(t.conversations)


@add(
    "merge_metadata",
    sql(
        "docs_v",
        """SELECT d.doc_id, d.source, CASE WHEN l.doc_id IS NULL THEN d.lang ELSE 'reviewed' END AS lang,
        coalesce(CAST(l.quality AS VARCHAR), '') AS quality,
        CASE WHEN l.doc_id IS NULL THEN '' ELSE '2026-06-01T12:00:00Z' END AS updated_at, length(d.text) AS n
        FROM docs_v d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    ),
)
def _(t):
    docs = t.docs.select(
        "doc_id", "text", F.create_map(F.lit("source"), "source", F.lit("lang"), "lang").alias("metadata")
    )
    changes = t.labels.select(
        "doc_id",
        F.lit(None).cast("string").alias("text"),
        F.create_map(F.lit("lang"), F.lit("reviewed"), F.lit("quality"), F.col("quality").cast("string")).alias("metadata"),
    )
    out = identity.merge_metadata(docs, changes, "2026-06-01T12:00:00Z")
    get = lambda k: F.coalesce(F.col("metadata")[k], F.lit("")).alias(k)
    return out.select("doc_id", get("source"), get("lang"), get("quality"), get("updated_at"), F.length("text").alias("n"))


@add(
    "merge_metadata_repeated",
    """SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN d.lang ELSE 'checked' END AS lang,
        coalesce(CAST(l.quality AS VARCHAR), '') AS quality, CASE WHEN l.doc_id IS NULL THEN length(d.text) ELSE 3 END AS n
        FROM documents d LEFT JOIN (SELECT doc_id, any_value(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id""",
)
def _(t):
    docs = t.documents.select("doc_id", "text", F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"))
    label = t.labels.select("doc_id", F.col("quality").cast("string").alias("q"))

    def update(seq, text, **values):
        pairs = [x for k, v in values.items() for x in (F.lit(k), v)]
        return label.select("doc_id", F.lit(seq).alias("seq"), F.lit(text).cast("string").alias("text"), F.create_map(*pairs).alias("metadata"))

    changes = update(1, "first text", lang=F.lit("reviewed"), quality=F.col("q")).unionByName(
        update(3, None, lang=F.lit("checked"))
    ).unionByName(update(2, "new", lang=F.lit("wrong")))
    out = identity.merge_metadata(docs, changes, "2026-06-01T12:00:00Z")
    return out.select(
        "doc_id", F.col("metadata")["lang"].alias("lang"), F.coalesce(F.col("metadata")["quality"], F.lit("")).alias("quality"),
        F.length("text").alias("n"),
    )


@add(
    "delete_documents",
    f"""WITH {CHUNKS}, rows AS (SELECT CAST(doc_id AS VARCHAR) AS row_id, doc_id AS own FROM documents
        UNION ALL SELECT chunk_id, parent_id FROM chunks)
    SELECT row_id FROM rows WHERE own NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
)
def _(t):
    rows = t.documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(None).cast("string").alias("parent_id"))
    chunks = chunking.chunk_documents(t.documents).select(
        F.col("chunk_id").alias("doc_id"), F.col("parent_id").cast("string").alias("parent_id")
    )
    gone = t.labels.filter("toxic = 1").select(F.col("doc_id").cast("string").alias("doc_id"))
    return identity.delete_documents(rows.unionByName(chunks), gone).select(F.col("doc_id").alias("row_id"))


@add(
    "undirected_edge_dedupe",
    """SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b
    FROM lineitem WHERE l_partkey <> l_suppkey""",
)
def _(t):
    return identity.undirected_edge_dedupe(
        t.lineitem.select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    )


@add("chunk_documents", f"WITH {CHUNKS} SELECT * FROM chunks")
def _(t):
    return chunking.chunk_documents(t.documents)


@add(
    "chunk_parents",
    f"""WITH {CHUNKS} SELECT parent_id, n AS full_text_length, count(*) AS chunk_count,
    string_agg(chunk_id, '|' ORDER BY chunk_index) AS chunk_ids, true AS is_parent
    FROM chunks JOIN (SELECT DISTINCT doc_id, n FROM steps) s ON s.doc_id = parent_id GROUP BY ALL""",
)
def _(t):
    return chunking.chunk_parents(t.documents, chunking.chunk_documents(t.documents))


@add(
    "document_chunks",
    f"""WITH {CHUNKS} SELECT chunk_id, parent_id, chunk_index, length(text) AS n FROM chunks
    WHERE parent_id IN (SELECT doc_id FROM labels WHERE quality = 1)""",
)
def _(t):
    parents = t.labels.filter("quality = 1").select(F.col("doc_id").alias("parent_id"))
    out = chunking.document_chunks(chunking.chunk_documents(t.documents), parents)
    return out.select("chunk_id", "parent_id", "chunk_index", F.length("text").alias("n"))


DATED = "coalesce(strftime(doc_date, '%Y-%m-%d'), '') AS doc_date"


def dated(df):
    return df.select("doc_id", "title", F.coalesce(F.date_format("doc_date", "yyyy-MM-dd"), F.lit("")).alias("doc_date"))


@add(
    "list_documents",
    sql("docs_v", f"SELECT doc_id, title, {DATED} FROM docs_v ORDER BY docs_v.doc_date DESC NULLS LAST, doc_id LIMIT 20 OFFSET 20"),
)
def _(t):
    return dated(listing.list_documents(t.docs, page=2, sort_by="doc_date"))


@add(
    "list_documents_by_id",
    sql("docs_v", f"SELECT doc_id, title, {DATED} FROM docs_v ORDER BY CAST(doc_id AS VARCHAR) LIMIT 20"),
)
def _(t):
    return dated(listing.list_documents(t.docs, sort_by="id", descending=False))


@add(
    "list_documents_keyset",
    sql(
        "docs_v",
        f"""SELECT doc_id, title, {DATED} FROM docs_v WHERE docs_v.doc_date < DATE '2026-01-15'
        OR (docs_v.doc_date = DATE '2026-01-15' AND doc_id > 5) ORDER BY docs_v.doc_date DESC, doc_id LIMIT 20""",
    ),
)
def _(t):
    from datetime import date

    return dated(listing.list_documents_after(t.docs, date(2026, 1, 15), 5, sort_by="doc_date"))


@add(
    "page_stats",
    """SELECT count(*) AS total, 2 AS page, 20 AS page_size, greatest(ceil(count(*) / 20.0), 1)::BIGINT AS total_pages,
    2 < greatest(ceil(count(*) / 20.0), 1) AS has_next, true AS has_prev FROM documents""",
)
def _(t):
    return listing.page_stats(t.documents, 2, 20)


@add("get_document", "SELECT doc_id, text, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(t):
    return listing.get_documents(t.documents, t.labels.filter("toxic = 1")).select("doc_id", "text", "source")


@add("documents_chronological", sql("docs_v", f"SELECT doc_id, title, {DATED} FROM docs_v"))
def _(t):
    return dated(listing.documents_chronological(t.docs, "doc_date"))


@add("corpus_stats", f"SELECT count(*) AS document_count, count(DISTINCT {HASH}) AS unique_hashes FROM documents")
def _(t):
    return listing.corpus_stats(identity.add_content_hash(t.documents))


def _cut(limit: int, keep: int) -> str:
    return f"CASE WHEN length(f) <= {limit} THEN f ELSE rtrim(left(f, {keep})) || '...' END"


@add(
    "preview",
    rf"""SELECT doc_id, {_cut(500, 497)} AS memory_preview, {_cut(280, 277)} AS maintenance_preview,
    {_cut(700, 699)} AS excerpt FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS f FROM documents)""",
)
def _(t):
    return listing.previews(t.documents)


@add(
    "context_metadata",
    """SELECT doc_id, CASE WHEN text LIKE '%@%' THEN 'redacted/' || doc_id ELSE 'raw/' || doc_id END AS image_path,
    text NOT LIKE '%@%' AS keeps_original FROM documents""",
)
def _(t):
    doc = F.col("doc_id").cast("string")
    bag = F.create_map(
        F.lit("has_pii"), F.contains("text", F.lit("@")).cast("string"),
        F.lit("image_path"), F.concat(F.lit("raw/"), doc),
        F.lit("original_image_path"), F.concat(F.lit("raw/"), doc),
        F.lit("redacted_image_path"), F.concat(F.lit("redacted/"), doc),
    )
    rows = t.documents.select("doc_id", listing.context_metadata(bag).alias("m"))
    return rows.select(
        "doc_id", F.col("m")["image_path"].alias("image_path"),
        F.map_contains_key("m", "original_image_path").alias("keeps_original"),
    )


@add("sanitize_metadata", "SELECT event_id, props AS props, 'value' AS map_keys FROM events")
def _(t):
    tagged = F.concat(
        F.expr("left(props, length(props) - 1)"), F.lit(', "pii_session_id": "s'), "user_id", F.lit('", "persons": ["u'),
        "user_id", F.lit('"]}'),
    )
    bag = F.create_map(
        F.lit("value"), F.col("value").cast("string"), F.lit("piiSessionId"), F.col("user_id").cast("string")
    )
    return t.events.select(
        "event_id",
        listing.sanitize_json(tagged).alias("props"),
        F.map_keys(listing.sanitize_map(bag)).alias("map_keys"),
    )


@add(
    "sanitize_metadata_nested",
    """SELECT event_id, '{"a": [{"k": ' || user_id || '}], "b": {"c": "x, }{"}}' AS clean FROM events""",
)
def _(t):
    user = F.col("user_id").cast("string")
    raw = F.concat(
        F.lit('{"persons": {"u"'), F.lit(': {"name": ["Ann", {"of": "Lee"}]}}, "a": [{"k": '), user,
        F.lit(', "pii_session_id": {"x": [1, [2]]}}], "b": {"c": "x, }{", "persons": [["'), user, F.lit('"]]}}'),
    )
    return t.events.select("event_id", listing.sanitize_json(raw).alias("clean"))


@add(
    "public_memory_view",
    sql("memory_v", """SELECT doc_id, kind, workspace, memory_key, state, version,
        strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM memory_v"""),
)
def _(t):
    out = listing.public_memory_view(t.memories)
    return out.drop("expires_at")
