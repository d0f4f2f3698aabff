"""Source queries. Exports, folders and batches are derived by Spark from the whole given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemolake.operators import identity
from mnemolake.plans.documents import HASH
from mnemolake.plans.views import Registry, sql
from mnemolake.session import scratch_path
from mnemolake.sources import exports as x, files as f, sinks, sync

registry = Registry()
add = registry.add

STRIP = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def lit(value):
    return F.lit(value)


# --- folders ------------------------------------------------------------------------------------------
def written_corpus(t) -> str:
    path = scratch_path(t.spark, "corpus")
    t.documents.select("source", "text").write.partitionBy("source").text(path)
    return path


@add("scan_text_corpus")
def _(t):
    docs, _ = f.scan_text_corpus(t.spark, written_corpus(t), metadata={"batch": "check"})
    return docs.select("filename", "extension", "relative_path", "batch", F.octet_length("text").alias("bytes"))


@add("scan_file_metadata")
def _(t):
    return f.scan_file_metadata(t.spark, written_corpus(t)).select("filename", "extension", "size")


@add(
    "import_summary",
    """SELECT count(*) AS document_count, count(*) AS filename_count, 'txt' AS extensions, sum(strlen(text))::BIGINT AS total_text_bytes,
    'extension|filename|source' AS metadata_keys FROM documents""",
)
def _(t):
    docs = t.docs.withColumn("extension", F.regexp_extract("filename", r"\.([^.]+)$", 1))
    bag = F.create_map(lit("filename"), "filename", lit("extension"), "extension", lit("source"), "source")
    return f.import_summary(docs.withColumn("metadata", bag))


# --- chat and page exports --------------------------------------------------------------------------------
@add(
    "flatten_chat_mapping",
    f"""SELECT conv_id AS export_id, 'Chat ' || conv_id AS title, row_number() OVER (PARTITION BY conv_id ORDER BY ct, turn) - 1 AS pos, role, {STRIP.format(c='text')} AS text,
    ct AS create_time FROM (SELECT *, CASE WHEN turn = 0 THEN 0 WHEN conv_id % 2 = 0 THEN 10 * turn ELSE 1000 - turn END::DOUBLE AS ct FROM conversations)
    WHERE {STRIP.format(c='text')} <> ''""",
)
def _(t):
    turn, conv = F.col("turn"), F.col("conv_id")
    when = F.when(turn == 0, None).when(conv % 2 == 0, turn * 10).otherwise(1000 - turn).cast("double")
    message = F.struct(
        F.struct("role").alias("author"), F.struct(F.split("text", "\n").alias("parts")).alias("content"), when.alias("create_time")
    )
    node = F.struct(F.concat(lit("n"), turn).alias("key"), F.struct(message.alias("message")).alias("value"))
    nodes = t.conversations.select("conv_id", turn.alias("turn"), node.alias("node")).groupBy("conv_id").agg(
        F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("turn", "node"))), lambda n: n["node"])).alias("mapping")
    )
    raw = F.to_json(F.struct(conv.cast("string").alias("id"), F.concat(lit("Chat "), conv).alias("title"), "mapping"))
    return x.flatten_chat_mapping(nodes.select(conv.alias("export_id"), raw.alias("raw")))


def shaped(t):
    """One export per document; its shape goes by the id."""
    d, text, src = F.col("doc_id"), F.col("text"), F.col("source")
    title = F.concat(lit("T"), d)
    js = lambda *cols: F.to_json(F.struct(*cols))
    kind = lambda k: lit(k).alias("type")
    message = lambda who: F.array(F.struct(src.alias(who), text.alias("content")))
    raw = (
        F.when(d % 8 == 0, js(title.alias("title"), message("role").alias("messages")))
        .when(d % 8 == 1, js(kind("page"), title.alias("title"), text.alias("content")))
        .when(d % 8 == 2, js(kind("database"), title.alias("title"), F.array(F.struct(
            F.concat(lit("E"), d).alias("title"), F.create_map(lit("lang"), "lang", lit("source"), src).alias("properties"))).alias("entries")))
        .when(d % 8 == 3, js(kind("post"), title.alias("title"), text.alias("content"), F.array(src, "lang").alias("attachments")))
        .when(d % 8 == 4, js(kind("comment"), title.alias("title"), text.alias("content")))
        .when(d % 8 == 5, js(kind("message_thread"), title.alias("title"), message("sender").alias("messages")))
        .when(d % 8 == 6, js(kind("facebook_data"), lit("interests").alias("category"), F.struct(
            title.alias("title"), F.array(F.struct(text.alias("text")), F.struct(lit("ab").alias("text")), F.struct(src.alias("text"))).alias("data")).alias("data")))
        .otherwise(js(lit("N").alias("name"), text.alias("text")))
    )
    return t.documents.select(d.alias("export_id"), raw.alias("raw"))


@add(
    "normalize_exports",
    rf"""WITH s AS (SELECT *, doc_id % 8 AS k, 'T' || doc_id AS title, chr(10) AS nl FROM documents),
    o AS (SELECT doc_id AS export_id, 0 AS part, CASE k WHEN 0 THEN 'chat' WHEN 1 THEN 'page' WHEN 2 THEN 'database' WHEN 3 THEN 'post' WHEN 4 THEN 'comment'
        WHEN 5 THEN 'message' WHEN 6 THEN 'data' ELSE 'generic' END AS kind,
        CASE k WHEN 0 THEN text WHEN 1 THEN '# ' || title || nl || nl || text WHEN 2 THEN '# E' || doc_id || nl || nl || 'Database: ' || title || nl || nl || 'lang: ' || lang || nl || 'source: ' || source
            WHEN 3 THEN {STRIP.format(c="title || nl || nl || text || nl || nl || source || nl || lang")} WHEN 4 THEN {STRIP.format(c="'Comment on: ' || title || nl || nl || text")}
            WHEN 5 THEN '[' || source || ']: ' || text WHEN 6 THEN 'Facebook interests:' || nl || array_to_string(list_filter([title, text, source], lambda v: length(v) > 3), chr(10)) ELSE text END AS text,
        CASE k WHEN 2 THEN 'E' || doc_id WHEN 6 THEN 'interests' WHEN 7 THEN 'N' ELSE title END AS title, k, text AS raw_text FROM s)
    SELECT export_id, part, kind, text, title FROM o WHERE NOT (k = 5 AND length(raw_text) < 5) AND NOT (k IN (0, 1, 4, 7) AND raw_text = '')""",
)
def _(t):
    return x.normalize_exports(shaped(t))


@add("count_export_items", "SELECT doc_id AS export_id, 1 AS items FROM documents")
def _(t):
    return x.count_export_items(shaped(t))


@add(
    "facebook_posts",
    """SELECT doc_id AS export_id, 0 AS part, 1700000000 + doc_id AS timestamp, strftime(make_timestamp((1700000000 + doc_id) * 1000000), '%Y-%m-%d %H:%M:%S') AS date,
    'Post' AS title, text AS content, lang || '|' || source AS attachments, lang AS tags FROM documents WHERE doc_id % 10 <> 0""",
)
def _(t):
    d = F.col("doc_id")
    post = F.struct(
        F.when(d % 10 != 0, d + 1700000000).otherwise(0).alias("timestamp"), lit("Post").alias("title"),
        F.array(F.struct(F.col("text").alias("post"))).alias("data"),
        F.array(F.struct(F.array(F.struct(F.col("lang").alias("text"), F.struct(F.col("source").alias("name")).alias("external_context"))).alias("data"))).alias("attachments"),
        F.array(F.struct(F.col("lang").alias("name"))).alias("tags"),
    )
    return x.facebook_posts(t.documents.select(d.alias("export_id"), F.to_json(F.array(post)).alias("raw")))


@add(
    "facebook_comments",
    """SELECT doc_id AS export_id, 0 AS part, 1700000000 + doc_id AS timestamp, strftime(make_timestamp((1700000000 + doc_id) * 1000000), '%Y-%m-%d %H:%M:%S') AS date,
    'C' AS title, text AS content FROM documents WHERE text <> ''""",
)
def _(t):
    d = F.col("doc_id")
    stamp = (d + 1700000000).alias("timestamp")
    nested = F.struct(lit("C").alias("title"), F.array(F.struct(F.struct(stamp, F.col("text").alias("comment")).alias("comment"))).alias("data"))
    flat = F.struct(lit("C").alias("title"), stamp, F.col("text").alias("comment"))
    raw = F.when(d % 2 == 0, F.to_json(F.struct(F.array(nested).alias("comments")))).otherwise(F.to_json(F.struct(F.array(flat).alias("comments"))))
    return x.facebook_comments(t.documents.select(d.alias("export_id"), raw.alias("raw")))


def threads(t):
    d = F.col("conv_id")
    message = F.struct(
        (-F.col("turn")).alias("o"), F.col("role").alias("sender_name"), ((d * 100 + F.col("turn")) * 1000 + 1700000000000).alias("timestamp_ms"),
        F.when(F.col("turn") != 1, F.col("text")).alias("content"), F.when(F.col("turn") == 1, F.struct(F.col("text").alias("share_text"))).alias("share"),
        F.when(F.col("turn") == 2, F.array(lit("p.jpg"))).alias("photos"),
    )
    packed = t.conversations.select("conv_id", "role", message.alias("m")).groupBy("conv_id").agg(
        F.array_sort(F.collect_list("m")).alias("messages"), F.transform(F.array_sort(F.collect_set("role")), lambda r: F.struct(r.alias("name"))).alias("participants")
    )
    title = F.when(d % 2 == 0, F.concat(lit("Thread "), d)).alias("title")
    return packed.select(d.alias("export_id"), F.to_json(F.struct(title, "participants", "messages")).alias("raw"))


MS = "strftime(make_timestamp((1700000000 + {e}) * 1000000), '%Y-%m-%d %H:%M:%S')"


@add(
    "facebook_threads",
    f"""WITH p AS (SELECT conv_id, string_agg(DISTINCT role, ', ' ORDER BY role) AS participants, count(*) AS message_count, min(turn) AS a, max(turn) AS b FROM conversations GROUP BY conv_id)
    SELECT conv_id AS export_id, CASE WHEN conv_id % 2 = 0 THEN 'Thread ' || conv_id ELSE 'Chat with ' || participants END AS title, participants, message_count,
    {MS.format(e='conv_id * 100 + a')} AS first_message, {MS.format(e='conv_id * 100 + b')} AS last_message FROM p""",
)
def _(t):
    return x.facebook_messages(threads(t))[0]


@add(
    "facebook_messages",
    f"""SELECT conv_id AS export_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS part, role AS sender,
    {MS.format(e='conv_id * 100 + turn')} AS date, text AS content, turn = 2 AS has_media FROM conversations""",
)
def _(t):
    return x.facebook_messages(threads(t))[1]


@add("fix_mojibake", "SELECT doc_id, text FROM documents")
def _(t):
    code = lambda m: F.lower(F.lpad(F.hex(F.ascii(m)), 2, "0"))
    broken = x.rebuild_matches(F.col("text"), "[\u0080-ÿ]", lambda m: F.concat(lit("\\u00"), code(m)))
    return x.fix_mojibake_all(t.documents.select("doc_id", broken.alias("text")))


@add(
    "flatten_properties",
    """SELECT doc_id AS page_id, 'Name: Doc ' || doc_id || chr(10) || 'Lang: ' || lang || chr(10) || 'Size: ' || n_chars || chr(10) || 'Even: ' || CASE WHEN doc_id % 2 = 0 THEN 'Yes' ELSE 'No' END
    || chr(10) || 'Tags: ' || lang || ', ' || source AS text FROM documents""",
)
def _(t):
    d = F.col("doc_id")
    names = lambda *cols: F.array(*[F.struct(F.col(c).alias("name")) for c in cols])
    entry = lambda kind, field, value: F.struct(lit(kind).alias("type"), value.alias(field))
    raw = F.to_json(F.struct(
        entry("title", "title", F.array(F.struct(lit("Doc ").alias("plain_text")), F.struct(d.cast("string").alias("plain_text")))).alias("Name"),
        entry("select", "select", F.struct(F.col("lang").alias("name"))).alias("Lang"), entry("number", "number", F.col("n_chars")).alias("Size"),
        entry("checkbox", "checkbox", d % 2 == 0).alias("Even"), entry("multi_select", "multi_select", names("lang", "source")).alias("Tags"),
        entry("url", "url", lit("")).alias("Link"), entry("formula", "number", d).alias("Calc"),
    ))
    return x.flatten_properties(t.documents.select(d.alias("page_id"), raw.alias("properties")))


@add(
    "documents_with_highlights",
    """WITH h AS (SELECT conv_id, string_agg('> ' || text || CASE WHEN role = 'assistant' THEN chr(10) || chr(10) || 'Note: by ' || role ELSE '' END || chr(10) || 'Tags: ' || role || ', t' || turn,
        chr(10) || chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id)
    SELECT conv_id AS doc_id, 0 AS part, '# Chat ' || conv_id || chr(10) || chr(10) || CASE WHEN conv_id % 2 = 0 THEN 'Author: A' || (conv_id % 3) || chr(10) || chr(10) ELSE '' END
    || chr(10) || '## Summary' || chr(10) || 'S' || conv_id || chr(10) || chr(10) || 'Tags: saved' || chr(10) || chr(10) || chr(10) || '## Highlights' || chr(10) || chr(10) || body AS text FROM h""",
)
def _(t):
    d = F.col("conv_id")
    none = lit(None).cast("string")
    docs = t.conversations.select("conv_id").distinct().select(
        d.alias("doc_id"), F.concat(lit("Chat "), d).alias("title"), F.when(d % 2 == 0, F.concat(lit("A"), d % 3)).alias("author"), none.alias("source"),
        none.alias("category"), none.alias("published_date"), F.concat(lit("S"), d).alias("summary"), none.alias("notes"), F.array(lit("saved")).alias("tags"),
    )
    marks = t.conversations.select(
        d.alias("doc_id"), F.col("turn").alias("pos"), "text", F.when(F.col("role") == "assistant", F.concat(lit("by "), "role")).alias("note"),
        F.array(F.col("role"), F.concat(lit("t"), "turn")).alias("tags"),
    )
    return x.documents_with_highlights(docs, marks)


@add(
    "extract_json_text",
    """SELECT doc_id AS file_id, CASE doc_id % 4 WHEN 0 THEN text || chr(10) || source WHEN 1 THEN text || chr(10) || lang WHEN 2 THEN 'Title: T' || chr(10) || source || ': ' || text
    ELSE '{"n":' || n_chars || ',"lang":"' || lang || '"}' END AS text FROM documents""",
)
def _(t):
    d = F.col("doc_id")
    raw = (
        F.when(d % 4 == 0, F.to_json(F.array(F.struct(F.col("text").alias("text"), lit("x").alias("title")), F.struct(lit(None).cast("string").alias("text"), F.col("source").alias("title")))))
        .when(d % 4 == 1, F.to_json(F.array("text", "lang")))
        .when(d % 4 == 2, F.to_json(F.struct(lit("T").alias("title"), F.array(F.struct(F.col("source").alias("role"), F.col("text").alias("content"))).alias("messages"))))
        .otherwise(F.to_json(F.struct(F.col("n_chars").alias("n"), "lang")))
    )
    return x.extract_json_text(t.documents.select(d.alias("file_id"), raw.alias("raw")))


# --- sync and ingest ------------------------------------------------------------------------------------
def ingest_items(t):
    role = F.col("role")
    return t.conversations.select(
        F.col("conv_id").alias("batch_id"), F.col("turn").alias("item_id"), F.when(role != "system", F.col("text")).alias("text"),
        F.when(role == "user", F.concat(lit("Q"), "turn")).alias("title"), F.when(role == "assistant", lit("bot")).alias("source"),
        F.array(role, F.concat(lit("c"), "conv_id")).alias("tags"),
    )


INGEST = """bad AS (SELECT conv_id, max(CASE WHEN role = 'system' THEN 1 ELSE 0 END) AS bad FROM conversations GROUP BY conv_id)"""


@add(
    "normalize_ingest_batch",
    f"""WITH {INGEST} SELECT conv_id AS batch_id, turn AS item_id, CASE WHEN role = 'user' THEN 'Q' || turn || chr(10) || chr(10) ELSE '' END || text AS text,
    CASE WHEN role = 'assistant' THEN 'bot' ELSE 'ingest' END AS source, role || ', c' || conv_id AS tags FROM conversations JOIN bad USING (conv_id) WHERE bad = 0""",
)
def _(t):
    return sync.normalize_ingest_batch(ingest_items(t))[0]


@add(
    "ingest_rejects",
    f"""WITH {INGEST} SELECT conv_id AS batch_id, turn AS item_id, CASE WHEN role = 'system' THEN 'missing text' ELSE 'batch has an invalid item' END AS reason
    FROM conversations JOIN bad USING (conv_id) WHERE bad = 1""",
)
def _(t):
    return sync.normalize_ingest_batch(ingest_items(t))[1]


def page_files(t):
    return t.pages.select("page_id", F.col("url").alias("path"), F.timestamp_seconds(F.col("page_id") * 60 + 1700000000).alias("modified_at"))


def indexed_pages(t):
    late = F.timestamp_seconds(F.col("page_id") * 60 + 1700000001)
    known = page_files(t).filter("page_id % 3 <> 0")
    return known.select("path", F.when(F.col("page_id") % 3 == 1, F.col("modified_at")).otherwise(late).alias("modified_at"))


@add(
    "new_files_only",
    """SELECT page_id, url AS path FROM pages p WHERE NOT EXISTS (SELECT 1 FROM pages q WHERE q.page_id % 3 <> 0 AND q.url = p.url
    AND p.page_id * 60 = q.page_id * 60 + CASE WHEN q.page_id % 3 = 1 THEN 0 ELSE 1 END)""",
)
def _(t):
    return sync.new_files_only(page_files(t), indexed_pages(t)).select("page_id", "path")


@add("incremental_sync", "SELECT event_id, event_type FROM events WHERE ts > TIMESTAMP '2024-01-10 00:00:00'")
def _(t):
    fresh, _ = sync.incremental_sync(t.events.withColumnRenamed("ts", "last_edited"), "2024-01-10 00:00:00", "2024-02-01 00:00:00")
    return fresh.select("event_id", "event_type")


OUTCOME = {"click": "indexed", "view": "updated", "error": "error"}


@add(
    "sync_summary",
    """SELECT 'c' || (user_id % 5) AS connector, count(*) AS items, count(*) FILTER (event_type = 'click') AS indexed, count(*) FILTER (event_type = 'view') AS updated,
    count(*) FILTER (event_type NOT IN ('click', 'view', 'error')) AS duplicates, count(*) FILTER (event_type = 'error') AS errors,
    count(*) FILTER (event_type = 'error') < count(*) AS success FROM events GROUP BY 1""",
)
def _(t):
    known = F.create_map(*[lit(v) for kv in OUTCOME.items() for v in kv])
    rows = t.events.select(F.concat(lit("c"), F.col("user_id") % 5).alias("connector"), F.coalesce(known[F.col("event_type")], lit("duplicate")).alias("outcome"))
    return sync.sync_summary(rows)


FOLDERS = ("Messages/inbox", "posts/media", "photos_and_videos/album", "profile", "other")
EXTS = ("JPG", "mp4", "ogg", "heic", "json", "m4v")


def media_files(t):
    d = F.col("doc_id")
    pick = lambda values, k: F.element_at(F.array(*[lit(v) for v in values]), (k % len(values) + 1).cast("int"))
    path = F.concat(pick(FOLDERS, d), lit("/"), d, lit("."), pick(EXTS, F.floor(d / 5)))
    return t.documents.select(F.col("source").alias("connector"), path.alias("path"), F.col("n_chars").alias("size"))


MEDIA = f"""mf AS (SELECT source AS connector, ['{"', '".join(FOLDERS)}'][1 + doc_id % 5] AS folder, ['{"', '".join(EXTS)}'][1 + (doc_id // 5) % 6] AS ext, n_chars AS size FROM documents),
    mr AS (SELECT connector, CASE WHEN ext IN ('JPG', 'heic') THEN 'photo' WHEN ext IN ('mp4', 'm4v') THEN 'video' WHEN ext = 'ogg' THEN 'audio' END AS media_type,
        CASE folder WHEN 'Messages/inbox' THEN 'messages' WHEN 'posts/media' THEN 'posts' WHEN 'photos_and_videos/album' THEN 'photos_and_videos' WHEN 'profile' THEN 'profile' ELSE 'unknown' END AS context,
        count(*) AS files, sum(size)::BIGINT AS total_size FROM mf WHERE ext <> 'json' GROUP BY ALL)"""


@add("media_registry", f"WITH {MEDIA} SELECT * FROM mr")
def _(t):
    return sync.media_registry(media_files(t))


@add(
    "media_totals",
    f"""WITH {MEDIA} SELECT connector, sum(CASE WHEN media_type = 'photo' THEN files ELSE 0 END)::BIGINT AS photos, sum(CASE WHEN media_type = 'video' THEN files ELSE 0 END)::BIGINT AS videos,
    sum(CASE WHEN media_type = 'audio' THEN files ELSE 0 END)::BIGINT AS audio, sum(total_size)::BIGINT AS total_size FROM mr GROUP BY connector""",
)
def _(t):
    return sync.media_totals(sync.media_registry(media_files(t)))


@add(
    "import_report",
    f"""WITH w AS (SELECT CAST(h.doc_id AS VARCHAR) AS doc_id, first_value(h.doc_id) OVER (PARTITION BY x ORDER BY h.doc_id) AS f FROM (SELECT doc_id, {HASH} AS x FROM documents) h)
    SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, CASE WHEN lang = 'es' THEN 'unsupported' WHEN d.doc_id % 97 = 5 THEN 'error' WHEN trim(text) = '' THEN 'empty'
    WHEN d.doc_id % 13 = 2 THEN 'already indexed' WHEN CAST(f AS VARCHAR) <> w.doc_id THEN 'duplicate of ' || f ELSE 'indexed' END AS outcome
    FROM documents d JOIN w ON w.doc_id = CAST(d.doc_id AS VARCHAR)""",
)
def _(t):
    d = F.col("doc_id")
    files = t.docs.select(
        d.cast("string").alias("doc_id"), d.alias("seq"), F.col("filename").alias("path"), F.timestamp_seconds(d).alias("modified_at"), "text", "source",
        F.when(F.col("lang") == "es", "xyz").otherwise("txt").alias("extension"), F.when(d % 97 == 5, "unreadable").alias("error"),
    )
    known = files.filter("seq % 13 = 2").select("path", "modified_at")
    marked = identity.dedupe_documents(files.select("doc_id", "seq", "text", "source"))
    return sync.import_report(files, known, marked).select("doc_id", "outcome")


STATUS = {"click": "completed", "view": "queued", "error": "failed", "purchase": "processing"}
STATUS_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS.items()) + " ELSE 'completed' END"


def job_rows(t):
    known = F.create_map(*[lit(v) for kv in STATUS.items() for v in kv])
    return t.events.select(
        F.col("event_id").alias("job_id"), F.coalesce(known[F.col("event_type")], lit("completed")).alias("status"), F.col("ts").alias("started_at")
    )


@add(
    "job_status_counts",
    f"""WITH j AS (SELECT {STATUS_SQL} AS s FROM events) SELECT count(*) FILTER (s = 'queued') AS queued, count(*) FILTER (s = 'processing') AS processing,
    count(*) FILTER (s = 'completed') AS completed, count(*) FILTER (s = 'failed') AS failed, count(*) FILTER (s IN ('queued', 'processing')) > 0 AS active FROM j""",
)
def _(t):
    return sync.job_status_counts(job_rows(t))


@add(
    "recent_jobs",
    f"""SELECT event_id AS job_id, {STATUS_SQL} AS status FROM events ORDER BY CASE {STATUS_SQL} WHEN 'processing' THEN 0 WHEN 'queued' THEN 1 ELSE 2 END, ts DESC, event_id DESC LIMIT 50""",
)
def _(t):
    return sync.recent_jobs(job_rows(t)).select("job_id", "status")


# --- sinks ----------------------------------------------------------------------------------------------
@add(
    "write_documents",
    f"""WITH h AS (SELECT doc_id, {HASH} AS x, lang = 'de' AS late FROM documents)
    SELECT CAST(doc_id AS VARCHAR) AS doc_id FROM h QUALIFY row_number() OVER (PARTITION BY x ORDER BY late, doc_id) = 1""",
)
def _(t):
    """Two batches into a store, German documents second; the stored ids come back."""
    path = scratch_path(t.spark, "store")
    rows = t.documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("doc_id").alias("seq"), "text", "source", "lang")
    sinks.write_documents(rows.filter("lang <> 'de'").drop("lang"), path, 1)
    sinks.write_documents(rows.filter("lang = 'de'").drop("lang"), path, 2)
    return sinks.read_store(t.spark, path).select("doc_id")


def ledger(t) -> str:
    path = scratch_path(t.spark, "ledger")
    rows = t.events.select(
        F.format_string("e%08d", "event_id").alias("event_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("recorded_at"),
        F.concat(lit("u"), "user_id").alias("actor"), lit("dry_run").alias("mode"), (F.col("user_id") % 3).alias("approved_item_count"),
        (F.col("user_id") % 4).alias("pending_review_count"),
    )
    sinks.ledger_append(rows.filter("recorded_at < '2024-01-08'"), path)
    sinks.ledger_append(rows.filter("recorded_at >= '2024-01-08'"), path)
    return path


LEDGER = "l AS (SELECT printf('e%08d', event_id) AS event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS recorded_at, 'u' || user_id AS actor, 'dry_run' AS mode, user_id % 3 AS approved_item_count, user_id % 4 AS pending_review_count FROM events)"


@add("ledger_tail", f"WITH {LEDGER} SELECT * FROM l ORDER BY recorded_at DESC, event_id DESC LIMIT 50")
def _(t):
    return sinks.ledger_tail(t.spark, ledger(t))[0]


@add(
    "ledger_append",
    f"""WITH {LEDGER} SELECT count(*) AS event_count, arg_max(event_id, (recorded_at, event_id)) AS last_event_id, max(recorded_at) AS last_recorded_at,
    sum(approved_item_count)::BIGINT AS approved_item_count, sum(pending_review_count)::BIGINT AS pending_review_count FROM l""",
)
def _(t):
    return sinks.ledger_tail(t.spark, ledger(t))[1]
