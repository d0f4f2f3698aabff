"""Exported JSON (chats, pages, posts, threads) as message and document tables.

Every export is one row with its JSON text in ``raw``; shapes are read with explicit schemas, so a job
reads each text once and needs no inference pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mnemolake.functions import fixed
from mnemolake.functions.text import strip
from mnemolake.operators.pii import rebuild_matches

MESSAGE = "struct<author:struct<role:string>,content:struct<parts:array<string>>,create_time:double>"
MAPPING = f"id string, title string, mapping map<string,struct<message:{MESSAGE}>>"
EXPORT = """id string, type string, title string, name string, content string, text string, url string, category string,
    attachments array<string>, tags array<string>, timestamp double,
    entries array<struct<id:string,title:string,properties:map<string,string>>>,
    messages array<struct<role:string,sender:string,sender_name:string,content:string,text:string>>, data string"""


def filled(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def flatten_chat_mapping(exports: DataFrame, joiner: str = "\n") -> DataFrame:
    """Messages of a chat export in time order: (export_id, title, pos, role, text, create_time).

    Parts are joined, blank messages dropped; messages without time come first.
    """
    parsed = exports.select("export_id", F.from_json("raw", MAPPING).alias("j"))
    nodes = F.filter(F.map_values("j.mapping"), lambda n: n["message"]["content"]["parts"].isNotNull())
    msgs = F.transform(nodes, lambda n, i: F.struct(
        F.coalesce(n["message"]["create_time"], F.lit(0.0)).alias("t"), i.alias("i"),
        F.coalesce(n["message"]["author"]["role"], F.lit("unknown")).alias("role"),
        strip(F.array_join(n["message"]["content"]["parts"], joiner)).alias("text"),
    ))
    ordered = F.array_sort(F.filter(msgs, lambda m: m["text"] != ""))
    rows = parsed.select("export_id", F.col("j.title").alias("title"), F.posexplode_outer(ordered).alias("pos", "m"))
    return rows.filter("m is not null").select(
        "export_id", F.coalesce("title", F.lit("Untitled")).alias("title"), "pos", "m.role", "m.text", F.col("m.t").alias("create_time")
    )


def nested_texts(data: Column, depth: int = 5, limit: int | None = None) -> Column:
    """Texts longer than three characters in a JSON value, through lists and the known text fields.

    ``data`` is JSON text. Each round replaces every list by its items and every object by its known fields
    and leaves plain texts alone, so reading order is kept; ``depth`` rounds; ``limit`` keeps only the first texts.
    """
    kinds = "array<string>"
    fields = "struct<" + ",".join(f"{f}:string" for f in fixed.NESTED_TEXT_FIELDS) + ">"

    def unfold(value: Column) -> Column:
        start = F.left(F.ltrim(value), F.lit(1))
        known = F.from_json(value, fields)
        return (
            F.when(start == "[", F.coalesce(F.from_json(value, kinds), F.array().cast(kinds)))
            .when(start == "{", F.array_compact(F.array(*[known[f] for f in fixed.NESTED_TEXT_FIELDS])))
            .otherwise(F.array(value))
        )

    level = F.array(data)
    for _ in range(depth):
        level = F.flatten(F.transform(level, unfold))
    text = lambda v: (F.length(v) > 3) & ~F.rlike(F.ltrim(v), F.lit("^[\\[{]"))
    found = F.filter(level, text)
    return found if limit is None else F.slice(found, 1, limit)


def normalize_exports(exports: DataFrame) -> DataFrame:
    """Every export as document rows (export_id, part, kind, text, title), by the shape of its JSON."""
    j = exports.select("export_id", "raw", F.from_json("raw", EXPORT).alias("j"))
    title = lambda c: F.when(filled(c), c).otherwise("Untitled")
    kind = (
        F.when((F.col("j.type") == "message_thread") & F.col("j.messages").isNotNull(), "message")
        .when(F.col("j.messages").isNotNull(), "chat")
        .when((F.col("j.type") == "page") & filled(F.col("j.content")), "page")
        .when((F.col("j.type") == "database") & F.col("j.entries").isNotNull(), "database")
        .when((F.col("j.type") == "post") & F.col("j.content").isNotNull(), "post")
        .when((F.col("j.type") == "comment") & filled(F.col("j.content")), "comment")
        .when((F.col("j.type") == "facebook_data") & F.col("j.data").isNotNull(), "data")
        .when(filled(F.col("j.text")) | filled(F.col("j.content")), "generic")
    )
    pair = lambda text, name: F.struct(text.alias("text"), name.alias("title"))
    m = F.col("j.messages")
    chat = F.transform(F.filter(m, lambda x: filled(x["content"])), lambda x: pair(x["content"], title(F.col("j.title"))))
    thread = F.transform(
        F.filter(m, lambda x: F.length(x["content"]) >= 5),
        lambda x: pair(F.concat(F.lit("["), F.coalesce(x["sender"], F.lit("undefined")), F.lit("]: "), x["content"]), title(F.col("j.title"))),
    )
    page = F.array(pair(F.concat(F.lit("# "), title(F.col("j.title")), F.lit("\n\n"), F.col("j.content")), title(F.col("j.title"))))
    lines = lambda p: F.array_join(F.transform(F.map_entries(p), lambda kv: F.concat(kv["key"], F.lit(": "), kv["value"])), "\n")
    database = F.transform("j.entries", lambda x: pair(
        F.concat(F.lit("# "), title(x["title"]), F.lit("\n\nDatabase: "), F.col("j.title"), F.lit("\n\n"),
                 F.coalesce(lines(x["properties"]), F.lit(""))), title(x["title"])))
    lead = lambda prefix: F.when(filled(F.col("j.title")), F.concat(F.lit(prefix), F.col("j.title"), F.lit("\n\n"))).otherwise("")
    attached = F.when(F.size("j.attachments") > 0, F.concat(F.lit("\n\n"), F.array_join("j.attachments", "\n"))).otherwise("")
    post_text = strip(F.concat(lead(""), F.col("j.content"), attached))
    comment_text = strip(F.concat(lead("Comment on: "), F.col("j.content")))
    kept = lambda text, n: F.when(F.length(text) > n, F.array(pair(text, F.coalesce("j.title", F.lit("")))))
    found = nested_texts(F.col("j.data"))
    data = F.when(F.size(found) > 0, F.array(pair(
        F.concat(F.lit("Facebook "), F.coalesce("j.category", F.lit("undefined")), F.lit(":\n"), F.array_join(found, "\n")), F.coalesce("j.category", F.lit(""))
    )))
    generic = F.array(pair(
        F.when(filled(F.col("j.text")), F.col("j.text")).otherwise(F.col("j.content")),
        F.when(filled(F.col("j.title")), F.col("j.title")).otherwise(F.coalesce("j.name", F.lit(""))),
    ))
    docs = (
        F.when(F.col("kind") == "chat", chat).when(F.col("kind") == "message", thread).when(F.col("kind") == "page", page)
        .when(F.col("kind") == "database", database).when(F.col("kind") == "post", kept(post_text, 10))
        .when(F.col("kind") == "comment", kept(comment_text, 5)).when(F.col("kind") == "data", data)
        .when(F.col("kind") == "generic", generic)
    )
    rows = j.withColumn("kind", kind).select("export_id", "kind", docs.alias("docs"))
    rows = rows.select("export_id", "kind", F.posexplode_outer("docs").alias("part", "d")).filter("d is not null")
    return rows.select("export_id", "part", "kind", "d.text", "d.title")


def count_export_items(exports: DataFrame) -> DataFrame:
    """Items per export: its messages or entries, else one."""
    j = exports.select("export_id", F.from_json("raw", EXPORT).alias("j")).filter("j is not null")
    n = (
        F.when(F.col("j.messages").isNotNull(), F.size("j.messages"))
        .when((F.col("j.type") == "database") & F.col("j.entries").isNotNull(), F.size("j.entries"))
        .otherwise(1)
    )
    return j.select("export_id", n.cast("long").alias("items"))


# --- social exports -------------------------------------------------------------------------------------
POSTS = """array<struct<timestamp:long,title:string,data:array<struct<post:string>>,
    attachments:array<struct<data:array<struct<text:string,external_context:struct<name:string>,media:struct<description:string>>>>>,
    tags:array<struct<name:string>>>>"""
COMMENTS = """struct<comments:array<struct<timestamp:long,title:string,comment:string,
    data:array<struct<comment:struct<timestamp:long,comment:string>>>>>>"""
THREAD = """struct<title:string,participants:array<struct<name:string>>,messages:array<struct<sender_name:string,timestamp_ms:long,
    content:string,share:struct<share_text:string,link:string>,type:string,photos:array<string>,videos:array<string>,audio_files:array<string>>>>"""


def facebook_posts(exports: DataFrame) -> DataFrame:
    """Posts of an export: text parts, attachment texts, tags; posts without time or text are dropped."""
    rows = exports.select("export_id", F.posexplode_outer(F.from_json("raw", POSTS)).alias("part", "p")).filter("p.timestamp > 0")
    body = F.array_join(F.filter(F.transform("p.data", lambda d: d["post"]), filled), "\n")
    three = F.transform(
        F.flatten(F.transform("p.attachments", lambda a: F.coalesce(a["data"], F.array()))),
        lambda d: F.array(d["text"], d["external_context"]["name"], d["media"]["description"]),
    )
    extra = F.filter(F.flatten(F.coalesce(three, F.array())), filled)
    out = rows.select(
        "export_id", "part", F.col("p.timestamp").alias("timestamp"),
        F.timestamp_seconds("p.timestamp").alias("date"), F.coalesce("p.title", F.lit("")).alias("title"),
        F.coalesce(body, F.lit("")).alias("content"), extra.alias("attachments"),
        F.transform("p.tags", lambda x: x["name"]).alias("tags"),
    )
    return out.filter((F.col("content") != "") | (F.size("attachments") > 0))


def facebook_comments(exports: DataFrame) -> DataFrame:
    """Comments; text and time may sit at either of two places."""
    rows = exports.select("export_id", F.posexplode_outer(F.from_json("raw", COMMENTS)["comments"]).alias("part", "c"))
    when = F.coalesce(F.nullif("c.timestamp", F.lit(0)), F.get("c.data", F.lit(0))["comment"]["timestamp"])
    nested = F.array_join(F.filter(F.transform("c.data", lambda d: d["comment"]["comment"]), filled), "\n")
    text = F.when(F.col("c.data").isNotNull(), nested).otherwise(F.col("c.comment"))
    out = rows.select(
        "export_id", "part", when.alias("timestamp"), F.timestamp_seconds(when).alias("date"),
        F.coalesce("c.title", F.lit("")).alias("title"), F.coalesce(text, F.lit("")).alias("content"),
    )
    return out.filter((F.col("timestamp") > 0) & (F.col("content") != ""))


def facebook_messages(exports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Threads (title, participants, counts, first and last message) and their messages."""
    t = exports.select("export_id", F.from_json("raw", THREAD).alias("t")).filter("t.messages is not null")
    people = F.array_join(F.transform("t.participants", lambda p: p["name"]), ", ")
    people = F.when(filled(people), people).otherwise("Unknown")
    said = F.filter("t.messages", lambda m: filled(m["content"]) | m["share"].isNotNull())
    t = t.select("export_id", "t.title", people.alias("participants"), said.alias("m")).filter("size(m) > 0")
    at = lambda m: F.timestamp_millis(m["timestamp_ms"])
    threads = t.select(
        "export_id",
        F.when(filled(F.col("title")), F.col("title")).otherwise(F.concat(F.lit("Chat with "), "participants")).alias("title"),
        "participants", F.size("m").alias("message_count"),
        at(F.element_at("m", -1)).alias("first_message"), at(F.element_at("m", 1)).alias("last_message"),
    )
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    rows = t.select("export_id", F.posexplode_outer("m").alias("part", "m"))
    shared = F.coalesce(F.nullif("m.share.share_text", F.lit("")), F.nullif("m.share.link", F.lit("")), F.lit(""))
    messages = rows.select(
        "export_id", "part", F.col("m.sender_name").alias("sender"), F.timestamp_millis("m.timestamp_ms").alias("date"),
        F.when(filled(F.col("m.content")), F.col("m.content")).otherwise(shared).alias("content"),
        ((size("m.photos") > 0) | (size("m.videos") > 0) | (size("m.audio_files") > 0)).alias("has_media"),
    )
    return threads, messages


def fix_mojibake(text: Column) -> Column:
    r"""Turn literal ``\u00XX`` sequences into their characters."""
    code = lambda m: F.conv(F.substring(m, 5, 2), 16, 10).cast("int")
    return rebuild_matches(text, r"\\u00[0-9a-fA-F]{2}", lambda m: F.decode(F.unhex(F.hex(F.chr(code(m)))), "UTF-8"))


def fix_mojibake_all(df: DataFrame) -> DataFrame:
    """The same for every text column and every array of texts."""
    out = []
    for f in df.schema.fields:
        c, t = F.col(f.name), f.dataType.simpleString()
        if t == "string":
            c = fix_mojibake(c)
        elif t == "array<string>":
            c = F.transform(c, fix_mojibake)
        out.append(c.alias(f.name))
    return df.select(*out)


# --- pages and highlights ----------------------------------------------------------------------------------
PROPERTY = """map<string,struct<type:string,title:array<struct<plain_text:string>>,rich_text:array<struct<plain_text:string>>,number:string,
    select:struct<name:string>,multi_select:array<struct<name:string>>,date:struct<start:string>,checkbox:boolean,url:string,
    email:string,phone_number:string,status:struct<name:string>>>"""


def property_value(p: Column) -> Column:
    """Text of a typed page property; unknown types are empty."""
    kind = p["type"]
    joined = lambda arr: F.array_join(F.transform(arr, lambda x: x["plain_text"]), "")
    value = (
        F.when(kind == "title", joined(p["title"])).when(kind == "rich_text", joined(p["rich_text"]))
        .when(kind == "number", p["number"]).when(kind == "select", p["select"]["name"])
        .when(kind == "multi_select", F.array_join(F.transform(p["multi_select"], lambda x: x["name"]), ", "))
        .when(kind == "date", p["date"]["start"])
        .when(kind == "checkbox", F.when(p["checkbox"], "Yes").otherwise("No"))
        .when(kind == "url", p["url"]).when(kind == "email", p["email"]).when(kind == "phone_number", p["phone_number"])
        .when(kind == "status", p["status"]["name"])
    )
    return F.coalesce(value, F.lit(""))


def flatten_properties(pages: DataFrame) -> DataFrame:
    """``Name: value`` lines of a page's properties in JSON order; empty values are left out."""
    rows = pages.select("page_id", F.map_entries(F.from_json("properties", PROPERTY)).alias("e"))
    lines = F.transform("e", lambda kv: F.struct(kv["key"].alias("k"), property_value(kv["value"]).alias("v")))
    kept = F.filter(lines, lambda x: x["v"] != "")
    return rows.select("page_id", F.array_join(F.transform(kept, lambda x: F.concat(x["k"], F.lit(": "), x["v"])), "\n").alias("text"))


def documents_with_highlights(docs: DataFrame, highlights: DataFrame, part_rows: int = 1000) -> DataFrame:
    """Header of a saved document and its highlights as one text.

    Highlights carry their position; documents with more than ``part_rows`` of them come in numbered parts.
    """
    line = lambda h: F.concat(
        F.lit("> "), h["text"],
        F.when(filled(h["note"]), F.concat(F.lit("\n\nNote: "), h["note"])).otherwise(""),
        F.when(F.size(h["tags"]) > 0, F.concat(F.lit("\nTags: "), F.array_join(h["tags"], ", "))).otherwise(""),
    )
    body = highlights.groupBy("doc_id", F.floor(F.col("pos") / part_rows).alias("part")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text", "note", "tags"))), line), "\n\n").alias("body")
    )
    opt = lambda label, c: F.when(filled(F.col(c)), F.concat(F.lit(label), F.col(c)))
    head = F.concat_ws(
        "\n\n", F.concat(F.lit("# "), F.col("title")), opt("Author: ", "author"), opt("Source: ", "source"), opt("Category: ", "category"),
        opt("Published: ", "published_date"), opt("\n## Summary\n", "summary"), opt("\n## Notes\n", "notes"),
        F.when(F.size("tags") > 0, F.concat(F.lit("Tags: "), F.array_join("tags", ", "))),
    )
    j = docs.join(body, "doc_id", "left").withColumn("part", F.coalesce("part", F.lit(0)))
    first = F.concat_ws("\n\n", head, F.when(F.col("body").isNotNull(), F.concat(F.lit("\n## Highlights\n\n"), F.col("body"))))
    return j.select("doc_id", "part", F.when(F.col("part") == 0, first).otherwise(F.col("body")).alias("text"))


# --- plain JSON --------------------------------------------------------------------------------------------
ITEM = "struct<" + ",".join(f"{f}:string" for f in fixed.ITEM_TEXT_FIELDS) + ">"


def extract_json_text(files: DataFrame, limit: int | None = None) -> DataFrame:
    """Readable text of a JSON file (file_id, raw): chat mapping, messages, list of items, or the JSON itself."""
    raw = F.col("raw")
    j = F.from_json(raw, EXPORT)
    m = F.from_json(raw, MAPPING)
    rows = files.select("file_id", "raw", j.alias("j"), m.alias("m"), F.from_json(raw, f"array<{ITEM}>").alias("objects"),
                        F.from_json(raw, "array<string>").alias("strings"))
    nodes = F.filter(F.map_values("m.mapping"), lambda n: n["message"]["content"]["parts"].isNotNull())
    chat = F.transform(nodes, lambda n: F.struct(
        F.coalesce(n["message"]["author"]["role"], F.lit("unknown")).alias("r"), F.array_join(n["message"]["content"]["parts"], " ").alias("t")
    ))
    msgs = F.transform("j.messages", lambda x: F.struct(
        F.coalesce(x["role"], x["sender"], F.lit("unknown")).alias("r"), F.coalesce(x["content"], x["text"]).alias("t")
    ))
    said = lambda arr: F.transform(F.filter(arr, lambda x: F.coalesce(strip(x["t"]), F.lit("")) != ""), lambda x: F.concat(x["r"], F.lit(": "), x["t"]))
    heading = F.when(F.col("j.title").isNotNull(), F.array(F.concat(F.lit("Title: "), F.col("j.title")))).otherwise(F.array().cast("array<string>"))
    lines = F.when(F.col("m.mapping").isNotNull(), F.concat(heading, said(chat))).when(
        F.col("j.messages").isNotNull(), F.concat(heading, said(msgs))
    ).otherwise(heading)
    is_list = F.startswith(F.ltrim(raw), F.lit("["))
    first = lambda x: F.coalesce(*[x[f] for f in fixed.ITEM_TEXT_FIELDS])
    head = lambda c: F.col(c) if limit is None else F.slice(c, 1, limit)
    items = F.array_compact(F.transform(head("objects"), first))
    plain = F.filter(head("strings"), lambda s: ~F.startswith(F.ltrim(s), F.lit("{")))
    chosen = F.when(is_list & (F.size(items) > 0), F.array_join(items, "\n")).when(
        is_list & (F.size(plain) > 0), F.array_join(plain, "\n")
    ).when(~is_list & (F.size(lines) > 0), F.array_join(lines, "\n"))
    return rows.select("file_id", F.coalesce(chosen, raw).alias("text"))
