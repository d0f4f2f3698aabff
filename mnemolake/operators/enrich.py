"""Per-document enrichment: topics, key sentences, entities, structured metadata, type and filters.

Everything that concerns one document alone is an expression inside its row, so it needs no shuffle.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from mnemolake.functions import fixed
from mnemolake.functions.text import (
    SPACE, Words, any_match, count_hits, find_all, has_match, let, lowered, sentences, stem, strip, two_match,
    unicode_regex,
)
from mnemolake.functions.vectors import cosine
from mnemolake.operators.common import bounded_rows

STRINGS = "array<string>"


def no_strings() -> Column:
    return F.array().cast(STRINGS)


# --- topics -----------------------------------------------------------------------------------------
def stemmed_taxonomy(taxonomy: DataFrame) -> DataFrame:
    """Stem -> topic for the keywords of a taxonomy; the alphabetically first keyword decides."""
    stems = taxonomy.select(stem(F.col("keyword")).alias("stem"), "keyword", "topic")
    return stems.groupBy("stem").agg(F.min_by("topic", "keyword").alias("stem_topic"))


#: Keywords that every task may hold.
SMALL_TAXONOMY = 100_000


def keyword_topics(
    docs: DataFrame, taxonomy: DataFrame, n: int = 3, max_chars: int | None = None, small: int = SMALL_TAXONOMY
) -> DataFrame:
    """Topics by weighted keywords: exact words count their weight, stem matches 0.8.

    A taxonomy of at most ``small`` keywords goes to the tasks, so only one row per document and topic is
    shuffled; for a larger one the words of a document are counted first and joined. ``max_chars`` looks at
    the head of the text only; by default the whole text counts.
    """
    text = F.col("text") if max_chars is None else F.left("text", F.lit(max_chars))
    words = F.split(F.lower(text), "[\\s,.:;!?()\\[\\]{}\"'/\\\\]+")
    rows = docs.select("doc_id", F.posexplode_outer(words).alias("pos", "word")).filter(F.length("word") >= 2)
    if taxonomy.limit(small + 1).count() <= small:
        rows, sent = rows.withColumn("n", F.lit(1)), F.broadcast
    else:
        rows = rows.groupBy("doc_id", "word").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
        sent = lambda df: df
    exact = rows.join(sent(taxonomy.withColumnRenamed("keyword", "word")), "word", "left")
    missed = exact.withColumn("stem", F.when(F.col("topic").isNull(), stem(F.col("word"))))
    found = missed.join(sent(stemmed_taxonomy(taxonomy)), "stem", "left").select(
        "doc_id", F.coalesce("topic", "stem_topic").alias("topic"), "n", "pos",
        F.when(F.col("topic").isNotNull(), F.col("n") * F.col("weight")).otherwise(0.0).alias("exact_score"),
        F.when(F.col("topic").isNull(), F.col("n")).otherwise(0).alias("stem_n"),
    )
    scored = (
        found.filter(F.col("topic").isNotNull())
        .groupBy("doc_id", "topic")
        .agg(
            F.round(F.sum("exact_score") + 0.8 * F.sum("stem_n"), 6).alias("score"),
            F.sum("n").alias("hits"),
            F.min("pos").alias("pos"),
        )
    )
    best = scored.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "pos", "topic", "hits"))).alias("t")
    )  # as many entries as the taxonomy has topics
    columns = topic_columns(n)
    return docs.select("doc_id", short_text().alias("tiny")).join(best, "doc_id", "left").select(
        "doc_id", *[columns[k].alias(k) for k in ("topics", "primary_topic", "confidence", "method")]
    )


def short_text() -> Column:
    """Less than three characters between white space at both ends, without a copy of the text."""
    return ~F.rlike(F.col("text"), F.lit(f"(?s)(?!{SPACE}).(.+?)(?!{SPACE})."))


def topic_columns(n: int) -> dict[str, Column]:
    """Topics and how sure they are, from ``t`` (neg, pos, topic, hits), the best first or null, and ``tiny``."""
    top, second = -F.get("t", F.lit(0))["neg"], -F.get("t", F.lit(1))["neg"]
    base = (
        F.when(top >= 10, 0.9).when(top >= 6, 0.8).when(top >= 3, 0.65).when(top >= 1.5, 0.5).otherwise(0.35)
    )
    ratio = second / top
    base = base * F.when(ratio > 0.8, 0.7).when(ratio > 0.6, 0.85).otherwise(1.0)
    hits = F.get("t", F.lit(0))["hits"]
    confidence = F.least(F.lit(0.95), base + F.when(hits >= 5, 0.1).when(hits >= 3, 0.05).otherwise(0.0))
    tiny, none = F.col("tiny"), F.col("t").isNull()
    return {
        "topics": F.when(tiny | none, F.array(F.lit("general"))).otherwise(F.transform(F.slice("t", 1, n), lambda x: x["topic"])),
        "primary_topic": F.when(tiny | none, "general").otherwise(F.get("t", F.lit(0))["topic"]),
        "confidence": F.when(tiny, 0.0).when(none, 0.2).otherwise(F.round(confidence, 6)),
        "method": F.when(tiny, "empty_text").when(none, "keyword_no_match").otherwise("weighted_keyword_match"),
    }


def centroids(vectors: DataFrame, by: str) -> DataFrame:
    """Mean vector per group: (topic, embedding)."""
    parts = vectors.select(F.col(by).alias("topic"), F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("topic", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "x")))
    return means.groupBy("topic").agg(F.transform(ordered, lambda p: p["x"]).alias("embedding"))


def embedding_topics(
    doc_vectors: DataFrame, topic_vectors: DataFrame, n: int = 3, threshold: float = 0.3, max_topics: int = 1000
) -> DataFrame:
    """Topics whose vector is closer than ``threshold``.

    The topic vectors become one array value (their number is checked), so every document is scored in
    its own row.
    """
    if topic_vectors.limit(max_topics + 1).count() > max_topics:
        raise ValueError("too many topics for one value; use vector_search instead")
    listed = topic_vectors.agg(F.array_sort(F.collect_list(F.struct("topic", "embedding"))).alias("t")).scalar()
    scored = F.array_sort(
        F.transform(
            "_topics",
            lambda t: F.struct(
                (-F.round(cosine(F.col("embedding"), t["embedding"]), 6)).alias("neg"), t["topic"].alias("topic")
            ),
        )
    )
    rows = doc_vectors.withColumn("_topics", listed).select("doc_id", scored.alias("s"))
    good = F.transform(F.slice(F.filter("s", lambda x: -x["neg"] > threshold), 1, n), lambda x: x["topic"])
    rows = rows.withColumn("good", good)
    low = F.size("good") == 0
    return rows.select(
        "doc_id",
        F.when(low, F.array(F.lit("general"))).otherwise(F.col("good")).alias("topics"),
        F.when(low, "general").otherwise(F.get("good", F.lit(0))).alias("primary_topic"),
        (-F.get("s", F.lit(0))["neg"]).alias("confidence"),
        F.when(low, "embedding_low_match").otherwise("embedding_similarity").alias("method"),
    )


def merge_topics(keyword: DataFrame, embedding: DataFrame, n: int = 3) -> DataFrame:
    """A clear keyword result wins; else both are combined 0.6 / 0.4 when the embedding is sure enough."""
    cols = ("topics", "primary_topic", "confidence", "method")
    k = keyword.select("doc_id", F.struct(*cols).alias("k"))
    e = embedding.select("doc_id", F.struct(*cols).alias("e"))
    j = k.join(e, "doc_id", "left")
    known = F.col("k.primary_topic") != "general"
    sure = F.coalesce(F.col("e.confidence") > 0.4, F.lit(False))
    weight = lambda t: F.when(F.array_contains("k.topics", t), F.col("k.confidence") * 0.6).otherwise(0.0) + F.when(
        F.array_contains("e.topics", t), F.col("e.confidence") * 0.4
    ).otherwise(0.0)
    union = F.array_distinct(F.concat("k.topics", "e.topics"))
    ranked = F.array_sort(
        F.transform(union, lambda t, i: F.struct((-F.round(weight(t), 6)).alias("neg"), i.alias("i"), t.alias("topic")))
    )
    merged = F.struct(
        F.transform(F.slice(ranked, 1, n), lambda x: x["topic"]).alias("topics"),
        F.get(ranked, F.lit(0))["topic"].alias("primary_topic"),
        F.least(F.lit(0.95), -F.get(ranked, F.lit(0))["neg"]).alias("confidence"),
        F.lit("keyword_embedding_merged").alias("method"),
    )
    fallback = F.struct(
        F.array(F.lit("general")).alias("topics"), F.lit("general").alias("primary_topic"),
        F.lit(0.2).alias("confidence"), F.lit("fallback").alias("method"),
    )
    chosen = (
        F.when(F.col("k.method") == "empty_text", F.col("k"))
        .when(known & (F.col("k.confidence") >= 0.6), F.col("k"))
        .when(sure & known, merged)
        .when(sure, F.col("e"))
        .when(known, F.col("k"))
        .otherwise(fallback)
    )
    return j.select("doc_id", chosen.alias("c")).select("doc_id", "c.*")


# --- key sentences -----------------------------------------------------------------------------------
def sentence_scores(kept: Column) -> Column:
    """Array of (neg score, index, sentence) for an array of sentences."""
    total = F.size(kept)

    def score(s: Column, i: Column) -> Column:
        points = F.when(i < 3, 3 - i).otherwise(0) + F.when((total > 5) & (i >= total - 2), 2).otherwise(0)
        size = F.length(s)
        points = points + F.when((size > 50) & (size < 200), 2).when(size > 200, 1).otherwise(0)
        points = points + 2 * let(F.lower(s), lambda low: count_hits(low, fixed.CUE_WORDS))
        # sentences are trimmed: a capital behind white space begins a word that is not the first one
        points = points + F.least(F.regexp_count(s, F.lit(rf"(?=\p{{Lu}})(?<={SPACE})\p{{Lu}}")), F.lit(3))
        # plain tests of what every match contains run before the patterns with word borders
        points = points + (F.rlike(s, F.lit("[a-z][A-Z]")) & has_match(s, fixed.CAMEL_CASE)).cast("int")
        points = points + (F.contains(s, F.lit("_")) & has_match(s, r"\b[a-z]+_[a-z]+\b")).cast("int")
        return F.struct((-points).alias("neg"), i.alias("i"), s.alias("s"))

    return F.transform(kept, score)


def key_sentences(docs: DataFrame, n: int = 3, key: str = "doc_id") -> DataFrame:
    """The ``n`` most telling sentences; long texts give one from each third first."""
    kept = F.filter(F.transform(sentences(F.col("text")), lambda s: strip(s)), lambda s: F.length(s) > 20)
    rows = docs.select(key, "text", kept.alias("kept")).withColumn("scored", F.array_sort(sentence_scores(F.col("kept"))))
    total, third = F.size("kept"), F.floor(F.size("kept") / 3)
    texts = F.transform("scored", lambda x: x["s"])

    def best(low: Column, high: Column, taken: Column) -> Column:
        fits = F.filter(
            "scored", lambda x: (x["i"] >= low) & (x["i"] < high) & ~F.array_contains(taken, x["s"])
        )
        return F.transform(F.slice(fits, 1, 1), lambda x: x["s"])

    rows = rows.withColumn("picked", best(F.lit(0), third, no_strings()))
    rows = rows.withColumn("picked", F.concat("picked", best(third, third * 2, F.col("picked"))))
    rows = rows.withColumn("picked", F.concat("picked", best(third * 2, total, F.col("picked"))))
    spread = F.slice(F.array_distinct(F.concat("picked", texts)), 1, n)
    chosen = F.when(total == 0, F.array(F.left("text", F.lit(500))))
    if n >= 3:
        chosen = chosen.when(total > 10, spread)
    chosen = chosen.otherwise(F.slice(texts, 1, n))
    return rows.select(key, chosen.alias("key_sentences"))


def window_spans(text: Column, size: int = 1000, overlap: int = 100) -> Column:
    """Array of (start, end): windows cut at the last sentence mark past their middle."""
    kind = "struct<pos:int,spans:array<struct<start:int,end:int>>>"
    zero = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")).cast(kind)

    def spans(length: Column) -> Column:
        def step(acc: Column, _: Column) -> Column:
            pos = acc["pos"]
            piece = F.substring(text, pos + 1, F.lit(size))
            mark = F.when(pos + size < length, F.length(F.regexp_extract(piece, r"(?s)^.*[.?!]", 0)) - 1)
            end = let(mark, lambda m: F.when(m > size // 2, pos + m + 1).otherwise(F.least(pos + size, length)).cast("int"))
            moved = let(end, lambda e: F.struct(
                F.when(e < length, e - overlap).otherwise(length).alias("pos"),
                F.array_append(acc["spans"], F.struct(pos.alias("start"), e.alias("end"))).alias("spans"),
            ).cast(kind))
            return F.when(pos >= length, acc).otherwise(moved)

        steps = F.sequence(F.lit(0), F.floor(length / (size // 2 - overlap)).cast("int") + 1)
        return F.aggregate(steps, zero, step)["spans"]

    return let(F.length(text), spans)


def key_sentences_chunked(docs: DataFrame, n: int = 3, size: int = 1000) -> DataFrame:
    """Key sentences of windows, pooled per document: one per section of the text first, then in order."""
    windows = docs.select(
        "doc_id", F.length("text").alias("len"), "text", F.posexplode_outer(window_spans(F.col("text"), size)).alias("w", "span")
    ).select(
        F.struct("doc_id", "w", (F.col("span.start") / F.col("len")).alias("at")).alias("unit"),
        F.col("text").substr(F.col("span.start") + 1, F.col("span.end") - F.col("span.start")).alias("text"),
    )
    # outer explode: the inner one adds a filter that would compute the sentences once more
    found = key_sentences(windows, n, "unit").select("unit.*", F.posexplode_outer("key_sentences").alias("r", "s"))
    found = found.filter(F.col("s").isNotNull())
    # one row per distinct sentence of a document (any case), then the few rows of a document as one array; dealt by
    # document, both need no further exchange
    place = F.struct("w", "r", "at", "s")
    unique = found.repartition("doc_id").groupBy("doc_id", F.lower(strip(F.col("s"))).alias("low")).agg(F.min(place).alias("p"))
    rows = unique.groupBy("doc_id").agg(F.array_sort(F.collect_list("p")).alias("c"))
    texts = F.transform("c", lambda x: x["s"])
    parts = min(n, 3)
    section = lambda p: F.transform(
        F.slice(F.filter("c", lambda x: (x["at"] >= p / parts) & (x["at"] < (p + 1) / parts)), 1, 1), lambda x: x["s"]
    )
    spread = F.slice(F.array_distinct(F.concat(*[section(p) for p in range(parts)], texts)), 1, n)
    return rows.select("doc_id", F.when(F.size("c") <= n, texts).otherwise(spread).alias("key_sentences"))


# --- entities ------------------------------------------------------------------------------------------
def key_entities(docs: DataFrame, n: int = 10) -> DataFrame:
    """Capitalized words inside sentences, identifiers and quoted terms, most frequent first (then by name)."""
    def names(sentence: Column) -> Column:
        words = F.filter(F.split(strip(sentence), SPACE + "+"), lambda w: w != "")
        inner = F.filter(words, lambda w, k: (k > 0) & (F.length(w) > 2))
        bare = F.transform(inner, lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}_]", ""))
        return F.filter(bare, lambda w: F.rlike(w, F.lit(r"^\p{Lu}.*\p{Ll}")))

    text = F.col("text")
    found = F.concat(
        F.flatten(F.transform(sentences(text), names)),
        *[find_all(text, p) for p in (fixed.CAMEL_CASE, fixed.SNAKE_CASE, fixed.CONSTANT_CASE)],
        F.regexp_extract_all(text, F.lit(fixed.QUOTED), F.lit(1)),
    )
    rows = docs.select("doc_id", F.lower("text").alias("low"), F.array_distinct(found).alias("found"), F.length("text").alias("len"))
    count = lambda e: (F.length("low") - F.length(F.replace(F.col("low"), F.lower(e), F.lit("")))) / F.length(e)
    ranked = F.array_sort(F.transform("found", lambda e: F.struct((-count(e)).alias("neg"), e.alias("e"))))
    top = F.transform(F.slice(ranked, 1, n), lambda x: x["e"])
    return rows.select("doc_id", F.when(F.col("len") < 20, no_strings()).otherwise(top).alias("entities"))


def _families(text: Column, patterns, low: Column | None = None, seen: Words | None = None) -> Column:
    return F.concat(*[find_all(text, p, 0, True, low, seen) for p in patterns])


def named(text: Column, name: str, low: Column, seen: Words | None = None) -> Column:
    """The name occurs as a word, in any case."""
    held = F.contains(low, F.lit(name.lower())) if seen is None else seen.any([name.lower()])
    return held & F.rlike(text, F.lit(unicode_regex(r"(?i)\b\Q" + name + r"\E\b")))


def people(seen: Words) -> dict[str, Column]:
    """All persons and organizations, which several fields need."""
    text, low = F.col("text"), F.col("_low")
    common = F.array(*[F.lit(w) for w in fixed.NO_PERSON_WORDS])
    said, by, at_sign = (find_all(text, p, 1, low=low, seen=seen) for p in fixed.PERSON_CONTEXT_PATTERNS)
    persons = F.concat(
        find_all(text, fixed.PERSON_TITLE_PATTERN, 1, low=low, seen=seen),
        F.filter(
            F.concat(said, F.when(seen.before_capital(("by", "from", "with", "to")), by).otherwise(no_strings()), at_sign),
            lambda x: (F.length(x) > 2) & ~F.array_contains(common, x),
        ),
    )
    organizations = F.concat(
        find_all(text, fixed.ORGANIZATION_PATTERN, 1, low=low, seen=seen),
        *[find_all(text, p, 1, True, low, seen) for p in fixed.ORGANIZATION_CONTEXT_PATTERNS],
    )
    return {"_persons": persons, "_organizations": organizations}


def structured_fields(seen: Words, n: int = 10) -> dict[str, Column]:
    """Columns of the structured metadata: first seen first, each at most ``n`` values.

    For rows with ``text``, ``_low`` (see ``lowered``), the words of ``seen`` and the columns of ``people``.
    """
    text, low = F.col("text"), F.col("_low")
    first = lambda values: F.slice(F.array_distinct(values), 1, n)
    every = F.flatten(
        F.array(*[
            F.when(named(text, name, low, seen), F.array(F.lit(name))).otherwise(no_strings())
            for name in fixed.TECHNOLOGY_NAMES
        ])
    )
    # most texts hold none of the names
    technologies = F.when(seen.any([name.lower() for name in fixed.TECHNOLOGY_NAMES]), every).otherwise(no_strings())
    # what every match contains is looked for before the patterns with word borders
    identifiers = F.filter(
        F.concat(
            F.when(~F.rlike(text, F.lit("[a-z][A-Z][a-z]")), no_strings()).otherwise(find_all(text, fixed.CAMEL_CASE_STRICT)),
            find_all(text, fixed.SNAKE_CASE_STRICT, seen=seen),
        ),
        lambda x: F.length(x) > 3,
    )
    near = seen.before_capital(("in", "at", "from", "to", "near", "around"))
    places = F.filter(
        F.when(near, find_all(text, fixed.LOCATION_PATTERN, 1, low=low, seen=seen)).otherwise(no_strings()), lambda x: F.length(x) > 2
    )
    families = lambda patterns: _families(text, patterns, low, seen)
    return {
        "persons": first(F.col("_persons")),
        "organizations": first(F.col("_organizations")),
        "locations": first(F.array_except(F.array_except(places, "_persons"), "_organizations")),
        "dates": first(families(fixed.DATE_PATTERNS)),
        "times": first(families(fixed.TIME_PATTERNS)),
        "temporal_refs": first(families(fixed.TEMPORAL_PATTERNS)),
        "quantities": first(families(fixed.QUANTITY_PATTERNS)),
        "activities": first(F.transform(families(fixed.ACTIVITY_PATTERNS), lambda x: F.lower(x))),
        "technologies": first(F.concat(technologies, identifiers)),
    }


def structured_metadata(docs: DataFrame, n: int = 10) -> DataFrame:
    seen = Words()
    fields = structured_fields(seen, n) | {"document_type": document_type(F.col("text"), F.col("_low"), seen)}
    named_people = people(seen)
    rows = seen.add(lowered(docs)).withColumns(named_people)
    return rows.select("doc_id", *[c.alias(name) for name, c in fields.items()])


def merge_ner(structured: DataFrame, ner: DataFrame, n: int = 10) -> DataFrame:
    """Named entities from a recognizer come first, heuristic ones fill up."""
    kinds = ("persons", "organizations", "locations", "dates", "times")
    given = ner.select("doc_id", *[F.col(k).alias(f"_{k}") for k in kinds if k in ner.columns])
    j = structured.join(given, "doc_id", "left")
    for k in kinds:
        if f"_{k}" in j.columns:
            both = F.concat(F.coalesce(f"_{k}", no_strings()), F.col(k))
            j = j.withColumn(k, F.slice(F.array_distinct(both), 1, n)).drop(f"_{k}")
    return j


# --- type and filters --------------------------------------------------------------------------------------
def document_type(text: Column, low: Column, seen: Words | None = None) -> Column:
    """First family with two pattern hits."""
    expr = None
    for family, on_lower, patterns in fixed.DOCUMENT_TYPES:
        enough = two_match(low if on_lower else text, patterns, low, seen)
        expr = F.when(enough, family) if expr is None else expr.when(enough, family)
    return expr.otherwise("general")


def content_type(text: Column, low: Column, source: Column, filename: Column, seen: Words | None = None) -> Column:
    """Default by source; every later family with a hit overrides."""
    name = F.lower(F.coalesce(filename, F.lit("")))
    doc_like = F.contains(name, F.lit("readme")) | F.contains(name, F.lit("doc"))
    chain = None
    for kind, on_lower, needs_name, patterns in reversed(fixed.CONTENT_TYPE_PATTERNS):
        hit = any_match(low if on_lower else text, patterns, low, seen)
        if needs_name:
            hit = hit & doc_like
        chain = F.when(hit, kind) if chain is None else chain.when(hit, kind)
    for src, kind in fixed.SOURCE_CONTENT_TYPES.items():
        chain = chain.when(source == src, kind)
    return chain.otherwise("note")


def domain(low: Column, seen: Words | None = None) -> Column:
    """Family with most keyword hits, at least two; the first family wins ties."""
    scores = F.array(*[
        F.struct(count_hits(low, words, seen).alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("name"))
        for i, (name, words) in enumerate(fixed.DOMAIN_WORDS)
    ])
    best = F.array_max(scores)
    return F.when(best["n"] >= 2, best["name"]).otherwise("personal")


def filter_columns(seen: Words) -> dict[str, Column]:
    return {
        "content_type": content_type(F.col("text"), F.col("_low"), F.col("source"), F.col("filename"), seen),
        "domain": domain(F.col("_low"), seen),
    }


def document_filters(docs: DataFrame) -> DataFrame:
    seen = Words()
    columns = filter_columns(seen)
    return seen.add(lowered(docs)).select("doc_id", *[c.alias(name) for name, c in columns.items()])


# --- queries -------------------------------------------------------------------------------------------------
def analyze_query(queries: DataFrame) -> DataFrame:
    """What a query asks to filter on, and how sure that is."""
    text, low = F.col("text"), F.lower("text")
    intent = reduce(lambda a, b: a | b, [has_match(low, p) for p in fixed.FILTER_PHRASES])
    tech = F.flatten(F.array(*[
        F.when(named(text, name, low), F.array(F.lit(name))).otherwise(no_strings())
        for name in fixed.QUERY_TECHNOLOGIES
    ]))
    common = F.array(*[F.lit(w) for w in fixed.QUERY_NO_PERSON_WORDS])
    persons = F.array_distinct(F.filter(
        F.concat(*[find_all(text, p, 1) for p in fixed.QUERY_PERSON_PATTERNS]),
        lambda x: (F.length(x) > 2) & ~F.array_contains(common, x),
    ))
    rows = queries.select("query_id", "text", intent.alias("intent"), tech.alias("technologies"), persons.alias("persons"))
    orgs = F.filter(
        F.concat(*[find_all(text, p, 1) for p in fixed.QUERY_ORGANIZATION_PATTERNS]),
        lambda x: (F.length(x) > 2) & ~F.array_contains("persons", x),
    )
    rows = rows.withColumn("organizations", orgs)
    places = F.filter(
        find_all(text, fixed.QUERY_LOCATION_PATTERN, 1),
        lambda x: (F.length(x) > 2) & ~F.array_contains("persons", x) & ~F.array_contains("organizations", x),
    )
    hint = reduce(
        lambda chain, kv: chain.when(has_match(low, kv[1]), kv[0]),
        fixed.DOC_TYPE_HINTS[1:],
        F.when(has_match(low, fixed.DOC_TYPE_HINTS[0][1]), fixed.DOC_TYPE_HINTS[0][0]),
    )
    words = F.size(F.filter(F.split(text, SPACE + "+"), lambda w: w != ""))
    some = lambda c: F.size(c) > 0
    rows = rows.select(
        "*", places.alias("locations"), _families(text, fixed.QUERY_DATE_PATTERNS).alias("dates"),
        F.coalesce(hint, F.lit("")).alias("doc_type_hint"), words.alias("words"),
    )
    add = lambda condition, points: F.when(condition, points).otherwise(0.0)
    confidence = (
        add(F.col("intent"), 0.4) + add(some("persons"), 0.2) + add(F.size("technologies") == 1, 0.15)
        + add(F.col("doc_type_hint") != "", 0.15) + add(some("organizations"), 0.1)
        + add((F.col("words") <= 5) & (some("persons") | some("technologies")), 0.2)
    )
    rows = rows.withColumn("filter_confidence", F.round(F.least(confidence, F.lit(1.0)), 6))
    return rows.select(
        "query_id", "persons", "organizations", "locations", "technologies", "dates", "doc_type_hint",
        "filter_confidence", (F.col("filter_confidence") > 0.5).alias("use_filters"),
    )


# --- passages ---------------------------------------------------------------------------------------------------
def passage_window(pairs: DataFrame, limit: int = 500) -> DataFrame:
    """For (query_id, doc_id, query, text): the sentence with most query words and its neighbours."""
    words = F.array_distinct(F.filter(find_all(F.lower("query"), r"\w+"), lambda w: F.length(w) > 2))
    rows = pairs.select("query_id", "doc_id", "text", words.alias("words"), sentences(F.col("text")).alias("sents"))
    score = lambda s, q: let(F.lower(s), lambda low: F.size(F.filter(q, lambda w: F.contains(low, w))))
    scores = let(
        F.col("words"), lambda q: F.transform("sents", lambda s, i: F.struct(score(s, q).alias("n"), (-i).alias("neg")))
    )
    rows = rows.withColumn("best", F.array_max(scores))
    at, hits = -F.col("best.neg"), F.col("best.n")
    start = F.greatest(at - 1, F.lit(0))
    joined = F.array_join(F.slice("sents", start + 1, at + 3 - start), " ")
    cut = lambda t: F.when(F.length(t) > limit, F.concat(strip_end(F.left(t, F.lit(limit))), F.lit("..."))).otherwise(t)
    head = F.left("text", F.lit(limit))
    period = F.length(F.regexp_extract(head, r"(?s)^.*\.", 0)) - 1
    opening = F.when(period > limit // 2, F.left(head, period + 1)).otherwise(F.concat(strip_end(head), F.lit("...")))
    short = F.length("text") <= limit
    return rows.select(
        "query_id",
        "doc_id",
        F.when(short, F.col("text")).when(hits > 0, cut(joined)).otherwise(opening).alias("excerpt"),
        F.when(short, 1.0).when(hits > 0, F.round(F.least(F.lit(0.7), 0.3 + 0.1 * hits), 6)).otherwise(0.3).alias("confidence"),
        F.when(short, "full").otherwise("window").alias("method"),
    )


def strip_end(text: Column) -> Column:
    return F.regexp_replace(text, SPACE + "+$", "")


def passage_embedding(pairs: DataFrame, sentence_vectors: DataFrame, limit: int = 500, keep: int = 3) -> DataFrame:
    """The sentences closest to the query, in document order; confidence is their mean similarity.

    ``pairs`` has (query_id, doc_id, embedding); ``sentence_vectors`` (doc_id, pos, sentence, vector).
    """
    rows = pairs.join(sentence_vectors, "doc_id").select(
        "query_id", "doc_id", "pos", "sentence", F.round(cosine(F.col("embedding"), F.col("vector")), 6).alias("sim")
    )
    w = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("sim"), F.asc("pos"))
    top = rows.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= keep)
    out = top.groupBy("query_id", "doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]), " ").alias("e"),
        F.round(F.avg("sim"), 6).alias("confidence"),
    )
    cut = F.when(F.length("e") > limit, F.concat(strip_end(F.left("e", F.lit(limit))), F.lit("..."))).otherwise(F.col("e"))
    return out.select("query_id", "doc_id", cut.alias("excerpt"), "confidence", (F.col("confidence") > 0.3).alias("used"))


# --- all together -----------------------------------------------------------------------------------------------
_FOUND = "_seen array<string>, passages array<string>, entities array<string>, " \
    "topics array<struct<topic:string,exact:double,stemmed:long,hits:long,pos:int>>"


def _found_in_texts(finder, taxonomy: list[tuple], n: int):
    """What Python finds in a text: the words that patterns need, passages, entities and hits of the taxonomy."""
    @F.pandas_udf(_FOUND)
    def found(texts: pd.Series, lows: pd.Series) -> pd.DataFrame:
        from mnemolake.operators import passages

        topics = passages.shared_topics(taxonomy)
        return pd.DataFrame({
            "_seen": [finder(t, low) for t, low in zip(texts, lows)],
            "passages": [passages.key_passages(t, n) for t in texts],
            "entities": [passages.key_entities(t, low) for t, low in zip(texts, lows)],
            "topics": [topics(low) for low in lows],
        })

    return found


def enrich_documents(docs: DataFrame, taxonomy: DataFrame, passages: int = 5) -> DataFrame:
    """Passages, entities, structured metadata, filters and topics of every document.

    A document without usable text keeps its row and names the failed stage in ``errors``. Everything is found in one
    pass within the rows, nothing is shuffled; only a taxonomy of more than ``SMALL_TAXONOMY`` keywords is joined.
    """
    has_text = F.coalesce(F.rlike(F.col("text"), F.lit(f"(?s)(?!{SPACE}).")), F.lit(False))
    usable, known = docs.filter(has_text), bounded_rows(taxonomy.select("keyword", "topic", "weight"), SMALL_TAXONOMY)
    seen = Words()
    fields = structured_fields(seen) | {"document_type": document_type(F.col("text"), F.col("_low"), seen)}
    filters, named_people = filter_columns(seen), people(seen)
    found = _found_in_texts(seen.finder(), [tuple(r) for r in known or ()], passages)
    rows = lowered(usable).withColumn("_found", found("text", "_low")).withColumn("_seen", F.col("_found._seen")).withColumns(named_people)
    hit = lambda h: F.struct((-F.round(h["exact"] + 0.8 * h["stemmed"], 6)).alias("neg"), h["pos"].alias("pos"), h["topic"].alias("topic"), h["hits"].alias("hits"))
    struct = lambda columns: F.struct(*[c.alias(name) for name, c in columns.items()])
    out = rows.select(
        "doc_id",
        struct(fields).alias("structured"),
        struct(filters).alias("filters"),
        F.col("_found.passages").alias("key_passages"),
        F.col("_found.entities").alias("entities"),
        F.array_sort(F.transform("_found.topics", hit)).alias("t"),
        short_text().alias("tiny"),
    )
    given = "doc_id", "structured", "filters", "key_passages", "entities"
    named_topics = "topics", "primary_topic", "confidence"
    if known is None:
        out = out.select(*given).join(keyword_topics(usable, taxonomy).select("doc_id", *named_topics), "doc_id", "left")
    else:
        columns = topic_columns(3)
        out = out.select(*given, *[columns[k].alias(k) for k in named_topics])
    out = out.withColumn("errors", no_strings())
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in out.schema.fields[1:-1]]
    return out.unionByName(docs.filter(~has_text).select("doc_id", *empty, F.array(F.lit("empty_text")).alias("errors")))
