"""Consent: which documents a session may see, and which personal data it may read."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, functions as F

from mnemolake.functions import fixed
from mnemolake.functions.dates import relative_days
from mnemolake.operators.retrieval import bm25_search


def categories(topics: Column) -> Column:
    """Consent categories of a topic list: exact word, else first word contained in the topic; else general."""
    words = fixed.TOPIC_CATEGORIES
    exact = F.create_map(*[F.lit(x) for pair in words for x in pair])
    ordered = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(c).alias("c")) for w, c in words])

    def one(topic: Column) -> Column:
        low = F.lower(topic)
        part = F.get(F.filter(ordered, lambda x: F.contains(low, x["w"])), F.lit(0))["c"]
        return F.coalesce(exact[low], part)

    found = F.array_sort(F.array_distinct(F.array_compact(F.transform(topics, one))))
    return F.when(F.coalesce(F.size(found), F.lit(0)) > 0, found).otherwise(F.array(F.lit("general")))


def category_allowed(cats: Column, allowed, blocked) -> Column:
    """Every category must pass: not blocked, and allowed (an empty list or ``*`` allows all)."""
    listed = lambda names: F.array(*[F.lit(n) for n in sorted(names)]).cast("array<string>")
    ok = ~F.arrays_overlap(cats, listed(blocked)) if blocked else F.lit(True)
    if allowed and "*" not in allowed:
        ok = ok & F.forall(cats, lambda c: F.array_contains(listed(allowed), c))
    return ok


def consent_category(docs: DataFrame, allowed, blocked) -> DataFrame:
    return docs.filter(category_allowed(categories(F.col("topics")), allowed, blocked))


def mark_documents(
    docs: DataFrame,
    allowed_ids: DataFrame | None = None,
    blocked_ids: DataFrame | None = None,
    blocked_sources: tuple[str, ...] = (),
    allowed_sources: tuple[str, ...] = (),
) -> DataFrame:
    """Add ``document_ok``. A list of allowed ids decides alone; documents without source pass source rules."""
    if allowed_ids is not None:
        ids = allowed_ids.select("doc_id").distinct().withColumn("document_ok", F.lit(True))
        return docs.join(ids, "doc_id", "left").fillna(False, ["document_ok"])
    ok = F.lit(True)
    has_source = F.coalesce(F.col("source"), F.lit("")) != ""
    if blocked_sources:
        ok = ok & ~(has_source & F.col("source").isin(*blocked_sources))
    if allowed_sources:
        ok = ok & (~has_source | F.col("source").isin(*allowed_sources))
    if blocked_ids is None:
        return docs.withColumn("document_ok", ok)
    ids = blocked_ids.select("doc_id").distinct().withColumn("_blocked", F.lit(True))
    return docs.join(ids, "doc_id", "left").withColumn("document_ok", F.col("_blocked").isNull() & ok).drop("_blocked")


def consent_document(docs: DataFrame, **rules) -> DataFrame:
    return mark_documents(docs, **rules).filter("document_ok").drop("document_ok")


def time_ok(
    date: Column, as_of: str, after: str | None = None, before: str | None = None, relative: str | None = None
) -> Column:
    """Date inside the window; undated documents pass. A relative window sets its own start."""
    ok = F.lit(True)
    start = F.date_sub(F.lit(as_of).cast("date"), relative_days(relative)) if relative else None
    if start is None and after:
        start = F.lit(after).cast("date")
    if start is not None:
        ok = ok & (date >= start)
    if before:
        ok = ok & (date <= F.lit(before).cast("date"))
    return date.isNull() | ok


def consent_time(docs: DataFrame, as_of: str, date_field: str = "doc_date", **window) -> DataFrame:
    return docs.filter(time_ok(F.col(date_field), as_of, **window))


def consent_stage(
    docs: DataFrame, as_of: str, allowed=(), blocked=(), document_rules: dict | None = None, time_rules: dict | None = None
) -> DataFrame:
    """Add ``stage``: the first rule a document fails (category, document, time) or ``kept``. One pass."""
    marked = mark_documents(docs, **(document_rules or {}))
    return marked.withColumn(
        "stage",
        F.when(~category_allowed(categories(F.col("topics")), allowed, blocked), "category")
        .when(~F.col("document_ok"), "document")
        .when(~time_ok(F.col("doc_date"), as_of, **(time_rules or {})), "time")
        .otherwise("kept"),
    ).drop("document_ok")


def consent_stats(staged: DataFrame) -> DataFrame:
    return staged.groupBy("stage").agg(F.count("*").alias("n"))


def preset_rules(name: str) -> dict:
    allowed, blocked, _, relative = fixed.CONSENT_PRESETS[name]
    return {"allowed": allowed, "blocked": blocked, "time_rules": {"relative": relative} if relative else None}


def preset_reach(docs: DataFrame, as_of: str) -> DataFrame:
    """Documents every preset lets through, and the PII types it exposes."""
    cats = categories(F.col("topics"))
    rows = docs.select("doc_date", cats.alias("cats"))
    counts = []
    for name, (allowed, blocked, exposed, relative) in fixed.CONSENT_PRESETS.items():
        ok = category_allowed(F.col("cats"), allowed, blocked) & time_ok(F.col("doc_date"), as_of, relative=relative)
        counts.append(F.struct(
            F.lit(name).alias("preset"), F.lit("|".join(exposed)).alias("exposed_pii_types"), ok.cast("int").alias("ok")
        ))
    each = rows.select(F.explode(F.array(*counts)).alias("p"))
    return each.groupBy("p.preset", "p.exposed_pii_types").agg(F.sum("p.ok").alias("kept"), F.count("*").alias("total"))


def consented_search(queries: DataFrame, docs: DataFrame, staged: DataFrame, k: int = 10, **kw) -> DataFrame:
    """Best ``k`` allowed documents per query: consent comes before the cut, so blocked hits cost a query nothing."""
    return bm25_search(queries, docs, k, among=staged.filter(F.col("stage") == "kept"), **kw)


def held_back(hits: DataFrame, staged: DataFrame) -> DataFrame:
    """Of the given hits of every query, how many each rule holds back, and how many are allowed."""
    return hits.join(staged.select("doc_id", "stage"), "doc_id").groupBy("query_id", "stage").agg(F.count("*").alias("n"))


def name_matches(value: Column, entity: tuple) -> Column:
    """Equal to name or alias, or one contains the other."""
    name, aliases = entity[0].lower(), [a.lower() for a in entity[1]]
    low = F.lower(value)
    exact = low.isin(name, *aliases)
    return exact | F.contains(low, F.lit(name)) | F.contains(F.lit(name), low)


def pii_decision(spans: DataFrame, exposed=(), protect=(), expose=()) -> DataFrame:
    """Add ``anonymize`` and ``reason`` to values with their type.

    ``protect`` and ``expose`` are short lists of (name, aliases) and concern persons only; critical types
    are anonymized whatever a session says.
    """
    kind, value = F.col("pii_type"), F.col("value")
    reason = F.when(kind.isin(*fixed.CRITICAL_PII_TYPES), "critical_pii")
    for prefix, entities in (("entity_protected:", protect), ("entity_exposed:", expose)):
        for entity in entities:
            reason = reason.when((kind == "PERSON") & name_matches(value, entity), prefix + entity[0])
    open_types = sorted(set(exposed) - set(fixed.CRITICAL_PII_TYPES))
    if open_types:
        reason = reason.when(kind.isin(*open_types), "pii_type_exposed")
    reason = reason.otherwise("pii_type_anonymized")
    rows = spans.withColumn("reason", reason)
    return rows.withColumn("anonymize", ~(F.col("reason").startswith("entity_exposed:") | (F.col("reason") == "pii_type_exposed")))
