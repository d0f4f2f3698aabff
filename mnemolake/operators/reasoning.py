"""Cited evidence for questions: citations, coverage, freshness, gaps, contradictions, graphs.

A question keeps at most ``k`` citations, so they travel as one array per question and everything that
looks at a question's citations is an expression inside that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mnemolake.functions import fixed
from mnemolake.functions.dates import age_days, parse_date
from mnemolake.functions.hashing import short_hash, stable_id
from mnemolake.functions.text import (
    clean_excerpt, collapse_ws, first_text, infer_entity_type, let, long_terms, query_terms, safe_concept_label,
    safe_entity_label, sentences, slug, strip, tokens,
)
from mnemolake.operators.common import top_k

SAFE_FIELDS = (
    ("organizations", "organization"), ("locations", "location"), ("technologies", "technology"),
    ("activities", "activity"), ("dates", "date"),
)


def _given(df: DataFrame, *names: str) -> list[Column]:
    return [F.col(n) for n in names if n in df.columns] or [F.lit(None).cast("string")]


def citations(results: DataFrame, k: int = 8) -> DataFrame:
    """Best ``k`` results per question as citations; those without any text are dropped, ranks closed up.

    Every field takes the first non-blank of its alternates: excerpt/passage/text/content, title/filename,
    date/created_at/modified_at, source/connector.
    """
    best = top_k(results.drop("rank"), ["query_id"], [F.desc("score"), F.asc("doc_id")], k)
    topics = F.col("topics") if "topics" in results.columns else F.array().cast("array<string>")
    rows = best.select(
        "query_id",
        "rank",
        "doc_id",
        first_text(*_given(results, "title", "filename"), F.lit("Untitled source")).alias("title"),
        clean_excerpt(first_text(*_given(results, "excerpt", "passage", "text", "content"))).alias("excerpt"),
        F.round("score", 4).alias("score"),
        parse_date(first_text(*_given(results, "date", "doc_date", "created_at", "modified_at"))).alias("date"),
        first_text(*_given(results, "source", "connector"), F.lit("unknown")).alias("source"),
        F.array_sort(F.array_distinct(F.filter(topics, safe_concept_label))).alias("topics"),
        *[F.col(c) for c, _ in SAFE_FIELDS if c in results.columns],
        *[F.col(c) for c in ("persons", "entities") if c in results.columns],
    ).filter(F.col("excerpt") != "")
    return top_k(rows.withColumnRenamed("rank", "_r"), ["query_id"], [F.col("_r")], k).drop("_r")


def bundle(questions: DataFrame, cites: DataFrame) -> DataFrame:
    """One row per question: its terms and its citations as an array in rank order."""
    packed = cites.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", *[c for c in cites.columns if c not in ("rank", "query_id")]))).alias("cites")
    )
    rows = questions.select("query_id", F.col("text").alias("question"), query_terms(F.col("text")).alias("terms"))
    rows = rows.join(packed, "query_id", "left")
    kind = packed.schema["cites"].dataType
    rows = rows.withColumn("cites", F.coalesce("cites", F.array().cast(kind)))
    corpus = F.array_join(F.transform("cites", lambda c: F.lower(F.concat(c["title"], F.lit(" "), c["excerpt"]))), " ")
    found = let(corpus, lambda c: F.filter("terms", lambda x: F.contains(c, x)))
    rows = rows.withColumn("found_terms", found)
    return rows.withColumn("missing_terms", F.array_except("terms", "found_terms"))


def _count(condition) -> Column:
    return F.size(F.filter("cites", condition))


def coverage(b: DataFrame) -> DataFrame:
    return b.select(
        "query_id",
        F.size("cites").alias("source_count"),
        _count(lambda c: c["date"].isNotNull()).alias("dated_source_count"),
        _count(lambda c: c["score"] >= fixed.STRONG_SCORE).alias("strong_source_count"),
        F.col("found_terms").alias("query_terms_found"),
        F.col("missing_terms").alias("query_terms_missing"),
    )


def freshness(b: DataFrame, as_of: str, days: int = fixed.FRESHNESS_DAYS) -> DataFrame:
    dates = F.array_compact(F.transform("cites", lambda c: c["date"]))
    stale = _count(lambda c: F.coalesce(age_days(as_of, c["date"]) > days, F.lit(False)))
    undated = _count(lambda c: c["date"].isNull())
    rows = b.select(
        "query_id", F.array_min(dates).alias("oldest_source_date"), F.array_max(dates).alias("newest_source_date"),
        stale.alias("stale_source_count"), undated.alias("undated_source_count"),
    )
    n, u = F.col("stale_source_count"), F.col("undated_source_count")
    warn = F.array_compact(F.array(
        F.when(n > 0, F.concat(n, F.when(n == 1, " source is older than ").otherwise(" sources are older than "), F.lit(f"{days} days"))),
        F.when(u > 0, F.concat(u, F.when(u == 1, " source has no date metadata").otherwise(" sources have no date metadata"))),
    ))
    return rows.withColumn("warnings", warn)


def gaps(b: DataFrame) -> DataFrame:
    """Messages about what the evidence lacks."""
    some = F.array_compact(F.array(
        F.when(F.size("missing_terms") > 0, F.concat(F.lit("No source explicitly mentions: "), F.array_join("missing_terms", ", "))),
        F.when(_count(lambda c: c["score"] >= fixed.STRONG_SCORE) == 0, F.lit("No high-confidence source crossed the strong evidence threshold.")),
    ))
    none = F.array(F.lit("No supporting sources were found."))
    return b.select("query_id", F.when(F.size("cites") == 0, none).otherwise(some).alias("gaps"))


def _cue(text: Column, words) -> Column:
    return F.rlike(text, F.lit("|".join(words)))


def contradictions(b: DataFrame) -> DataFrame:
    """Pairs of a question's citations that share two query terms while one affirms and the other denies.

    At most k·(k-1)/2 pairs per question; cues match inside words.
    """
    low = F.transform(
        "cites",
        lambda c: F.struct(
            c["rank"].alias("rank"), c["doc_id"].alias("doc_id"),
            F.array_intersect(F.col("terms"), tokens(c["excerpt"])).alias("shared"),
            _cue(F.lower(c["excerpt"]), fixed.POSITIVE_CUES).alias("pos"),
            _cue(F.lower(c["excerpt"]), fixed.NEGATIVE_CUES).alias("neg"),
        ),
    )
    rows = b.select("query_id", low.alias("c")).select("query_id", "c", F.explode("c").alias("l"))
    rows = rows.select("query_id", "l", F.explode("c").alias("r")).filter("l.rank < r.rank")
    both = F.array_intersect("l.shared", "r.shared")
    conflict = (F.col("l.pos") & F.col("r.neg")) | (F.col("l.neg") & F.col("r.pos"))
    return rows.withColumn("both", both).filter((F.size("both") >= 2) & conflict).select(
        "query_id",
        F.col("l.doc_id").alias("left_doc_id"),
        F.col("r.doc_id").alias("right_doc_id"),
        F.col("l.rank").alias("left_rank"),
        F.col("r.rank").alias("right_rank"),
        F.array_join(F.slice("both", 1, 3), " ").alias("topic"),
    )


def answer_brief(b: DataFrame) -> DataFrame:
    """First sentence of the citation with the highest score."""
    best = F.array_max(F.transform("cites", lambda c: F.struct(c["score"].alias("s"), (-c["rank"]).alias("o"), c.alias("c"))))["c"]
    text = F.concat(
        F.lit("Found "), F.size("cites"), F.lit(" supporting source(s). Strongest source, "), best["title"], F.lit(", says: "),
        F.get(sentences(best["excerpt"]), F.lit(0)),
    )
    return b.select("query_id", F.when(F.size("cites") > 0, text).alias("answer_brief"))


# --- graphs -------------------------------------------------------------------------------------------
def answer_id(question: Column) -> Column:
    return F.concat(F.lit("answer:"), short_hash(strip(question), 16))


def edge(source: Column, target: Column, kind: str | Column) -> list[Column]:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return [
        F.concat(source, F.lit("->"), target, F.lit(":"), kind).alias("id"), source.alias("source"),
        target.alias("target"), kind.alias("type"),
    ]


def _exploded(b: DataFrame) -> DataFrame:
    return b.select(
        "query_id", answer_id(F.col("question")).alias("answer"), "found_terms", F.explode("cites").alias("c")
    ).withColumn("citation", F.concat(F.lit("citation:"), F.col("c.doc_id")))


def citation_graph(b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answer, citation and concept nodes; cites, mentions, covers and contradicts edges, per question."""
    rows = _exploded(b)
    text = F.lower(F.concat(F.col("c.title"), F.lit(" "), F.col("c.excerpt")))
    topics = F.transform(F.filter("c.topics", safe_concept_label), lambda x: F.lower(strip(x)))
    mentioned = let(text, lambda y: F.filter("found_terms", lambda x: F.contains(y, x) & safe_concept_label(x)))
    concepts = F.array_distinct(F.transform(F.concat(topics, mentioned), lambda x: collapse_ws(F.lower(x))))
    rows = rows.withColumn("concepts", F.filter(concepts, lambda x: x != ""))
    each = rows.select("query_id", "answer", "citation", "found_terms", F.explode("concepts").alias("concept"))
    each = each.withColumn("concept_id", F.concat(F.lit("concept:"), slug(F.col("concept"))))
    nodes = (
        b.select("query_id", answer_id(F.col("question")).alias("id"), F.lit("answer").alias("type"), F.lit("Think answer").alias("label"))
        .unionByName(rows.select("query_id", F.col("citation").alias("id"), F.lit("citation").alias("type"), F.col("c.title").alias("label")))
        .unionByName(
            each.groupBy("query_id", F.col("concept_id").alias("id")).agg(
                F.lit("concept").alias("type"), F.min("concept").alias("label")
            )
        )
    )
    c = F.col
    covered = each.filter(F.array_contains("found_terms", F.col("concept")))
    against = contradictions(b)
    cid = lambda name: F.concat(F.lit("citation:"), F.col(name))
    edges = (
        rows.select("query_id", *edge(c("answer"), c("citation"), "cites"))
        .unionByName(each.select("query_id", *edge(c("citation"), c("concept_id"), "mentions")))
        .unionByName(covered.select("query_id", *edge(c("answer"), c("concept_id"), "covers")))
        .unionByName(against.select("query_id", *edge(cid("left_doc_id"), cid("right_doc_id"), "contradicts")))
        .distinct()
    )
    return nodes, edges


def cited_entities(b: DataFrame) -> DataFrame:
    """Safe entities of each citation in order: (query_id, answer, citation, rank, pos, entity_type, label, entity_id)."""
    rows = _exploded(b)
    fields = b.schema["cites"].dataType.elementType.fieldNames()
    none = F.array().cast("array<struct<entity_type:string,raw:string>>")
    lists = [none] + [
        F.transform(F.coalesce(F.col("c")[name], F.array()), lambda v: F.struct(F.lit(kind).alias("entity_type"), v.alias("raw")))
        for name, kind in SAFE_FIELDS if name in fields
    ]
    if "entities" in fields:
        lists.append(F.transform(
            F.coalesce(F.col("c.entities"), F.array()), lambda v: F.struct(infer_entity_type(v).alias("entity_type"), v.alias("raw"))
        ))
    every = F.filter(F.concat(*lists), lambda x: x["entity_type"].isNotNull() & safe_entity_label(x["raw"]))
    named = F.transform(every, lambda x: F.struct(x["entity_type"].alias("entity_type"), collapse_ws(x["raw"]).alias("label")))
    rows = rows.withColumn("_e", named)
    keys = F.transform("_e", lambda x: F.concat(x["entity_type"], F.lit(":"), F.lower(x["label"])))
    rows = rows.withColumn("_k", keys)
    unique = F.filter("_e", lambda x, i: F.array_position("_k", F.get("_k", i)) == i + 1)
    each = rows.select("query_id", "answer", "citation", F.col("c.rank").alias("rank"), F.posexplode(unique).alias("pos", "e"))
    return each.select(
        "query_id", "answer", "citation", "rank", "pos", "e.entity_type", "e.label",
        F.concat(F.lit("entity:"), F.col("e.entity_type"), F.lit(":"), slug(F.col("e.label"))).alias("entity_id"),
    )


def entity_graph(b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entity nodes and edges of the cited evidence. Persons never appear.

    Co-occurrence pairs come from one excerpt at a time; excerpts have at most 700 characters.
    """
    ents = cited_entities(b)
    c = F.col
    rows = _exploded(b)
    nodes = (
        b.select("query_id", answer_id(F.col("question")).alias("id"), F.lit("answer").alias("type"), F.lit("Think answer").alias("label"))
        .unionByName(rows.select("query_id", c("citation").alias("id"), F.lit("citation").alias("type"), c("c.title").alias("label")))
        .unionByName(
            ents.groupBy("query_id", c("entity_id").alias("id")).agg(
                F.lit("entity").alias("type"), F.min_by("label", F.struct("rank", "pos")).alias("label")
            )
        )
    )
    right = ents.select("query_id", "rank", c("pos").alias("_pos"), c("entity_id").alias("_id"))
    pairs = ents.join(right, ["query_id", "rank"]).filter(c("pos") < c("_pos"))
    edges = (
        rows.select("query_id", *edge(c("answer"), c("citation"), "cites"))
        .unionByName(ents.select("query_id", *edge(c("citation"), c("entity_id"), "mentions_entity")))
        .unionByName(ents.select("query_id", *edge(c("answer"), c("entity_id"), "answers_with_entity")))
        .unionByName(pairs.select("query_id", *edge(c("entity_id"), c("_id"), "co_occurs")))
        .distinct()
    )
    return nodes, edges


def entity_counts(b: DataFrame) -> DataFrame:
    """Entities per question and type, and persons held back."""
    counted = cited_entities(b).groupBy("query_id", "entity_type").agg(F.count("*").alias("n"))
    if "persons" not in b.schema["cites"].dataType.elementType.fieldNames():
        return counted
    held = b.select(
        "query_id", F.lit("redacted_person").alias("entity_type"),
        F.aggregate("cites", F.lit(0), lambda s, x: s + F.coalesce(F.size(x["persons"]), F.lit(0))).cast("long").alias("n"),
    ).filter("n > 0")
    return counted.unionByName(held)


# --- maintenance of citations ------------------------------------------------------------------------------
def citation_maintenance(b: DataFrame, as_of: str, days: int = fixed.FRESHNESS_DAYS) -> DataFrame:
    """Repair actions per question: stale, undated, missing terms, weak evidence, contradictions."""
    def folded(values: Column) -> Column:
        flat = F.filter(F.transform(values, lambda x: collapse_ws(x)), lambda x: x != "")
        low = F.transform(flat, lambda x: F.lower(x))
        return F.filter(flat, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)

    def actions(rows: DataFrame, kind: str, severity: str, reason: Column, ids: Column, terms: Column, tool: str) -> DataFrame:
        query = F.trim(F.array_join(F.concat(F.array(strip(F.col("question"))), folded(terms)), " "))
        return rows.select(
            "query_id", F.lit(kind).alias("type"), F.lit(severity).alias("severity"), reason.alias("reason"),
            F.lit(tool).alias("suggested_tool"), ids.alias("citation_doc_ids"), query.alias("repair_query"),
        )

    each = b.select("query_id", "question", F.explode("cites").alias("c"))
    one = F.array(F.col("c.doc_id"))
    stale = each.filter(age_days(as_of, F.col("c.date")) > days)
    undated = each.filter(F.col("c.date").isNull())
    missing = b.filter(F.size("missing_terms") > 0)
    strong = _count(lambda c: c["score"] >= fixed.STRONG_SCORE)
    weak = b.filter((F.size("cites") > 0) & (strong == 0))
    none = F.array().cast("array<long>")
    against = contradictions(b).join(b.select("query_id", "question"), "query_id")
    out = (
        actions(stale, "refresh_stale_citation", "high", F.lit(f"Source is older than {days} days"), one,
                F.concat(F.array("c.title"), F.col("c.topics")), "search_documents")
        .unionByName(actions(undated, "add_source_date", "medium", F.lit("Source has no date metadata"), one,
                             F.array("c.title", "c.source"), "write_memory"))
        .unionByName(actions(missing, "retrieve_missing_context", "medium",
                             F.concat(F.lit("No source explicitly covers: "), F.array_join("missing_terms", ", ")), none,
                             F.col("missing_terms"), "think"))
        .unionByName(actions(weak, "improve_low_confidence_evidence", "medium",
                             F.lit("No cited source crossed the strong evidence threshold"),
                             F.transform("cites", lambda c: c["doc_id"]), F.col("found_terms"), "search_documents"))
        .unionByName(actions(against, "resolve_contradiction", "high", F.concat(F.lit("Sources disagree on "), F.col("topic")),
                             F.array("left_doc_id", "right_doc_id"), F.array("topic"), "think"))
    )
    ids = F.array_join(F.col("citation_doc_ids").cast("array<string>"), ",")
    return out.withColumn("action_id", stable_id(F.col("type"), ids, F.col("repair_query")))


def action_priority(actions: DataFrame) -> DataFrame:
    return actions.groupBy("query_id").agg(
        F.when(F.bool_or(F.col("severity") == "high"), "high").otherwise("medium").alias("priority"),
        F.count("*").alias("action_count"),
    )


def citation_replacements(b: DataFrame, candidates: DataFrame, as_of: str, days: int = fixed.FRESHNESS_DAYS) -> DataFrame:
    """Best newer candidate for every stale citation of a question.

    ``candidates`` are citations of the same questions (a bounded list each), e.g. a wider search.
    """
    text = lambda p: F.concat_ws(" ", F.col(f"{p}.title"), F.col(f"{p}.excerpt"), F.array_join(f"{p}.topics", " "))
    stale = b.select("query_id", F.explode("cites").alias("c")).filter(age_days(as_of, F.col("c.date")) > days)
    cand = candidates.select("query_id", F.struct("rank", "doc_id", "title", "excerpt", "score", "date", "topics").alias("n"))
    pairs = stale.join(cand, "query_id").filter(F.col("n.date") > F.col("c.date"))
    overlap = F.size(F.array_intersect(long_terms(text("c")), long_terms(text("n"))))
    pairs = pairs.withColumn("overlap", overlap).filter("overlap > 0")
    pairs = pairs.withColumn("total", F.round(F.col("n.score") + F.col("overlap"), 6)).withColumn("stale_doc", F.col("c.doc_id"))
    best = top_k(pairs, ["query_id", "stale_doc"], [F.desc("total"), F.asc("n.rank")], 1)
    return best.select(
        "query_id", F.col("stale_doc").alias("replaces_doc_id"), F.col("n.doc_id").alias("candidate_doc_id"),
        F.col("n.title").alias("title"), F.col("n.date").alias("date"), F.col("n.score").alias("score"),
        F.datediff("n.date", "c.date").alias("freshness_delta_days"),
    )


def maintenance_graph(b: DataFrame, actions: DataFrame, replacements: DataFrame) -> DataFrame:
    """Edges answer→action, action→citation and candidate→stale citation, per question."""
    answers = b.select("query_id", answer_id(F.col("question")).alias("answer"))
    acted = actions.join(answers, "query_id").withColumn("node", F.concat(F.lit("action:"), "action_id"))
    c = F.col
    repairs = acted.select("query_id", "node", F.explode("citation_doc_ids").alias("d"))
    cid = lambda col: F.concat(F.lit("citation:"), col)
    return (
        acted.select("query_id", *edge(c("answer"), c("node"), "needs_maintenance"))
        .unionByName(repairs.select("query_id", *edge(c("node"), cid(c("d")), "repairs")))
        .unionByName(replacements.select(
            "query_id", *edge(F.concat(F.lit("candidate:"), "candidate_doc_id"), cid(c("replaces_doc_id")), "can_replace")
        ))
        .distinct()
    )


def think(questions: DataFrame, results: DataFrame, as_of: str, k: int = 8) -> dict[str, DataFrame]:
    """All evidence tables of a set of questions, keyed by query_id."""
    cites = citations(results, k).persist()  # every table below starts from the citations
    b = bundle(questions, cites).persist()
    actions = citation_maintenance(b, as_of)
    nodes, edges = citation_graph(b)
    e_nodes, e_edges = entity_graph(b)
    return {
        "answers": answer_brief(b), "citations": cites, "coverage": coverage(b), "freshness": freshness(b, as_of),
        "gaps": gaps(b), "contradictions": contradictions(b), "citation_nodes": nodes, "citation_edges": edges,
        "entity_nodes": e_nodes, "entity_edges": e_edges, "actions": actions, "priority": action_priority(actions),
    }
