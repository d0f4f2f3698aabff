"""Restrictions hold before the cut: blocked hits never take the place of allowed ones."""

from pyspark.sql import functions as F

from mnemolake.operators import consent, memory, retrieval

QUERY = "query_id long, text string"


def ranked(df):
    return [(r.doc_id, r["rank"]) for r in df.orderBy("rank").collect()]


def test_blocked_best_hits(spark):
    # the best 50 hits repeat the word and are blocked
    rows = [(i, "ship " * (60 - i) if i < 50 else f"ship and other words number {i}", "b" if i < 50 else "a") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    queries = spark.createDataFrame([(1, "ship")], QUERY)
    staged = docs.select("doc_id", F.when(F.col("source") == "b", "document").otherwise("kept").alias("stage"))
    assert ranked(consent.consented_search(queries, docs, staged)) == [(50 + i, 1 + i) for i in range(10)]
    held = consent.held_back(retrieval.bm25_search(queries, docs, 30), staged).collect()
    assert [(r.stage, r.n) for r in held] == [("document", 30)]


def test_governance_before_the_cut(spark):
    rows = [(i, "ship " * (130 - i), "rejected" if i < 120 else "accepted") for i in range(125)]
    memories = spark.createDataFrame(rows, "doc_id long, content string, state string").withColumns({
        "expires_at": F.lit(None).cast("timestamp"), "created_at": F.lit("2026-01-01").cast("timestamp"), "workspace": F.lit("w"),
        "kind": F.lit("k"), "memory_key": F.lit("m"),
    })
    found = memory.memory_search(memories, "2026-06-01", 20, queries=spark.createDataFrame([(1, "ship")], QUERY))
    assert ranked(found) == [(120 + i, 1 + i) for i in range(5)]


def test_topic_before_the_cut_and_fallback(spark):
    rows = [(i, "ship " * (60 - i) if i < 50 else f"ship number {i}", ["Sea"] if i >= 50 else ["land"]) for i in range(55)] + [(99, "tree", ["land"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, topics array<string>")
    queries = spark.createDataFrame([(1, "ship"), (2, "tree")], QUERY)
    found = retrieval.topic_search(queries, docs, "sea", 3, fallback=True)
    assert ranked(found.filter("query_id = 1")) == [(50, 1), (51, 2), (52, 3)]
    assert ranked(found.filter("query_id = 2")) == [(99, 1)]
    assert retrieval.topic_search(queries, docs, "sea", 3).filter("query_id = 2").count() == 0


def test_every_event_counts(spark):
    rows = [(i, f"actor{i % 70}", f"key{i}") for i in range(300)]
    events = spark.createDataFrame(rows, "doc_id long, actor string, memory_key string").withColumns({
        "workspace": F.lit("w"), "version": F.lit(1), "state": F.lit("accepted"), "kind": F.lit("k"), "created_at": F.lit("2026-01-01").cast("timestamp"),
    })
    row = memory.activity_summary(memory.actor_activity(events, limit=None)).first()
    assert (row.event_count, row.actor_count, row.memory_count) == (300, 70, 300)
    assert memory.actor_activity(events).count() == 50
