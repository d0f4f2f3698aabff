"""Search by the terms of known queries gives the hits of scoring every document, and reads the texts once."""

import pytest
from pyspark.sql import functions as F

from mnemolake.operators import retrieval, term_search
from mnemolake.operators.chunking import chunk_documents
from mnemolake.operators.common import top_k
from test_text_index import corpus, queries, rows_of


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(400), "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("cells, words", [(term_search.BLOCK_CELLS, term_search.BLOCK_WORDS), (43 * 9, 300)])
def test_search_is_exact(spark, docs, monkeypatch, cells, words):
    monkeypatch.setattr(term_search, "BLOCK_CELLS", cells)
    monkeypatch.setattr(term_search, "BLOCK_WORDS", words)
    index = term_search.index_for(docs, queries(spark))
    want = top_k(retrieval.bm25_scores(queries(spark), docs), ["query_id"], retrieval.by_score(), 7)
    assert rows_of(term_search.search_for(index, queries(spark), 7)) == rows_of(want)
    some, few = docs.filter("doc_id % 7 = 3"), queries(spark).filter("query_id % 3 = 0")
    scored = retrieval.bm25_scores(few, docs, 0.9, 0.4).join(some.select("doc_id"), "doc_id")
    want = top_k(scored.filter("score >= 1"), ["query_id"], retrieval.by_score(), 3)
    assert rows_of(term_search.search_for(index, few, 3, 1.0, some, 0.9, 0.4)) == rows_of(want)


def test_many_queries_use_a_stored_index(spark, docs, monkeypatch):
    want = rows_of(retrieval.bm25_search(queries(spark), docs, 4))
    monkeypatch.setattr(term_search, "MOST_QUERIES", 5)
    assert term_search.index_for(docs, queries(spark)) is None
    assert rows_of(retrieval.bm25_search(queries(spark), docs, 4)) == want


def test_copies_tie_by_id(spark):
    docs = spark.createDataFrame([(f"d{i:03}", "b a b c" if i % 2 else "a z") for i in range(300)], "doc_id string, text string").repartition(4)
    asked = spark.createDataFrame([(1, "c b"), (2, "A")], "query_id long, text string")
    hits = retrieval.bm25_search(asked, docs, 3).orderBy("query_id", "rank").collect()
    assert [(h.query_id, h.doc_id) for h in hits] == [(1, "d001"), (1, "d003"), (1, "d005"), (2, "d000"), (2, "d002"), (2, "d004")]


def test_texts_are_read_once(spark):
    """Every text is cut and counted by one pass, also where hits name their parents."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def noted(text):
        seen.add(1)
        return text

    rows = [(i, "one two. " * 1500 + f"w{i}") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    watched = chunk_documents(docs).withColumn("text", noted("text"))
    n = chunk_documents(docs).count()
    hits = retrieval.multilevel_search(queries(spark), docs, watched)
    hits.collect()
    assert n > 6 and seen.value == n
    asked = spark.createDataFrame([(1, "w3 one")], "query_id long, text string")
    best = retrieval.multilevel_search(asked, docs, chunk_documents(docs), k=2).collect()
    assert {h.parent_id for h in best} == {3} and {h.level for h in best} == {"document", "chunk"}


@pytest.mark.parametrize("name", ["citation_replacements", "maintenance_graph"])
def test_evidence_searches_once(spark, monkeypatch, name):
    from mnemolake.plans import all_queries, reasoning

    calls = []
    search = reasoning.r.bm25_search
    monkeypatch.setattr(reasoning.r, "bm25_search", lambda *a, **kw: calls.append(1) or search(*a, **kw))
    assert all_queries()[name](spark, "/root/testdata/sf0.001").count() > 0
    assert len(calls) == 1


def test_only_hit_documents_are_cut_into_sentences(spark, monkeypatch):
    """No more vectors are joined than the hits have sentences."""
    from mnemolake.plans import all_queries, enrichment

    given = []
    monkeypatch.setattr(enrichment.e, "passage_embedding", lambda pairs, vectors: given.append((pairs, vectors)) or pairs)
    all_queries()["passage_embedding"](spark, "/root/testdata/sf0.001")
    pairs, vectors = given[0]
    assert vectors.join(pairs.select("doc_id").distinct(), "doc_id", "left_anti").count() == 0 < vectors.count()
