"""The stored index gives the hits of scoring every document, whatever it skips."""

import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from mnemolake.operators import retrieval, text_index
from mnemolake.operators.common import top_k


def corpus(n, seed=1, ids=int):
    rng = random.Random(seed)
    rows = [(ids(i), " ".join(f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(rng.randrange(0, 60)))) for i in range(n)]
    return rows + [(ids(n), None), (ids(n + 1), ""), (ids(n + 2), "W1 w2, W3!"), (ids(n + 3), "w1 w2 w3")]


def queries(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.5)) % 300}" for _ in range(rng.randrange(1, 12)))) for i in range(40)]
    return spark.createDataFrame(rows + [(90, None), (91, "nothing known"), (92, "")], "query_id long, text string")


def rows_of(df):
    return sorted(map(tuple, df.select("query_id", "rank", "doc_id", F.round("score", 5)).collect()))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(400), "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("size", [dict(shard_docs=25), dict(shard_words=200), {}])
def test_search_is_exact(spark, docs, tmp_path, size):
    path = str(tmp_path / "index")
    index = text_index.build_index(docs, path, **size)
    want = top_k(retrieval.bm25_scores(queries(spark), docs), ["query_id"], retrieval.by_score(), 7)
    assert rows_of(text_index.search_index(index, queries(spark), 7)) == rows_of(want)
    # read again from its folder, only some documents allowed, other parameters
    stored, some = text_index.read_index(spark, path), docs.filter("doc_id % 7 = 3")
    scored = retrieval.bm25_scores(queries(spark), docs, 0.9, 0.4).join(some.select("doc_id"), "doc_id")
    want = top_k(scored.filter("score >= 1"), ["query_id"], retrieval.by_score(), 3)
    assert rows_of(text_index.search_index(stored, queries(spark), 3, 1.0, some, 0.9, 0.4)) == rows_of(want)


def test_blocks_of_queries(spark, docs, monkeypatch):
    want = rows_of(retrieval.bm25_search(queries(spark), docs, 4))
    monkeypatch.setattr(text_index, "QUERY_BLOCK", 5)
    assert rows_of(retrieval.bm25_search(queries(spark), docs, 4, index=text_index.build_index(docs, shard_docs=50))) == want


def test_text_ids_and_nothing(spark):
    docs = spark.createDataFrame(corpus(30, ids=lambda i: f"d{i}"), "doc_id string, text string")
    want = top_k(retrieval.bm25_scores(queries(spark), docs), ["query_id"], retrieval.by_score(), 5)
    assert rows_of(retrieval.bm25_search(queries(spark), docs, 5)) == rows_of(want)
    assert retrieval.bm25_search(queries(spark), docs.limit(0)).count() == 0
    assert retrieval.bm25_search(queries(spark).limit(0), docs).count() == 0


def test_statistics_are_bounds(docs):
    index = text_index.build_index(docs, shard_docs=40)
    heads = index.shards.select("shard", "lengths")
    wrong = index.postings.join(heads, "shard").filter(
        (F.col("df") != F.size("places")) | (F.col("top_count") != F.array_max("counts"))
        | (F.col("least_length") != F.array_min(F.transform("places", lambda p: F.get("lengths", p))))
    )
    assert wrong.count() == 0
    assert index.shards.select(F.sum(F.size("ids"))).first()[0] == docs.count()
    assert index.postings.groupBy("bucket").agg(F.count_distinct("term")).count() <= text_index.BUCKETS


lists = st.lists(st.dictionaries(st.integers(0, 29), st.floats(0.01, 5), min_size=1), min_size=1, max_size=6)


@settings(max_examples=300, deadline=None)
@given(lists, st.integers(1, 5), st.floats(0, 8), st.one_of(st.none(), st.sets(st.integers(0, 29))))
def test_skipping_loses_no_hit(terms, k, least, only):
    arrays = [(np.array(sorted(t)), np.array([t[p] for p in sorted(t)])) for t in terms]
    allowed = None if only is None else np.isin(np.arange(30), list(only))
    want = np.zeros(30)
    for places, weights in arrays:
        want[places] += weights
    if allowed is not None:
        want[~allowed] = -np.inf
    got = text_index.score_shard(arrays, 30, k, least, allowed)
    assert (got <= want + 1e-9).all()
    best = np.argsort(-want, kind="stable")[:k]
    for i in best:
        if want[i] > 0 and want[i] >= least:
            assert abs(got[i] - want[i]) < 1e-9
