"""Percentiles, sessions and phrases against plain versions, with one group that holds most rows."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from mnemolake.operators import quality, retrieval
from mnemolake.streaming import jobs


def test_percentiles_are_exact(spark):
    rng = random.Random(5)
    wide = [rng.choice([-1, 1]) * math.exp(rng.uniform(-200, 200)) for _ in range(300)]
    groups = {
        "hot": [rng.gauss(50, 20) for _ in range(2000)] + [7.25] * 900,
        "wide": wide + [0.0, -0.0, 1e308, -1e308, 5e-324],
        "near": [1 + i * 2.0**-52 for i in range(400)],
        "one": [3.5],
        "two": [1.0, 2.0],
        None: [4.0, 4.0, 9.0],
    }
    rows = [(g, v) for g, values in groups.items() for v in values] + [("hot", None), ("empty", None)]
    runs = spark.createDataFrame(rows, "kind string, value double")
    got = {r["kind"]: r for r in quality.latency_stats(runs, ["kind"], 60).collect()}
    assert set(got) == {*groups, "empty"}
    assert got["empty"]["n"] == 1 and got["empty"]["median"] is None and got["empty"]["p95"] is None
    for g, values in groups.items():
        v, n = sorted(values), len(values)
        assert got[g]["n"] == n + (g == "hot")
        assert got[g]["p95"] == v[(n * 95 + 99) // 100 - 1]
        assert got[g]["within_budget"] == (got[g]["p95"] <= 60)
        median = (v[(n + 1) // 2 - 1] + v[n // 2]) / 2
        assert got[g]["median"] == pytest.approx(median, abs=1e-6)


def test_values_at_orders_infinite_and_nan_last(spark):
    values = [float("-inf"), -2.0, -1.5, 0.0, 1.5, 2.0, float("inf"), float("nan")]
    counts = spark.createDataFrame([("g", v, 1) for v in values], "group string, value double, n long")
    wanted = spark.createDataFrame([("g", str(i), i) for i in range(1, 10)], "group string, which string, rank long")
    got = {int(r["which"]): r["value"] for r in quality.values_at(counts, wanted).collect()}
    assert [repr(got[i]) for i in range(1, 9)] == [repr(v) for v in values] and 9 not in got


@pytest.mark.parametrize("gap", ["1 hour", "10 minutes"])
def test_sessions_match_session_windows(spark, gap):
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    seconds = lambda n, span: [rng.randrange(span) for _ in range(n)]
    edges = [0, 600, 1199, 1800, 3600, 7199, 7200, 10800, 14401]  # exactly one gap apart, and one second less or more
    users = {1: seconds(3000, 40 * 3600), 2: seconds(20, 40 * 3600), 3: edges, 4: [5], None: seconds(10, 9000)}
    rows = [(u, start + dt.timedelta(seconds=s)) for u, times in users.items() for s in times] + [(1, None)]
    events = spark.createDataFrame(rows, "user_id int, ts timestamp")
    plain = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("accesses"), F.max("ts").alias("last_access"))
    plain = plain.select("user_id", F.col("w.start").alias("started_at"), "last_access", F.col("w.end").alias("expires_at"), "accesses")
    got = jobs.sessions(events, gap)
    assert got.columns == plain.columns
    key = lambda r: (r["user_id"] is None, r["user_id"] or 0, r["started_at"])
    assert sorted(got.collect(), key=key) == sorted(plain.collect(), key=key)


def test_phrases_inside_words_and_of_stop_words(spark):
    docs = spark.createDataFrame(
        [(1, "a", "The concatenated list"), (2, "b", "It is what it IS, they say"), (3, "c", "cat and list"), (4, "d", None), (5, "e", "")],
        "doc_id int, title string, text string",
    )
    queries = spark.createDataFrame(
        [(1, "cat"), (2, "what it is"), (3, "nated lis"), (4, "missing"), (5, None), (6, ""), (7, "CAT")], "query_id int, text string"
    )
    hits = {(r["query_id"], r["doc_id"]) for r in retrieval.phrase_hits(queries, docs, block=2).collect()}
    assert hits == {(1, 1), (1, 3), (7, 1), (7, 3), (2, 2), (3, 1)}
    scores = {(r["query_id"], r["doc_id"]): r["score"] for r in retrieval.term_coverage_search(queries, docs).collect()}
    assert scores[1, 1] == 2.0 and scores[1, 3] == 3.0  # the phrase alone; the term and the phrase
    assert scores[3, 1] == 1.0 and scores[2, 2] >= 2.0  # two terms inside words; stop words
    assert retrieval.phrase_hits(queries.limit(0), docs).count() == 0
