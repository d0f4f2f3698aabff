"""Inputs that only larger tables have: tables in several files, long runs of names, many rows per key."""

import os
import random
import re
import sys

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from mnemolake.functions import fixed
from mnemolake.functions.text import find_all, flat_loops
from mnemolake.operators import enrich, upkeep
from mnemolake.streaming import jobs

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry
from check_queries import TABLES, compare, duck

SF = "/root/testdata/sf0.001"


def test_stream_of_a_folder_and_of_a_file(spark, tmp_path):
    spark.range(30).repartition(3).write.parquet(f"{tmp_path}/in/many.parquet")
    one = next((tmp_path / "in/many.parquet").glob("part-*.parquet"))
    (tmp_path / "in/one.parquet").hardlink_to(one)
    for name, n in (("many.parquet", 30), ("one.parquet", spark.read.parquet(f"{tmp_path}/in/one.parquet").count())):
        out = f"{tmp_path}/out/{name}"
        stream = jobs.read_table_stream(spark, f"{tmp_path}/in", name)
        jobs.stream_sync(stream, out, f"{tmp_path}/check/{name}")
        assert spark.read.parquet(out).count() == n


LOOPS = (
    fixed.PERSON_TITLE_PATTERN, fixed.ORGANIZATION_PATTERN, *fixed.ORGANIZATION_CONTEXT_PATTERNS, fixed.LOCATION_PATTERN,
    fixed.CAMEL_CASE_STRICT, fixed.SNAKE_CASE_STRICT, *fixed.QUERY_ORGANIZATION_PATTERNS,
)


def test_flat_loops_match_the_same():
    random.seed(7)
    words = ["Acme", "X", "Team", "Teams", "team", "Inc.", "LLC", "City", "from", "joined", "Dr.", "Foo9", "foo_bar", "fooBar", "B", ".", "company"]
    for _ in range(500):
        text = "".join(random.choice(words) + random.choice([" ", "  ", "\n", " ", "", ", "]) for _ in range(random.randint(1, 25)))
        for pattern in LOOPS:
            for flags in (0, re.IGNORECASE):
                # this engine has no look-behind of open length
                flat = flat_loops(pattern).replace(r"(?=[A-Z])(?<![A-Z][A-Za-z]{0,40}\s{0,1})", "")
                assert re.findall(flat, text, flags) == re.findall(pattern, text, flags), (pattern, text)


def test_names_in_the_engine(spark):
    random.seed(8)
    words = ["Acme", "XY", "Team", "Teams", "team", "Inc.", "LLC", "Foo9", "9Foo", "aB", ".", "company"]
    texts = ["".join(random.choice(words) + random.choice([" ", "  ", " ", "", ", "]) for _ in range(25)) for _ in range(500)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    for pattern in (fixed.ORGANIZATION_PATTERN, fixed.QUERY_ORGANIZATION_PATTERNS[0]):
        found = rows.select("text", find_all(F.col("text"), pattern, 1).alias("f")).collect()
        assert all(r["f"] == re.findall(pattern, r["text"]) for r in found)


def test_long_runs_of_names(spark):
    run = " ".join(["Acme"] * 20_000)
    texts = spark.createDataFrame([(f"from {run} Team",), (f"in {run}",), ("a" + "Bc" * 20_000,)], "text string")
    for pattern in LOOPS:
        texts.select(F.size(find_all(F.col("text"), pattern, 0))).collect()
    found = texts.select(find_all(F.col("text"), fixed.ORGANIZATION_CONTEXT_PATTERNS[0], 1, True).alias("f")).first()["f"]
    assert found == [run]


def test_vehicle_numbers_of_letters_alone(spark):
    from mnemolake.operators import pii

    rows = spark.createDataFrame([(1, "SEEN ABCDEFGHJKLMNPRST HERE"), (2, "nothing here")], "doc_id long, text string")
    found = pii.span_table(pii.detect_pii(rows)).select("doc_id", "pii_type", "value").collect()
    assert [tuple(r) for r in found] == [(1, "VEHICLE_ID", "ABCDEFGHJKLMNPRST")]


def test_words_with_near_copies_only(spark, tmp_path):
    # 30 near copies of one vector and 40 others that are alike but not near: the copies only see each other
    random.seed(9)
    near = [[1.0, 0.001 * i, 0.0] for i in range(30)]
    wide = [[0.0, 1.0, random.random()] for _ in range(40)]
    rows = near + wide
    for name in TABLES:
        if name != "embeddings":
            (tmp_path / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    table = pa.table({
        "vec_id": pa.array(range(len(rows)), pa.int64()), "embedding": pa.array(rows, pa.list_(pa.float32())),
        "label": pa.array([0] * len(rows), pa.int32()),
    })
    pq.write_table(table, tmp_path / "embeddings.parquet")
    got = entry.queries()["perturb_words"](spark, str(tmp_path))
    rows, status, detail = compare(got, duck(str(tmp_path)), entry.oracle_sql()["perturb_words"])
    assert status == "ok" and rows < 70, detail


def test_replacements_are_counted_without_pairs(spark, monkeypatch):
    terms = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    random.seed(3)
    rows = [
        (i, "", " ".join(random.sample(terms, random.randint(0, 2))) + f" only{i}", [], random.choice(["2026-05-20", "2025-01-01", None]))
        for i in range(60)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, title string, text string, topics array<string>, doc_date string")
    docs = docs.withColumn("doc_date", F.to_date("doc_date"))
    best = upkeep.replacement_candidates(docs, "2026-06-01").select(F.col("replaces_doc_id").alias("doc_id"))
    want = sorted(r["doc_id"] for r in best.collect())
    assert 0 < len(want) < sum(r[4] == "2025-01-01" for r in rows)
    for common in (0, 1, 1000):
        found = upkeep.replaceable_documents(docs, "2026-06-01", common=common).collect()
        assert sorted(r["doc_id"] for r in found) == want
    none = docs.filter("doc_date < '2026-01-01'")
    assert upkeep.replaceable_documents(none, "2026-06-01").count() == 0

    def paired(*_):
        raise AssertionError("scores pairs of documents only to count")

    monkeypatch.setattr(upkeep, "replacement_candidates", paired)
    mentions = spark.createDataFrame([], "doc_id long, ord int, entity_type string, label string")
    assert upkeep.snapshot_summary(docs, mentions, "2026-06-01").first()["replacement_candidate_count"] == len(want)


def test_replacements_meet_in_a_grid_and_no_terms_pass_the_driver(spark, monkeypatch):
    random.seed(4)
    terms = [f"word{i}" for i in range(30)]
    rows = [
        (i, "", " ".join(random.sample(terms, random.randint(0, 9))), [], random.choice(["2026-05-20", "2025-01-01", None]))
        for i in range(60)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, title string, text string, topics array<string>, doc_date string")
    docs = docs.withColumn("doc_date", F.to_date("doc_date"))
    words = {r[0]: set(r[2].split()) for r in rows}
    want = set()
    for old in (r[0] for r in rows if r[4] == "2025-01-01"):
        shared, new = max((len(words[old] & words[r[0]]), -r[0]) for r in rows if r[4] == "2026-05-20")
        if shared:
            want.add((old, -new, shared))
    collect, seen = type(docs).collect, []
    monkeypatch.setattr(type(docs), "collect", lambda df: seen.append(df.columns) or collect(df))
    for block, limit in ((32_768, 6_000_000), (7, 6_000_000), (32_768, 20)):
        monkeypatch.setattr(upkeep, "BLOCK_TERMS", limit)
        found = upkeep.replacement_candidates(docs, "2026-06-01", block=block)
        assert all("doc_id" not in columns for columns in seen)
        assert {(r["replaces_doc_id"], r["candidate_doc_id"], r["overlap"]) for r in collect(found)} == want


def test_keyword_topics_shuffle_no_words(spark):
    texts = ["alpha alphas betas, alpha", "  a\n", None, "gamma delta", "beta " * 6, "ab ", " abc "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    taxonomy = spark.createDataFrame(
        [("alpha", "t1", 2.0), ("beta", "t2", 1.0), ("abc", "t3", 3.0)], "keyword string, topic string, weight double"
    )
    found = enrich.keyword_topics(docs, taxonomy)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\([^)]*\bword#", plan)
    assert not re.search(r"hashpartitioning\([^)]*\btext#", plan)
    rows = {r["doc_id"]: r for r in found.collect()}
    assert sorted(map(repr, rows.values())) == sorted(map(repr, enrich.keyword_topics(docs, taxonomy, small=0).collect()))
    assert rows[0]["topics"] == ["t1", "t2"] and rows[4]["primary_topic"] == "t2" and rows[6]["topics"] == ["t3"]
    methods = [rows[i]["method"] for i in range(7)]
    assert methods == [
        "weighted_keyword_match", "empty_text", "keyword_no_match", "keyword_no_match", "weighted_keyword_match", "empty_text",
        "weighted_keyword_match",
    ]
