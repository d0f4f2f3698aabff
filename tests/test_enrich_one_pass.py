"""Enrichment in one pass: the same results as the expressions, text by text, and no shuffle."""

import random

import pytest
from pyspark.sql import functions as F

from mnemolake.functions import fixed
from mnemolake.functions.text import SPACES, WordFinder, Words, find_all, first_class, flat_loops, has_match, lowered, needed, strip, unicode_regex
from mnemolake.operators import enrich, passages

PIECES = (
    "Berlin Müller İstanbul ΣΑΣ Éa ⓐBc ²Go camelCase fooBarBaz a_b foo_bar_baz _x_y MAX_SIZE A__B x́camelCase camelCasé "
    "important Key result said wrote by from with to in at near Anna Bob Smith Dr. Mr. Acme Inc. Corp. Team company joined today last week "
    "next year January Jan. 3rd 2024 3, 2024 12/05/2024 2024-05-01 Q3 Q3 2024 FY 24 noon 10:30 pm 5PM $1,000.50 million 20 users 3x deployed "
    "testing Python c++ C# Go Node.js REST API @user \"quoted name\" 'x' [a.b] {} ; def f( import os class A # title learn learning concept "
    "Street City Road University of alphas betas running runs ٣٤ Ⅳa ＡＢ ñandú Ñu"
).split(" ")


def odd_texts(n: int) -> list:
    rng = random.Random(8)
    ends = [". ", "! ", "?\n", " ", " ", " ", " ", "\n", " ", " ", "\x1c", ".", ", ", "\t"]
    texts = ["", "  \n", "ab", "x" * 19, " short text ", "a" * 199, "b" * 200, "c" * 1000, "d" * 1001, " ".join(["Word."] * 900)]
    for i in range(n):
        size = rng.choice((5, 30, 120, 400))
        texts.append("".join(rng.choice(PIECES) + rng.choice(ends) for _ in range(rng.randint(1, size))))
    return texts


@pytest.fixture(scope="module")
def texts(spark):
    rows = [*enumerate(odd_texts(150)), (10_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"source": F.lit("notes"), "filename": F.lit("readme.txt")}).localCheckpoint()


def taxonomy_of(spark):
    rows = [("python", "t1", 2.0), ("run", "t2", 1.0), ("alpha", "t3", 1.5), ("berlin", "t1", 1.0), ("berlin", "t4", 3.0), ("beta", None, 1.0), ("learn", "t5", 2.0)]
    return spark.createDataFrame(rows, "keyword string, topic string, weight double")


def test_documents_are_enriched_in_one_pass_as_by_the_expressions(spark, texts, monkeypatch):
    taxonomy = taxonomy_of(spark)
    found = enrich.enrich_documents(texts, taxonomy)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and plan.count("ArrowEvalPython") == 1
    rows = {r["doc_id"]: r for r in found.collect()}
    assert len(rows) == texts.count()
    usable = texts.filter(F.length(strip(F.col("text"))) > 0)
    size = F.length("text")
    parts = (
        usable.filter(size < 200).select("doc_id", F.array(strip(F.col("text"))).alias("key_sentences")),
        enrich.key_sentences(usable.filter((size >= 200) & (size <= 1000)), 5),
        enrich.key_sentences_chunked(usable.filter(size > 1000), 5),
    )
    want = {r["doc_id"]: r["key_sentences"] for part in parts for r in part.collect()}
    assert {i: r["key_passages"] for i, r in rows.items() if not r["errors"]} == want
    assert {i: r["entities"] for i, r in rows.items() if not r["errors"]} == {r["doc_id"]: r["entities"] for r in enrich.key_entities(usable).collect()}
    for small in (enrich.SMALL_TAXONOMY, 0):
        topics = {r["doc_id"]: (r["topics"], r["primary_topic"], r["confidence"]) for r in enrich.keyword_topics(usable, taxonomy, small=small).collect()}
        assert {i: (r["topics"], r["primary_topic"], r["confidence"]) for i, r in rows.items() if not r["errors"]} == topics
    failed = [r for r in rows.values() if r["errors"]]
    monkeypatch.setattr(enrich, "SMALL_TAXONOMY", 0)  # too large for the tasks: joined
    assert {r["doc_id"]: r for r in enrich.enrich_documents(texts, taxonomy).collect()} == rows
    assert {r["doc_id"] for r in failed} == {0, 1, 10_000}
    assert all(r["errors"] == ["empty_text"] and r["structured"] is None and r["entities"] is None and r["topics"] is None for r in failed)


def test_patterns_find_the_same_behind_the_words_they_need(texts):
    plain = [getattr(fixed, name) for name in ("CAMEL_CASE_STRICT", "SNAKE_CASE_STRICT", "PERSON_TITLE_PATTERN", "ORGANIZATION_PATTERN", "LOCATION_PATTERN")]
    grouped = [*fixed.PERSON_CONTEXT_PATTERNS, *fixed.ORGANIZATION_CONTEXT_PATTERNS]
    any_case = [*fixed.DATE_PATTERNS, *fixed.TIME_PATTERNS, *fixed.TEMPORAL_PATTERNS, *fixed.QUANTITY_PATTERNS, *fixed.ACTIVITY_PATTERNS, *grouped]
    kinds = [*fixed.DOCUMENT_TYPES, *[(k, low, p) for k, low, _, p in fixed.CONTENT_TYPE_PATTERNS]]
    tests = [p for _, _, patterns in kinds for p in patterns]
    seen, text = Words(), F.col("text")
    got, want = [], []
    for flag, patterns in (("", [*plain, *grouped]), ("(?i)", any_case)):
        for p in patterns:
            got.append(F.coalesce(find_all(text, p, 0, bool(flag), F.col("_low"), seen), F.array().cast("array<string>")))
            want.append(F.regexp_extract_all(text, F.lit(flag + unicode_regex(flat_loops(p))), F.lit(0)))
    for p in tests:
        got.append(has_match(text, p, low=F.col("_low"), seen=seen))
        want.append(F.rlike(text, F.lit(unicode_regex(p))))
    rows = seen.add(lowered(texts.filter("text is not null"))).select(F.array(*[g.cast("string") for g in got]).alias("g"), F.array(*[w.cast("string") for w in want]).alias("w"))
    hits = [0] * len(got)
    for r in rows.collect():
        assert r["g"] == r["w"]
        hits = [h + (w not in ("[]", "false")) for h, w in zip(hits, r["w"])]
    assert sum(h > 0 for h in hits) > len(hits) // 2


def test_needed_words_and_first_characters():
    assert needed(r"\b(?:at|by)\s+([A-Z]\w+)\s+(?:company|team)") == [["at", "by"], ["company", "team"]]
    assert needed(r"(?:x|ab)?c{0,2}") == [] and needed(r"\b\d{4}\b(?=\s|$)") == [["0"]]
    assert needed("discussion|discuss") == [["discuss"]]
    assert first_class(r"\b(?:last|next)\s") == "ln" and first_class("a?b") is None and first_class(r"\d+x|[a-c]") == r"\p{Nd}a-c"


def test_words_are_found_as_substrings():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abé:") for _ in range(rng.randint(1, 5))) for _ in range(80)})
    finder = WordFinder({*words, "0", "in A", "b A"})
    for _ in range(300):
        text = "".join(rng.choice("abé: ") for _ in range(rng.randint(0, 60))) + rng.choice(["", " in  Ab", "\nb B", "inB", "٣"])
        want = {w for w in words if w in text.lower()}
        want |= {"0"} if "٣" in text else set()
        got = finder(text, text.lower())
        assert set(got) - {"in A", "b A"} == want and len(got) == len(set(got))
        assert ("in A" in got) == text.endswith(" in  Ab")


def test_stream_enriches_every_batch_in_one_pass(spark, tmp_path, monkeypatch):
    from mnemolake.streaming import jobs

    rows = [(i, t) for i, t in enumerate([*odd_texts(30), None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stream = jobs.read_table_stream(spark, str(tmp_path), "documents.parquet", 1)
    plans = []

    def step(df):
        out = enrich.enrich_documents(df.withColumns({"source": F.lit("notes"), "filename": F.lit("a.txt")}), taxonomy_of(spark))
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        failed = out.filter(F.size("errors") > 0).select("doc_id", "errors")
        assert "ArrowEvalPython" not in failed._jdf.queryExecution().executedPlan().toString()
        return out

    def kept(*_):
        raise AssertionError("keeps the results of a batch")

    monkeypatch.setattr(type(docs), "persist", kept)
    jobs.stream_enrich(stream, step, f"{tmp_path}/out", f"{tmp_path}/ck")
    assert len(plans) == 3
    # once for the documents with text and once, without any work on them, for those without
    assert all(plan.count("FileScan") <= 2 and "Exchange" not in plan for plan in plans)
    enriched, failed = spark.read.parquet(f"{tmp_path}/out/enriched"), spark.read.parquet(f"{tmp_path}/out/failed")
    empty = {i for i, t in rows if t is None or not t.strip(SPACES)}
    assert {r["doc_id"] for r in failed.collect()} == empty
    got = {r["doc_id"]: (r["structured"], r["entities"], r["key_passages"], r["topics"]) for r in enriched.collect()}
    whole = enrich.enrich_documents(docs.withColumns({"source": F.lit("notes"), "filename": F.lit("a.txt")}), taxonomy_of(spark)).filter("structured is not null")
    assert got == {r["doc_id"]: (r["structured"], r["entities"], r["key_passages"], r["topics"]) for r in whole.collect()}
    assert len(got) == len(rows) - len(empty)
