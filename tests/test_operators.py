"""Operators against small plain statements of their rules, on hand-made rows."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from mnemolake.functions import fixed
from mnemolake.functions.text import glob_to_regex, preview, stem
from mnemolake.operators import (
    aggregates, chunking, common, consent, enrich, identity, listing, memory, perturb, pii, quality, reasoning, retrieval,
    spans, upkeep,
)
from mnemolake.session import scratch_path
from mnemolake.sources import exports, files, sinks, sync
from mnemolake.streaming import jobs


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def docs_of(spark, texts):
    return spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")


def random_text(rng, words, mark=0.15):
    out = []
    for _ in range(words):
        w = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
        if rng.random() < 0.2:
            w = w.capitalize()
        if rng.random() < mark:
            w += rng.choice(".!?\n")
        out.append(w)
    return " ".join(out)


# --- text -------------------------------------------------------------------------------------------
def test_stem_rules_in_order(spark):
    words = ["shopping", "studied", "classes", "happiness", "quickly", "cat", "is", "analysis", "education", "visual", "ring"]

    def rule(w):
        if len(w) <= 3:
            return w
        for suffix, repl in fixed.STEM_RULES:
            if w.endswith(suffix) and len(w) > len(suffix) + 1:
                return w[: -len(suffix)] + repl
        return w

    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r["w"]: r["s"] for r in rows(df.select("w", stem(F.col("w")).alias("s")))} == {w: rule(w) for w in words}
    assert len(fixed.STEM_RULES) == len(set(fixed.STEM_RULES))


def test_preview_cuts_and_glob(spark):
    df = docs_of(spark, ["a  b\n c", "x" * 600])
    got = [r["p"] for r in rows(df.orderBy("doc_id").select(preview(F.col("text"), 500).alias("p")))]
    assert got == ["a b c", "x" * 497 + "..."]
    assert re.match(glob_to_regex("a*.t?t"), "abc.txt") and not re.match(glob_to_regex("a*.t?t"), "abc.txtx")


# --- chunking ---------------------------------------------------------------------------------------------
def loop_chunks(text, size=1000, overlap=150):
    out, start, n = [], 0, len(text)
    while True:
        end = min(start + size, n)
        if start + size < n:
            for i in range(start + size, start + size * 4 // 5, -1):
                if text[i] in ".!?\n":
                    end = i + 1
                    break
        out.append((start, end))
        start = end - overlap
        if start >= n - overlap:
            return out


def test_chunks_equal_plain_loop(spark):
    rng = random.Random(1)
    texts = ["x" * 2000, "y" * 2001, "z" * 1000 + "." + "z" * 1500] + [random_text(rng, rng.randint(300, 1500), rng.choice([0, 0.05, 0.3])) for _ in range(20)]
    got = {}
    for r in rows(chunking.chunk_documents(docs_of(spark, texts))):
        got.setdefault(r["parent_id"], []).append((r["char_start"], r["char_end"], r["text"]))
    for i, text in enumerate(texts):
        want = [(a, b, text[a:b]) for a, b in loop_chunks(text)] if len(text) > 2000 else None
        assert (sorted(got[i]) if i in got else None) == want


# --- identity -----------------------------------------------------------------------------------------------
def test_dedupe_is_idempotent_and_survives_a_hot_text(spark):
    data = [(f"d{i:03}", i, "same" if i % 3 else f"t{i}", "s") for i in range(90)]
    df = spark.createDataFrame(data, "doc_id string, seq long, text string, source string")
    out = identity.dedupe_documents(df)
    kept = {r["doc_id"] for r in rows(out.filter("not is_duplicate"))}
    assert kept == {d[0] for d in data if d[2] != "same"} | {"d001"}
    again = df.filter(F.col("doc_id").isin(*kept))
    assert not any(r["is_duplicate"] for r in rows(identity.dedupe_documents(again)))


def test_same_text_from_two_sources_is_kept(spark):
    df = spark.createDataFrame([("a", 1, "t", "x"), ("b", 2, "t", "y"), ("c", 3, "t", None)], "doc_id string, seq long, text string, source string")
    assert not any(r["is_duplicate"] for r in rows(identity.dedupe_documents(df)))


def test_messages_repeated_in_a_conversation(spark):
    long = "m" * 100
    df = spark.createDataFrame([(1, 0, "user", long + "a"), (1, 1, "user", long + "b"), (1, 2, "bot", long), (2, 0, "user", long)],
                               "conv_id long, turn long, role string, text string")
    assert sorted((r["conv_id"], r["turn"]) for r in rows(identity.dedupe_messages(df))) == [(1, 0), (1, 2), (2, 0)]


def test_bucketed_row_number_equals_window(spark):
    df = spark.range(2000).select((F.col("id") % 7 % 2).alias("k"), (F.hash("id") % 1000).alias("v"), "id")
    w = Window.partitionBy("k").orderBy("v", "id")
    want = {(r["id"], r["n"]) for r in rows(df.withColumn("n", F.row_number().over(w)))}
    got = common.bucketed_row_number(df, ["k"], F.floor(F.col("v") / 50), [F.col("v"), F.col("id")], "n")
    assert {(r["id"], r["n"]) for r in rows(got)} == want


# --- retrieval ------------------------------------------------------------------------------------------------
def test_vector_search_in_blocks_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    corpus, asked = rng.normal(size=(300, 8)), rng.normal(size=(23, 8))
    corpus[5] = corpus[9]  # a tie
    corpus[7] = 0  # a zero vector
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(corpus)], "doc_id long, embedding array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id long, embedding array<double>")
    unit = lambda m: np.divide(m, np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros_like(m), where=np.linalg.norm(m, axis=1, keepdims=True) > 0)
    scores = np.round(unit(asked) @ unit(corpus).T, 6)
    want = {(i, int(d)) for i in range(23) for d in sorted(range(300), key=lambda d: (-scores[i, d], d))[:5]}
    for block in (2000, 5):
        assert {(r["query_id"], r["doc_id"]) for r in rows(retrieval.vector_search(q, c, 5, block=block))} == want


def test_unified_quality_and_hybrid_extremes(spark):
    d = docs_of(spark, ["red apple pie", "green apple", "blue sky"])
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.7, 0.7])], "doc_id long, embedding array<double>")
    q = spark.createDataFrame([(1, "red apple", [0.0, 1.0])], "query_id long, text string, embedding array<double>")
    first = lambda df: rows(df.filter("rank = 1"))[0]["doc_id"]
    assert first(retrieval.hybrid_search(q, d, v, 2, 0)) == 0
    assert first(retrieval.hybrid_search(q, d, v, 2, 1)) == 1
    assert first(retrieval.unified_search(q, d, v, "quality", 2)) == 0


def test_best_excerpt_hint_phrases(spark):
    text = "x " * 400 + "Known allergies: penicillin. " + "y " * 400
    pairs = spark.createDataFrame([(1, 1, "any allergy to note", text)], "query_id long, doc_id long, query string, text string")
    hinted = retrieval.best_excerpt(pairs, anchors=(("allerg", "allergies"),), bonus=("penicillin",))
    assert "penicillin" in rows(hinted)[0]["excerpt"]
    assert "penicillin" not in rows(retrieval.best_excerpt(pairs))[0]["excerpt"]


def test_grep_caps_lines_and_keeps_context(spark):
    text = "\n".join(f"line {i} {'HIT' if i % 2 else ''}" for i in range(40))
    out = rows(retrieval.grep_corpus(docs_of(spark, [text, "nothing"]), "hit", per_file=10))
    assert len(out) == 10 and out[0]["line_number"] == 2 and out[0]["context_before"] == "line 0"
    assert retrieval.grep_corpus(docs_of(spark, [text]), "hit", ignore_case=False).count() == 0
    many = rows(retrieval.grep_corpus(docs_of(spark, ["hit\n" * 30]), "hit", per_file=4))
    assert len(many) == 4 and {r["match_count"] for r in many} == {30}
    assert retrieval.grep_corpus(docs_of(spark, ["hit\n" * 30]), "hit").count() == 30


# --- enrichment ---------------------------------------------------------------------------------------------------
def plain_key_sentences(text, n):
    kept = [s.strip() for s in re.split(r"(?<=[.!?])\s+", text)]
    kept = [s for s in kept if len(s) > 20]
    if not kept:
        return [text[:500]]
    total, scored = len(kept), []
    for i, s in enumerate(kept):
        p = (3 - i if i < 3 else 0) + (2 if total > 5 and i >= total - 2 else 0)
        p += 2 if 50 < len(s) < 200 else 1 if len(s) > 200 else 0
        p += 2 * sum(w in s.lower() for w in fixed.CUE_WORDS) + min(3, sum(w[0].isupper() for w in s.split()[1:]))
        p += bool(re.search(r"\b[a-z]+[A-Z][a-zA-Z]*\b", s)) + bool(re.search(r"\b[a-z]+_[a-z]+\b", s))
        scored.append((-p, i, s))
    scored.sort()
    if total <= 10 or n < 3:
        return [s for _, _, s in scored[:n]]
    third, picked = total // 3, []
    for low, high in ((0, third), (third, 2 * third), (2 * third, total)):
        more = [s for _, i, s in scored if low <= i < high and s not in picked]
        picked += more[:1]
    for _, _, s in scored:
        if s not in picked:
            picked.append(s)
    return picked[:n]


def plain_chunked(text, n, size=1000, overlap=100):
    pieces, start = [], 0
    while start < len(text):
        end, piece = start + size, text[start : start + size]
        if end < len(text):
            mark = max(piece.rfind(c) for c in ".?!")
            if mark > size // 2:
                piece, end = piece[: mark + 1], start + mark + 1
        pieces.append((start, piece))
        start = end - overlap if end < len(text) else end
    pool, seen = [], set()
    for at, piece in pieces:
        for s in plain_key_sentences(piece, n):
            if s.strip().lower() not in seen:
                seen.add(s.strip().lower())
                pool.append((s, at / len(text)))
    if len(pool) <= n:
        return [s for s, _ in pool]
    picked, parts = [], min(n, 3)
    for k in range(parts):
        picked += [s for s, at in pool if k / parts <= at < (k + 1) / parts and s not in picked][:1]
    picked += [s for s, _ in pool if s not in picked]
    return picked[:n]


def test_key_sentences_equal_plain_rule(spark):
    rng = random.Random(5)
    texts = [random_text(rng, rng.randint(150, 900), 0.1) for _ in range(15)] + ["The key result shows growth. " * 60, "no marks " * 200]
    df = docs_of(spark, texts)
    got = {r["doc_id"]: r["key_sentences"] for r in rows(enrich.key_sentences(df, 4))}
    assert got == {i: plain_key_sentences(t, 4) for i, t in enumerate(texts)}
    long = df.filter(F.length("text") > 1000)
    got = {r["doc_id"]: r["key_sentences"] for r in rows(enrich.key_sentences_chunked(long, 4))}
    assert got == {i: plain_chunked(t, 4) for i, t in enumerate(texts) if len(t) > 1000}


def test_structured_metadata_on_english(spark):
    text = (
        "Dr. Alice Walker said the launch on March 3, 2024 was fine. Acme Widgets Inc. deployed Python and Kubernetes in Berlin. "
        "We served 1,200 users at 10:30 AM. Next week Q3 2024 starts. It uses camelCase and snake_case."
    )
    r = rows(enrich.structured_metadata(docs_of(spark, [text])))[0]
    assert "Alice Walker" in r["persons"] and "Acme Widgets" in r["organizations"] and "Berlin" in r["locations"]
    assert r["technologies"][:2] == ["Python", "Kubernetes"] and "camelCase" in r["technologies"]
    assert "March 3, 2024" in r["dates"] and "1,200 users" in r["quantities"] and "deployed" in r["activities"]
    assert any(x.startswith("10:30") for x in r["times"]) and "Next week" in r["temporal_refs"]


@pytest.mark.parametrize("text, kind", [
    ("def f():\n    return {}", "code"),
    ("Meeting agenda. Present: all", "meeting_notes"),
    ("Dear Bob, write to a@b.example regards", "email"),
    ("# Overview of usage", "documentation"),
    ("Summary of findings, see table 3", "report"),
    ("The system shall do FR-12", "general"),  # upper-case marks never occur in lowercased text: kept as is
    ("ERROR [main.loop] failed", "log"),
    ("just words", "general"),
])
def test_document_type(spark, text, kind):
    df = enrich.lowered(docs_of(spark, [text]))
    assert rows(df.select(enrich.document_type(F.col("text"), F.col("_low")).alias("k")))[0]["k"] == kind


def test_document_filters(spark):
    data = [(1, "todo: buy milk", "x", "a.txt"), (2, "project deadline with client", "github", "a.txt"), (3, "# Guide readme", "x", "readme.md"), (4, "plain", "readwise", "b")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, filename string")
    got = {r["doc_id"]: (r["content_type"], r["domain"]) for r in rows(enrich.document_filters(df))}
    assert got == {1: ("list", "personal"), 2: ("code", "work"), 3: ("documentation", "personal"), 4: ("highlight", "personal")}


def test_query_analysis(spark):
    q = spark.createDataFrame([(1, "only Python docs by Jane Doe"), (2, "weather")], "query_id long, text string")
    got = {r["query_id"]: r for r in rows(enrich.analyze_query(q))}
    assert got[1]["technologies"] == ["Python"] and got[1]["persons"] == ["Jane Doe"] and got[1]["doc_type_hint"] == "documentation"
    assert got[1]["filter_confidence"] == 0.9 and got[1]["use_filters"] and got[2]["filter_confidence"] == 0.0


def test_topic_merge_cases(spark):
    schema = "doc_id long, topics array<string>, primary_topic string, confidence double, method string"
    k = spark.createDataFrame([(1, ["a"], "a", 0.7, "k"), (2, ["a", "b"], "a", 0.5, "k"), (3, ["general"], "general", 0.2, "k"), (4, ["a"], "a", 0.5, "k")], schema)
    e = spark.createDataFrame([(1, ["b"], "b", 0.9, "e"), (2, ["b"], "b", 0.8, "e"), (3, ["c"], "c", 0.6, "e"), (4, ["b"], "b", 0.3, "e")], schema)
    got = {r["doc_id"]: (r["primary_topic"], r["confidence"]) for r in rows(enrich.merge_topics(k, e))}
    assert got == {1: ("a", 0.7), 2: ("b", 0.62), 3: ("c", 0.6), 4: ("a", 0.5)}


# --- personal data ----------------------------------------------------------------------------------------------
PII_TEXT = "Mail jo.doe@mail.example.org or call 555-123-4567; card 4111 1111 1111 1111, ssn 123-45-6789, mail JO.DOE@mail.example.org"


def test_anonymize_round_trip(spark):
    df = docs_of(spark, [PII_TEXT, "nothing here"])
    out = pii.anonymize(pii.detect_pii(df), "secret", F.lit("s1"))
    first = rows(out.orderBy("doc_id"))[0]
    for value in ("jo.doe@", "555-123-4567", "4111", "123-45-6789"):
        assert value not in first["anonymized"]
    assert first["token_count"] == 5
    dictionary = pii.build_token_dictionary(out, "secret", F.lit("s1"))
    assert dictionary.count() == 4  # one token for both spellings of the address
    texts = out.select(F.col("doc_id").alias("row_id"), F.lit("s1").alias("session_id"), F.col("anonymized").alias("text"))
    back = rows(pii.deanonymize(texts, dictionary).orderBy("row_id"))
    assert back[0]["restored"].lower() == PII_TEXT.lower() and back[1]["restored"] == "nothing here"
    assert [b["unknown_tokens"] for b in back] == [0, 0]


def test_critical_types_never_exposed_and_fail_closed(spark):
    found = pii.detect_pii(docs_of(spark, [PII_TEXT]))
    keep = pii.consent_keep(("US_SSN", "EMAIL_ADDRESS"))
    text = rows(pii.anonymize(found, "k", F.lit("s"), keep=keep))[0]["anonymized"]
    assert "jo.doe@mail.example.org" in text and "123-45-6789" not in text
    failed = found.withColumn("failed", F.lit(True))
    assert rows(pii.anonymize(failed, "k", F.lit("s")))[0]["anonymized"] == pii.NOTICE
    assert rows(pii.anonymize(failed, "k", F.lit("s"), on_error="open"))[0]["anonymized"] == PII_TEXT


def test_overlaps_keep_best_span(spark):
    span = lambda a, b, s: ("X", a, b, s, "v")
    df = spark.createDataFrame([([span(0, 5, 0.5), span(3, 9, 0.9), span(8, 12, 0.4), span(20, 22, 0.1)],)], f"spans array<{pii.SPAN}>")
    kept = rows(df.select(pii.resolve_overlaps(F.col("spans")).alias("k")))[0]["k"]
    assert sorted((k["start"], k["end"]) for k in kept) == [(3, 9), (20, 22)]


def test_perturbed_names_and_phones_come_back(spark):
    texts = spark.createDataFrame([(1, "s", "Ask MICHAEL CHEN or Chen, not Chenault, at (555) 987-6543."), (2, "other", "Chen")], "row_id long, session_id string, text string")
    maps = spark.createDataFrame(
        [("s", "PERSON", "Michael Chen", "John Smith"), ("s", "PERSON", "Chen", "Smith"), ("s", "PHONE_NUMBER", "555-987-6543", "555-123-0000")],
        "session_id string, pii_type string, perturbed string, original string",
    )
    got = {r["row_id"]: r["restored"] for r in rows(pii.deanonymize_perturbed(texts, maps))}
    assert got == {1: "Ask John Smith or Smith, not Chenault, at 555-123-0000.", 2: "Chen"}


def test_perturbation_is_repeatable_and_keeps_format(spark):
    df = spark.createDataFrame([("555-123-4567",), ("01/15/2024",), ("2024-01-15 10:30:00",), ("10:30 AM",), ("soon",)], "v string")
    noisy = lambda seed: {r["v"]: r["p"] for r in rows(df.select("v", perturb.perturb_dates(F.col("v"), F.lit(1.0), seed).alias("p")))}
    a = noisy("s1")
    assert a == noisy("s1") and a != noisy("s2")
    assert re.fullmatch(r"\d{3}-\d{3}-\d{4}", a["555-123-4567"]) and re.fullmatch(r"\d\d/\d\d/\d{4}", a["01/15/2024"])
    assert re.fullmatch(r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d", a["2024-01-15 10:30:00"]) and re.fullmatch(r"\d\d:\d\d [AP]M", a["10:30 AM"])
    assert a["soon"] == "soon"


def test_laplace_noise_has_the_right_spread(spark):
    noise = spark.range(20000).select(perturb.laplace(F.lit(2.0), perturb.uniform("k", F.col("id"))).alias("x"))
    r = rows(noise.agg(F.avg("x").alias("m"), F.avg(F.abs("x")).alias("s")))[0]
    assert abs(r["m"]) < 0.1 and abs(r["s"] - 2.0) < 0.1


def test_names_unique_per_session(spark):
    names = spark.createDataFrame([("s", f"First{i} Mid Last{i}") for i in range(6)] + [("t", "Solo")], "session_id string, full_name string")
    firsts, lasts = ["Ann", "Bob", "Cid", "Dee"], ["Oak", "Elm", "Fir", "Ash"]
    out = rows(perturb.perturb_names(names, firsts, lasts, "k"))
    done = [r for r in out if r["session_id"] == "s" and r["perturbed"]]
    assert len(done) == 4 and len({r["perturbed"].split()[0] for r in done}) == 4 and all(" Mid " in r["perturbed"] for r in done)
    assert all(r["part_mappings"] is None for r in out if not r["perturbed"])


def test_email_and_address(spark):
    df = spark.createDataFrame([("jane.roe@corp.example",)], "v string")
    mail = rows(df.select(perturb.perturb_email(F.col("v"), F.lit(1.0), "k", ["Kim", "Lou"]).alias("p")))[0]["p"]
    assert re.fullmatch(r"(kim|lou)\.(kim|lou)@[a-z.]+", mail) and mail.split("@")[1] in fixed.EMAIL_DOMAINS
    df = spark.createDataFrame([("123 N Main St., Springfield, 90210",)], "v string")
    place = rows(df.select(perturb.perturb_address(F.col("v"), F.lit(1.0), "k", ["Oak", "Elm"]).alias("p")))[0]["p"]
    assert re.fullmatch(r"\d{3} N (Oak|Elm) St\., (Oak|Elm), \d{5}", place)


def test_spans_boxes_digits(spark):
    df = docs_of(spark, ["call 555 123 4567 now", "1 2 3", "card 4111 1111 1111 1111"])
    got = [r["t"] for r in rows(df.orderBy("doc_id").select(spans.normalize_digit_groups(F.col("text")).alias("t")))]
    assert got == ["call 5551234567 now", "1 2 3", "card 4111111111111111"]
    box = spark.createDataFrame([("0123456789", 100, 5, 200, 12, 2, 4)], "text string, x int, y int, width int, height int, start int, end int")
    assert rows(spans.spans_to_boxes(box, True))[0]["box_width"] == 200
    part = rows(spans.spans_to_boxes(box))[0]
    assert (part["box_x"], part["box_width"]) == (134, 52)


def test_span_without_word_gets_the_whole_recording(spark):
    s = spark.createDataFrame([(1, 0, 50, 60)], "doc_id long, span_id long, start long, end long")
    w = spark.createDataFrame([(1, 0, 4, 0.0, 0.4), (1, 5, 9, 0.4, 0.8)], "doc_id long, char_start long, char_end long, time_start double, time_end double")
    assert (rows(spans.spans_to_time(s, w))[0]["start_time"], rows(spans.spans_to_time(s, w))[0]["end_time"]) == (0.0, 0.8)


# --- consent, memory, reasoning ------------------------------------------------------------------------------
def test_consent_categories_and_time(spark):
    df = spark.createDataFrame([(1, ["Gym plan"]), (2, ["code"]), (3, []), (4, ["code", "tax help"])], "doc_id long, topics array<string>")
    got = {r["doc_id"]: r["c"] for r in rows(df.select("doc_id", consent.categories(F.col("topics")).alias("c")))}
    assert got == {1: ["health"], 2: ["programming"], 3: ["general"], 4: ["finance", "programming"]}
    rules = consent.preset_rules("balanced")
    kept = {r["doc_id"] for r in rows(consent.consent_category(df, rules["allowed"], rules["blocked"]))}
    assert kept == {2, 3}


def test_memory_only_expired_versions_and_default_key(spark):
    w = spark.createDataFrame(
        [(1, "Claim", "accepted", " water  boils ", "w", "me", None, 1, None, "r", "2026-01-01 00:00:00"),
         (2, "claim", "accepted", "water  boils", "w", "me", None, None, None, "r", "2026-01-02 00:00:00"),
         (3, "rumour", "accepted", "x", "w", "me", None, None, None, "r", "2026-01-02 00:00:00")],
        "seq long, kind string, state string, content string, workspace string, actor string, memory_key string, ttl_days int, source_document_id long, reason string, created_at string",
    ).withColumn("created_at", F.to_timestamp("created_at"))
    none = spark.createDataFrame([], "workspace string, memory_key string, version long")
    out = rows(memory.build_memories(w, none).orderBy("seq"))
    assert [r["version"] for r in out] == [1, 2] and out[0]["memory_key"] == out[1]["memory_key"] and out[0]["value_hash"] == out[1]["value_hash"]
    expired = spark.createDataFrame([(1, "w", "k", 1, "accepted", "2026-01-01", "2026-02-01", "c")], "doc_id long, workspace string, memory_key string, version long, state string, created_at string, expires_at string, content string")
    expired = expired.withColumn("created_at", F.to_timestamp("created_at")).withColumn("expires_at", F.to_timestamp("expires_at"))
    assert rows(memory.memory_current(expired, "2026-06-01"))[0]["version"] == 1
    lost = spark.createDataFrame([("w", "missing")], "workspace string, memory_key string")
    assert rows(memory.memory_timeline(expired, "2026-06-01", lost))[0]["reason_code"] == "memory_key_not_found"


def test_contradiction_and_gaps(spark):
    q = spark.createDataFrame([(1, "rollout feature flag"), (2, "unknown thing")], "query_id long, text string")
    res = spark.createDataFrame(
        [(1, 10, 0.9, "A", "The feature flag is enabled for rollout.", "2026-05-01"), (1, 11, 0.8, "B", "The feature flag is blocked.", None)],
        "query_id long, doc_id long, score double, title string, text string, date string",
    )
    parts = reasoning.think(q, res, "2026-06-01")
    c = rows(parts["contradictions"])
    assert [(x["left_doc_id"], x["right_doc_id"], x["topic"]) for x in c] == [(10, 11, "feature flag")]
    gaps = {r["query_id"]: r["gaps"] for r in rows(parts["gaps"])}
    assert gaps == {1: [], 2: ["No supporting sources were found."]}
    assert {r["type"] for r in rows(parts["actions"]) if r["query_id"] == 1} == {"add_source_date", "resolve_contradiction"}


def test_replacements_in_blocks_equal_brute_force(spark):
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(60)]
    data = [(i, f"Doc {i}", " ".join(rng.sample(vocab, 8)), ["tag"], f"2026-{rng.randint(1, 5):02}-{rng.randint(1, 28):02}") for i in range(80)]
    df = spark.createDataFrame(data, "doc_id long, title string, text string, topics array<string>, doc_date string")
    from datetime import date

    day = {d[0]: date.fromisoformat(d[4]) for d in data}
    terms = {d[0]: {w for w in re.findall("[a-z0-9]+", f"{d[1]} {d[2]} tag".lower()) if len(w) >= 3} for d in data}
    old = {i for i in day if (date(2026, 6, 1) - day[i]).days > 90}
    want = {}
    for s in old:
        best = max(((len(terms[s] & terms[f]), -f) for f in day if f not in old and day[f] > day[s]), default=(0, 0))
        if best[0]:
            want[s] = (-best[1], best[0])
    for block in (2000, 7):
        got = {r["replaces_doc_id"]: (r["candidate_doc_id"], r["overlap"]) for r in rows(upkeep.replacement_candidates(df, "2026-06-01", block=block))}
        assert got == want


def test_health_rounds_halves_to_even(spark):
    s = spark.createDataFrame([(14, 1, 1, 1, 0, 0)], "document_count long, stale_source_count long, undated_source_count long, duplicate_group_count long, entity_consolidation_count long, replacement_candidate_count long")
    r = rows(upkeep.health_score(s))[0]
    assert (r["stale_penalty"], r["undated_penalty"], r["health_score"], r["status"]) == (2, 1, 87, "good")


def test_unparsable_dates_are_neither_stale_nor_undated(spark):
    df = spark.createDataFrame([(1, "someday"), (2, None), (3, "2020-01-01")], "doc_id long, doc_date string")
    assert [r["doc_id"] for r in rows(upkeep.stale_sources(df, "2026-06-01"))] == [3]
    assert [r["doc_id"] for r in rows(upkeep.undated_sources(df))] == [2]


# --- sources and streams -------------------------------------------------------------------------------------
def test_folder_scan(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".hidden").mkdir()
    (tmp_path / "a.txt").write_text(" hello \n")
    (tmp_path / "sub" / "b.md").write_text("# two")
    (tmp_path / "c.txt").write_text("   ")
    (tmp_path / "d.bin").write_text("no")
    (tmp_path / ".hidden" / "e.txt").write_text("no")
    docs, bad = files.scan_text_corpus(spark, str(tmp_path), metadata={"source": "x"})
    got = {r["relative_path"]: (r["text"], r["extension"], r["source"]) for r in rows(docs)}
    assert got == {"a.txt": ("hello", "txt", "x"), "sub/b.md": ("# two", "md", "x")}
    assert bad.count() == 1


def test_mojibake_and_nested_texts(spark):
    df = docs_of(spark, ["caf\\u00e9 \\u00Bb ok"])
    assert rows(df.select(exports.fix_mojibake(F.col("text")).alias("t")))[0]["t"] == "café » ok"
    data = '{"name":"long name","data":[{"value":"abc"},{"text":"deep text","title":"top title"},["plain item"]]}'
    got = rows(docs_of(spark, [data]).select(exports.nested_texts(F.col("text")).alias("t")))[0]["t"]
    assert got == ["long name", "top title", "deep text", "plain item"]


def test_sync_cursor_moves_to_the_start_of_a_run(spark):
    df = spark.createDataFrame([(1, "2026-01-01"), (2, "2026-01-03")], "id long, d string").withColumn("last_edited", F.to_timestamp("d"))
    fresh, cursor = sync.incremental_sync(df, "2026-01-02", "2026-01-05")
    assert [r["id"] for r in rows(fresh)] == [2] and cursor == "2026-01-05"
    assert sync.incremental_sync(df, "2026-01-02", "2026-01-05", failed=True)[1] == "2026-01-02"


def test_capture_stream_appends_and_replaces(spark):
    path, inbox, check = (scratch_path(spark, n) for n in ("cap", "in", "ck"))
    schema = "conv_id long, seq long, role string, text string, full boolean"

    def arrive(data):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(inbox)
        jobs.stream_capture(spark.readStream.schema(schema).parquet(inbox), path, check)
        return sorted((r["conv_id"], r["text"]) for r in rows(jobs.captured_messages(spark.read.parquet(f"{path}/messages"))))

    assert arrive([(1, 0, "user", "hi", False), (1, 1, "user", "hi", False), (2, 0, "user", "yo", False)]) == [(1, "hi"), (2, "yo")]
    assert arrive([(1, 2, "user", "hi", False), (1, 3, "bot", "hey", False)]) == [(1, "hey"), (1, "hi"), (2, "yo")]
    assert arrive([(1, 0, "user", "new", True)]) == [(1, "new"), (2, "yo")]
    assert arrive([(1, 1, "bot", "more", False)]) == [(1, "more"), (1, "new"), (2, "yo")]
    events = {(r["batch"], r["conv_id"]): (r["new_messages"], r["event"]) for r in rows(spark.read.parquet(f"{path}/events"))}
    assert events[(0, 1)] == (1, "new_message") and events[(1, 1)] == (1, "conversation_updated") and events[(2, 1)] == (-1, "conversation_updated")


def test_ingest_stream_is_idempotent(spark):
    path, inbox, check = (scratch_path(spark, n) for n in ("ing", "in", "ck"))
    schema = "doc_id long, seq long, text string, source string"
    for data in ([(1, 1, "a", "s"), (2, 2, "a", "s")], [(3, 3, "a", "s"), (4, 4, "b", "s")]):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(inbox)
        jobs.stream_ingest(spark.readStream.schema(schema).parquet(inbox), path, check)
    assert sorted(r["doc_id"] for r in rows(spark.read.parquet(path))) == [1, 4]
    again = spark.createDataFrame([(3, 3, "a", "s"), (4, 4, "b", "s")], schema)
    sinks.write_documents(again, path, 1)
    assert sorted(r["doc_id"] for r in rows(spark.read.parquet(path))) == [1, 4]


def test_late_rows_are_dropped_by_the_watermark(spark):
    inbox, path, check = (scratch_path(spark, n) for n in ("late", "out", "ck"))
    schema = "ts timestamp, actor string, kind string"
    from datetime import datetime

    for day in ("2026-01-10 00:00:00", "2026-01-12 00:00:00", "2026-01-01 00:00:00"):
        row = spark.createDataFrame([(datetime.fromisoformat(day), "u", "k")], schema)
        row.coalesce(1).write.mode("append").parquet(inbox)
        jobs.stream_activity(spark.readStream.schema(schema).parquet(inbox), path, check, late="1 hour")
    assert sorted(str(r["window_start"])[:10] for r in rows(jobs.latest_counts(spark, path))) == ["2026-01-10", "2026-01-12"]


def test_quality_measures(spark):
    ranked = spark.createDataFrame([(1, d, d) for d in (1, 2, 3)], "query_id long, doc_id long, rank int")
    rel = spark.createDataFrame([(1,), (3,)], "doc_id long")
    assert rows(quality.rank_quality(ranked, rel))[0]["quality"] == round((1 + 1 / 3) / (1 + 1 / 2 + 1 / 3), 3)


def test_long_conversation_comes_in_parts(spark):
    msgs = spark.range(25).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("m"), "id").alias("text"))
    heads = spark.createDataFrame([(1, "T", "S", "u", "now")], "conv_id int, title string, site_name string, url string, captured string")
    parts = rows(aggregates.conversation_documents(msgs, heads, 10).orderBy("part"))
    assert [p["message_count"] for p in parts] == [10, 10, 5] and parts[0]["text"].startswith("# T") and "m24" in parts[2]["text"]


def test_context_metadata_swaps_only_with_pii(spark):
    bag = lambda pii_flag: F.create_map(F.lit("has_pii"), F.lit(pii_flag), F.lit("image_path"), F.lit("raw"), F.lit("redacted_image_path"), F.lit("red"),
                                        F.lit("original_image_path"), F.lit("raw"), F.lit("original_transcript"), F.lit("secret"))
    r = rows(spark.range(1).select(listing.context_metadata(bag("true")).alias("a"), listing.context_metadata(bag("false")).alias("b"), listing.context_metadata(bag("true"), "user").alias("c")))[0]
    assert r["a"]["image_path"] == "red" and "original_transcript" not in r["a"] and "original_image_path" not in r["a"]
    assert r["b"]["original_transcript"] == "secret" and r["c"]["image_path"] == "raw"


def test_merge_metadata_applies_updates_in_order(spark):
    from mnemolake.operators.identity import merge_metadata

    docs = spark.createDataFrame([(1, "old", {"a": "0"}), (2, "x", None)], "doc_id int, text string, metadata map<string,string>")
    changes = spark.createDataFrame(
        [(1, 2, None, {"a": "2"}), (1, 1, "one", {"a": "1", "b": "1"})], "doc_id int, seq int, text string, metadata map<string,string>"
    )
    rows = {r.doc_id: r for r in merge_metadata(docs, changes, "now").collect()}
    assert len(rows) == 2
    assert (rows[1].text, rows[1].metadata) == ("one", {"a": "2", "b": "1", "updated_at": "now"})
    assert (rows[2].text, rows[2].metadata) == ("x", None)


def test_sanitize_json_at_any_depth(spark):
    from mnemolake.operators.listing import sanitize_json

    texts = [
        '{"persons": {"a": {"b": "Ann Lee"}}, "k": 1}', '{"k": [{"persons": [["Ann"]]}, 2]}', '{"k": 1}', '{"persons": {', None,
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in rows.orderBy("i").select(sanitize_json(rows.t)).collect()]
    assert got == ['{"k": 1}', '{"k": [{}, 2]}', '{"k": 1}', None, None]


def test_capture_after_a_full_one(spark, tmp_path):
    from mnemolake.streaming.jobs import capture_batch, captured_messages, read_store

    rows = [(7, 1, "user", "gone", True), (7, 2, "user", "before", False), (7, 3, "user", "a", True), (7, 4, "bot", "b", True),
            (7, 5, "user", "later", False), (7, 6, "user", "a", False), (8, 1, "user", "plain", False)]
    capture_batch(spark.createDataFrame(rows, "conv_id long, seq int, role string, text string, full boolean"), str(tmp_path), 0)
    kept = captured_messages(read_store(spark, f"{tmp_path}/messages")).collect()
    assert sorted((r.conv_id, r.text) for r in kept) == [(7, "a"), (7, "b"), (7, "later"), (8, "plain")]


def test_long_lists_are_whole(spark):
    import json

    from mnemolake.sources.exports import extract_json_text, nested_texts

    raw = json.dumps([f"item number {i}" for i in range(150)])
    rows = spark.createDataFrame([(1, raw)], "file_id int, raw string")
    assert len(rows.select(nested_texts(rows.raw)).first()[0]) == 150
    assert len(extract_json_text(rows).first().text.split("\n")) == 150
