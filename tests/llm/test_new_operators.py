"""Importance resampling, repeated passages and whitening against plain Python, on hard rows and on the smallest tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from mnemolake.llm import embedding_whitening, importance_resampling, repeated_passages

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- resampling --------------------------------------------------------------------------------------
def plain_features(text, max_n, buckets):
    words = WORD.findall((text or "").translate(LOWER))
    return [
        zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, max_n + 1) for i in range(len(words) - n + 1)
    ]


def plain_resample(docs, target, max_n=1, buckets=10_000, min_words=20, percent=10):
    bags = [plain_features(t, max_n, buckets) for _, t in docs]
    s, t = Counter(b for bag in bags for b in bag), Counter(b for text in target for b in plain_features(text, max_n, buckets))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    rows = []
    for (doc_id, text), bag in zip(docs, bags):
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, bag))
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc_id, len(WORD.findall((text or "").translate(LOWER))), len(bag), weight, score))
    able = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    drawn = able[: percent * len(able) // 100]
    return sorted((str(r), drawn.index(r) + 1 if r in drawn else None) for r in rows)


def got_resample(df):
    return sorted((str((r[0], r.n_words, r.n_features, r.weight, r.score)), r.rank) for r in df.collect())


HARD = [
    (5, "Alpha beta GAMMA, delta; alpha_beta 42 naïve Ärger straße 東京"), (2, None), (3, ""), (4, "-- !!"), (9, "one\ntwo\x00three`four"),
    (None, "alpha beta gamma"), (7, "alpha"), (8, "beta gamma alpha " * 40_000),
]


@pytest.mark.parametrize("max_n", [1, 3])
def test_resample_hard_rows(spark, max_n):
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in HARD], "doc_id long, text string, rank int, score string")
    target = spark.createDataFrame([("gamma alpha beta",), (None,), ("",)], "text string")
    out = importance_resampling.resample(docs, target, max_n, 97, 3, 50)
    assert got_resample(out) == plain_resample(HARD, ["gamma alpha beta", None, ""], max_n, 97, 3, 50)
    assert out.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]


def test_resample_ties_repeats_and_nothing(spark):
    rows = [(1, "a b c")] * 6 + [(2, "a b c")] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    empty = docs.limit(0)
    out = importance_resampling.resample(docs, empty, 1, 10, 1, 70).collect()
    assert len(out) == 10 and sorted(r.rank for r in out if r.rank) == list(range(1, 8))
    assert len({r.weight for r in out}) == 1
    assert importance_resampling.resample(empty, docs).count() == 0


def test_resample_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = plain_resample(docs, target)
    rows = importance_resampling.op11(spark, SF).collect()
    assert sorted((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in rows) == sorted(
        (*[int(x) for x in np.array(eval(text))[[0, 2, 3, 4]]], rank) for text, rank in want
    )


def test_slices_do_not_change_features(monkeypatch):
    texts = [t or "" for _, t in HARD[:-1]]
    want = [sorted(plain_features(t, 2, 1000)) for t in texts]
    for size in (1, 20, 1 << 20):
        monkeypatch.setattr(importance_resampling, "SLICE_BYTES", size)
        raw = [t.encode() for t in texts]
        got = []
        for start, end in importance_resampling._slices(raw):
            _, doc, found = importance_resampling.features(raw[start:end], 2, 1000)
            got += [sorted(found[doc == i].tolist()) for i in range(end - start)]
        assert got == want


# --- repeated passages ----------------------------------------------------------------------------------
def plain_removed(docs, window):
    """(id, number of words, removed positions) by the definition."""
    first = {}
    place = lambda i: float("inf") if i is None else i
    split = [(i, repeated_passages.words_of(t)) for i, t in docs]
    for i, w in split:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, place(i)), place(i))
    out = []
    for i, w in split:
        gone = {k + j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < place(i) for j in range(window)}
        out.append((i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return sorted(map(str, out))


def got_removed(df):
    return sorted(str(tuple(r)) for r in df.collect())


def passage(seed, n, vocabulary=500):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def hard_documents():
    p, q, long_text = passage(1, 60), passage(2, 50), passage(3, 6_000)
    docs = [
        (10, passage(10, 80) + " " + p + " " + passage(11, 30)), (3, p), (4, p.upper()), (7, p + "\n" + q + "\t" + p), (8, " ".join(q.split()[:49])),
        (9, q), (2, q + " end"), (20, long_text), (21, passage(12, 10) + " " + long_text + " tail"), (22, long_text), (None, long_text), (None, p),
        (30, None), (31, ""), (32, " \n\t "), (33, "same " * 200), (34, "same " * 70), (33, "same " * 200), (35, p + " " + p),
    ]
    copies = passage(4, 120).split()
    for i in range(40):  # near copies: one word changed, some of them alike
        words = list(copies)
        words[i * 7 % 120] = f"edit{i % 3}"
        docs.append((100 + i, " ".join(words)))
    return docs


@pytest.mark.parametrize("small", [False, True])
def test_removed_passages(spark, small, monkeypatch):
    if small:  # many shards, hot homes split, several copies of one automaton
        monkeypatch.setattr(repeated_passages, "SHARD_WORDS", 100)
        monkeypatch.setattr(repeated_passages, "PART_WORDS", 500)
    docs = hard_documents()
    table = spark.createDataFrame([(i, t, "x", 1, None) for i, t in docs], "doc_id long, text string, node string, place int, shared string")
    out = repeated_passages.remove_repeats(table)
    assert out.columns == ["doc_id", "n_words", "n_removed", "kept"]
    assert got_removed(out) == plain_removed(docs, 50)


@pytest.mark.parametrize("window", [5, 23])
def test_other_windows(spark, window):
    docs = [(i, passage(i % 7, 30 + i, 4)) for i in range(60)]
    out = repeated_passages.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), window)
    assert got_removed(out) == plain_removed(docs, window)


def test_no_documents(spark):
    assert repeated_passages.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=14), min_size=1, max_size=5), st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), max_size=25))
def test_automaton(passages, words):
    window = 4
    automaton = repeated_passages.Automaton()
    for p in passages:
        automaton.add(p, 0)
    held = {tuple(p[i : i + window]) for p in passages for i in range(len(p) - window + 1)}
    want = {k + j for k in range(len(words) - window + 1) if tuple(words[k : k + window]) in held for j in range(window)}
    spans = automaton.spans(words, 1, window)
    assert {i for a, b in spans for i in range(a, b)} == want
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:])) and automaton.spans(words, 0, window) == []


def test_removed_from_the_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got_removed(repeated_passages.remove_repeats(spark.read.parquet(f"{SF}/documents.parquet"))) == plain_removed(docs, 50)


# --- whitening ------------------------------------------------------------------------------------------
def check_whitening(rows, out, components=8):
    fit = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in fit], dtype=object)
    n, total = len(x), x.sum(axis=0)
    apart = n * x - total
    y = (apart / n).astype(float)
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    kept = min(components, int((e > 1e-12 * np.trace(v)).sum()))
    assert len(out) == n * kept
    z = y @ u[:, :kept] / np.sqrt(e[:kept])
    for c in range(kept):
        mine = [r for r in out if r.component == c + 1]
        assert {r.n for r in mine} == {n} and all(abs(r.explained - e[c] / np.trace(v)) < 1e-9 for r in mine)
        got = sorted((str(r[0]), r.deviation, r.whitened) for r in mine)
        want = sorted((str(i), int((a * a).sum()), w) for (i, _), a, w in zip(fit, apart, z[:, c]))
        flipped = sorted((i, d, -w) for i, d, w in want)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert min(max(abs(g[2] - w[2]) for g, w in zip(got, side)) for side in (want, flipped)) < 1e-8
    assert all(r.identity_error < 1e-4 for r in out) and len({r.identity_error for r in out}) <= 1


def test_whitening_of_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitening(rows, embedding_whitening.op13(spark, SF).collect())


def test_whitening_hard_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=5) * [3, 1, 0.5, 2, 0]]) for i in range(1500)]
    rows += [(1, None), (2, []), (3, [1.0, None, 1.0, 1.0, 1.0]), (4, [float("nan")] * 5), (5, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (6, [-float("inf")] * 5)]
    rows += [(None, [1.5, 2.0, 0.25, 3.0, 0.0])] * 2 + [(7, rows[7][1])]
    table = spark.createDataFrame([(i, v, 0, "x", 1.0) for i, v in rows], "vec_id long, embedding array<float>, n int, x string, at double")
    check_whitening(rows, embedding_whitening.whiten(table).collect())
    assert {r.component for r in embedding_whitening.whiten(table).collect()} == {1, 2, 3, 4}  # the last dimension is constant


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]])
def test_whitening_without_variance(spark, rows):
    out = embedding_whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert out.columns[0] == "vec_id" and out.count() == 0


def test_whitening_of_different_lengths(spark):
    with pytest.raises(ValueError):
        embedding_whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "vec_id long, embedding array<float>"))
