"""The operators against plain Python over the whole smallest tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from mnemolake.llm import chunk_bpe, feistel_shards, fingerprints, html_main_text, language_id, packing, personal_data, url_filter

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_chunk_bpe_is_the_library(spark, docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = chunk_bpe.op3(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(",".join(map(str, ids))))
        assert r.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))


def base_spans(text):
    """The stated patterns, read literally."""
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((0, m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            found.append((1, m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        doubled = [x * 2 - 9 if x > 4 else x * 2 for x in d[-2::-2]]
        if 13 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(doubled)) % 10 == 0:
            found.append((2, m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            found.append((3, m.start(), m.end()))
    return sorted(found)


def spelled(spans):
    return ",".join(f"{personal_data.KINDS[k]}:{a}:{b}" for k, a, b in spans)


def test_base_spans_are_the_stated_ones(spark, docs):
    rows = personal_data.op5(spark, SF).collect()
    assert len(rows) == len(docs)
    some = 0
    for r in rows:
        want = base_spans(docs[r.doc_id])
        some += len(want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, _, _ in want) for i in range(4)]
        assert r.base_sha256 == sha(spelled(want))
        assert set(spelled(want).split(",")) <= set(r.spans.split(","))
    assert some


def test_shards(spark, docs):
    rows = feistel_shards.op8(spark, SF).collect()
    n = len(docs)
    assert len(rows) == n and sorted(r.doc_id for r in rows) == sorted(docs)
    slots = defaultdict(list)
    for r in rows:
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(24)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # the same again by hand: number rows by id, permute, deal
    for number, doc_id in enumerate(sorted(docs)):
        row = next(r for r in rows if r.doc_id == doc_id)
        assert row.shard + 24 * row.slot == permuted(number, n, 20240229)


def permuted(number, n, seed):
    a = next(a for a in range(1, n + 2) if a * a >= n)
    b = -(-n // a)
    p = feistel_shards.PRIME
    f = lambda v, k: (((v + k[0]) % p) ** 2 % p * ((v + k[0]) % p) + k[1]) % p
    while True:
        x, y = divmod(number, b)
        for i, key in enumerate(feistel_shards.round_keys(seed)):
            x, y = ((x + f(y, key)) % a, y) if i % 2 == 0 else (x, (y + f(x, key)) % b)
        number = x * b + y
        if number < n:
            return number


def test_packing(spark, docs):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.op10(spark, SF).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(docs)
    total = 0
    for doc_id, mine in pieces.items():
        ids = library.encode(docs[doc_id], add_special_tokens=False).ids + [1]
        total += len(ids)
        want = [ids[i : i + 4096] for i in range(0, len(ids), 4096)]
        mine.sort(key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in mine] == [(i, 4096 * i, len(p)) for i, p in enumerate(want)]
        assert [r.ids_crc32 for r in mine] == [zlib.crc32(np.array(p, "<u4").tobytes()) for p in want]
    for places in sequences.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))]
        assert sum(n for _, n in places) <= 4096
    assert len(sequences) <= -(-total // 4096) + 2


def test_fingerprints(spark, docs):
    rows = {r.doc_id: r for r in fingerprints.op6(spark, SF).collect()}
    assert set(rows) == set(docs)
    ids = sorted(docs, reverse=True)
    by_text = defaultdict(set)
    errors = []
    for doc_id, after in zip(ids, [*ids[1:], ids[0]]):
        r, text, other = rows[doc_id], docs[doc_id], docs[after]
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), sha(edited))
        by_text[text].add(r.fingerprint)
        sets = [words_of(t) for t in (text, edited, other)]
        for near, b in ((r.near_edited, sets[1]), (r.near_next, sets[2])):
            errors.append(near - len(sets[0] & b) / max(1, len(sets[0] | b)))
    assert all(len(f) == 1 for f in by_text.values())
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08


def words_of(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} - {()}


def test_language_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = language_id.op2(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_main_text_is_the_article(spark):
    import html

    for r, page in zip(
        html_main_text.op4(spark, SF).orderBy("page_id").collect(), spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").collect()
    ):
        article = page.html.split("<article>")[1].split("</article>")[0]
        blocks = re.split(r"</?(?:p|h1|br)>", re.sub(r"</?b>", "", article))
        lines = [" ".join(html.unescape(b).split()) for b in blocks]
        assert r.text == "\n".join(x for x in lines if x)
        assert r.n_chars == len(r.text)


def test_pipeline(spark, docs):
    """Stage by stage: nothing clean is lost, nothing doubled stays, and every piece holds the redacted text."""
    rows = corpus_pipeline.run(spark, SF).collect()
    kept = {r.doc_id for r in rows}
    first = {}
    for doc_id in sorted(docs):
        if any(c.isalpha() for c in docs[doc_id]):
            first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", docs[doc_id]), doc_id)
    exact = sorted(first.values())
    sets = {d: {" ".join(s) for s in shingled(docs[d])} for d in exact}
    root = {d: d for d in exact}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, a in enumerate(exact):
        for b in exact[:i]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    assert kept == {d for d in exact if top(d) == d}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    whole = Counter()
    for r in rows:
        whole[r.doc_id] += r.length
    for doc_id in kept:
        if "[" not in docs[doc_id] and not base_spans(docs[doc_id]):
            assert whole[doc_id] == len(library.encode(docs[doc_id], add_special_tokens=False).ids) + 1


def shingled(text):
    w = text.encode().lower().split()
    w = [x.decode() for x in w]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_url_rules_by_hand(spark):
    urls = [
        "http://a.org/x", "http://a.org", "http://example.org/es/1", "http://m.EXAMPLE.org/en/12?x", "http://example.org/en/2", "http://x.com/fr/",
        "http://x.com/de/9#a", "http://x.com/it", "http://notexample.org/es/1", None, "no url", "http://", "a://b.com/de/://c.com/fr/",
    ]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id int, url string")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    got = [(r.rule, r.verdict) for r in url_filter.judge(rows, rules).orderBy("page_id").collect()]
    assert got == [
        ("org/", "allow"), (None, "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("org/", "allow"), ("com/fr/", "allow"),
        ("com/de/", "block"), (None, "allow"), ("org/", "allow"), (None, "allow"), (None, "allow"), (None, "allow"), ("com/de/", "block"),
    ]
