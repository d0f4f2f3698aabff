"""Nulls, empty texts and tables, ties, repeated rows and extra columns with clashing names."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from mnemolake.llm import chunk_bpe, digest_index, feistel_shards, fingerprints, html_main_text, language_id, packing, personal_data

ROWS = [(1, "Same  text", "a"), (1, "Same  text", "a"), (2, "Same text", "b"), (3, None, None), (4, "", "c"), (None, "only here a@b.org", "d"), (5, "12 34", "e")]
SCHEMA = "doc_id long, text string, digest string"


@pytest.fixture(scope="module", params=["rows", "empty"])
def docs(request, spark):
    return spark.createDataFrame(ROWS if request.param == "rows" else [], SCHEMA)


def test_exact(spark, docs, tmp_path):
    n = docs.count()
    kept = digest_index.keep_first(docs, digest_index.DigestIndex(spark, str(tmp_path / "a")))
    assert kept.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == (["1", "3", "5", "None"] if n else [])
    again = digest_index.deduplicate(docs, digest_index.DigestIndex(spark, str(tmp_path / "b")))
    assert again.count() == n and again.filter("kept").count() == (4 if n else 0)


def test_rowwise(spark, docs):
    n = docs.count()
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert chunk_bpe.decode_documents(chunk_bpe.encode_documents(docs, path), path).filter("decoded = coalesce(text, '')").count() == n
    assert personal_data.find_spans(docs).filter("size(base) = 1").count() == (1 if n else 0)
    assert personal_data.redact(docs).filter("text like '%[EMAIL]%'").count() == (1 if n else 0)
    judged = language_id.identify(docs, language_id.learn(docs.withColumn("lang", F.lit("en"))))
    assert judged.filter("lang_pred = 'und'").count() == (3 if n else 0) and judged.count() == n
    texts = html_main_text.extract(docs.withColumnRenamed("text", "html"), html_main_text.Weights())
    assert texts.filter("text is null").count() == 0 and texts.count() == n


def test_dealt(spark, docs):
    n = docs.count()
    rows = feistel_shards.shard_rows(docs.select("doc_id", "text"), ["doc_id", "text"], 3).collect()
    assert len({(r.shard, r.slot) for r in rows}) == n
    packed = packing.pack(packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))
    assert packed.count() == n
    marked = docs.withColumn("fp", fingerprints.fingerprint(F.col("text")))
    assert fingerprints.with_next(marked, "doc_id", ["text", "fp"]).count() == n
