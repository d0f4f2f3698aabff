"""The context of a question holds the whole text of every hit."""

from mnemolake.plans import all_queries

SF = "/root/testdata/sf0.001"


def test_context_holds_whole_texts(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = all_queries()["rag_context"](spark, SF).collect()
    long = [r for r in rows if len(texts[r.doc_id]) > 1000]
    assert long
    for r in long:
        assert len(r.context.split()) > 0.8 * len(texts[r.doc_id].split())  # values of several words become one token
    for r in rows:
        if r.token_count == 0:
            assert r.context == texts[r.doc_id]
