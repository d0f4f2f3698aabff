"""Near copies among null, repeated and shared ids, and the stages of the pipeline on such rows."""

import pytest

import corpus_pipeline
from mnemolake.llm import minhash_dedup

A = " ".join(f"river{i}" for i in range(60))
B = " ".join(f"mountain{i}" for i in range(60))
C = " ".join(f"harbour{i}" for i in range(60))
D = " ".join(f"meadow{i}" for i in range(60))
ROWS = [
    (1, A, "original"), (None, A + " end", "near copy without id"), (None, B, "clean without id"),
    (2, C, "clean"), (2, A + " more", "near copy that shares its id"),
    (None, D, "original without id"), (None, D + " end", "near copy of it"),
    (3, None, "null text"), (4, "", "empty text"), (None, None, "all null"), (None, " ", "blank without id"),
]
STAY = {"original", "clean without id", "clean", "null text", "empty text", "all null", "blank without id"}
SCHEMA = "doc_id long, text string, note string"


def check(notes):
    assert len(notes) == len(set(notes))
    assert {n for n in notes if n not in ("original without id", "near copy of it")} == STAY
    assert len({"original without id", "near copy of it"} & set(notes)) == 1


def test_keep_one(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    out = minhash_dedup.keep_one(docs)
    assert out.columns == docs.columns
    check([r.note for r in out.collect()])


def test_repeated_rows_leave_one(spark):
    docs = spark.createDataFrame([(1, A, "x"), (1, A, "x"), (5, A + " end", "y"), (None, B, "z"), (None, B, "z"), (6, C, "c"), (None, "", "e"), (None, "", "e")], SCHEMA)
    assert sorted(r.note for r in minhash_dedup.keep_one(docs).collect()) == ["c", "e", "e", "x", "z"]
    assert minhash_dedup.near_duplicates(docs).filter("kept").count() == 5


def test_near_duplicates_keeps_one_row_of_a_component(spark):
    judged = minhash_dedup.near_duplicates(spark.createDataFrame(ROWS, SCHEMA))
    assert judged.count() == len(ROWS)
    assert judged.filter("kept and n_shingles > 0").count() == 4 and judged.filter("kept and n_shingles = 0").count() == 4
    assert judged.filter("not kept and n_shingles > 0 and component_id = 1").count() == 2


@pytest.mark.parametrize("rows", [ROWS, []])
def test_stages(spark, rows):
    """The stages that drop rows keep every clean one, those that do not keep all."""
    docs = spark.createDataFrame(rows, SCHEMA)
    stages = dict(corpus_pipeline.STAGES)
    assert stages["redact_pii"](spark, docs, None).count() == len(rows)
    exact = [r.note for r in stages["exact_dedup"](spark, docs, None).collect()]
    blanks = {"null text", "empty text", "all null"}  # one text; a blank is white space, so another
    assert len(exact) == (len(rows) - 2 if rows else 0) and len(blanks & set(exact)) == (1 if rows else 0)
    near = [r.note for r in stages["near_dedup"](spark, docs, None).collect()]
    check(near) if rows else None
    assert stages["pack"](spark, docs, None).count() == len(rows)
