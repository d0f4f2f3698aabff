"""Key sentences of windows: one exchange per query, plain trimming, capitals counted in one pass."""

import contextlib
import io
import re

from pyspark.sql import functions as F

from mnemolake.functions.text import SPACE, SPACES, strip
from mnemolake.operators import enrich


def test_windows_are_dealt_by_document_once(spark):
    docs = spark.createDataFrame([(1, "The key result shows growth in Oslo. " * 60)], "doc_id long, text string")
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        enrich.key_sentences_chunked(docs, 3).explain()
    assert plan.getvalue().count("Exchange hashpartitioning") == 1


def test_strip_trims_what_the_pattern_names(spark):
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    row = spark.createDataFrame([(every,)], "t string").select(F.regexp_replace("t", f"[^{SPACE[1:-1]}]", "").alias("s")).first()
    assert sorted(row["s"]) == sorted(SPACES)
    texts = ["", " ", f"{SPACES}a{SPACES}b{SPACES}", "a\n", " \r\na b", None, "​ x"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select(strip(F.col("t")).alias("a"), F.regexp_replace("t", f"^{SPACE}+|{SPACE}+$", "").alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got] and got[2]["a"] == f"a{SPACES}b"


def test_points_of_sentences_equal_the_plain_rule(spark):
    kept = ["One Two three Four Five Six", "Alone", "a B \U00010400x ÉcoleÀ École", "some camelCase here", "snake_case and Other", "x_Y _ aB"]
    rows = spark.createDataFrame([(kept,)], "kept array<string>").select(enrich.sentence_scores(F.col("kept")).alias("x")).first()["x"]
    upper = lambda w: w[:1].isupper()
    for i, s in enumerate(kept):
        want = max(0, 3 - i) + (2 if i >= len(kept) - 2 else 0)
        want += min(3, sum(upper(w) for w in re.split(r"\s+", s)[1:]))
        want += bool(re.search(r"\b[a-z]+[A-Z][a-zA-Z]*\b", s)) + bool(re.search(r"\b[a-z]+_[a-z]+\b", s))
        assert -rows[i]["neg"] == want, s
