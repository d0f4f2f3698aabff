"""Importance resampling of documents towards a target distribution of hashed word features.

Every text becomes a bag of hashed features (runs of consecutive words). A bucket's gain is the logarithm of its share
in the target over its share in the corpus; a document weighs the sum of its features' gains. Gumbel noise that
depends on the document's id alone turns the best weights into a sample without replacement.

* Batch concatenation: the texts of a batch are joined with a separator that no word can hold, so one pass of one pattern
  finds the words of all of them. The place of a word among the documents' offsets (``searchsorted``) says whose it
  is; runs that reach into the next document are masked before they are counted with ``bincount``.
* Both passes over the corpus are map-side: the first sends one row per bucket and task, the second a few numbers per
  document. The driver holds one gain per bucket.
* Ranks come from a range-partitioned sort and one count per partition, so no task sees all documents.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mnemolake.llm.feistel_shards import global_row_numbers
from mnemolake.llm.shared import Memo, Registry, stored, table

registry = Registry()

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
SENTINEL = b"\n"
SLICE_BYTES = 1 << 20  # text joined at a time; a longer text is a slice of its own
# in UTF-8 every byte of a character beyond ASCII is above 0x7F, so the pattern may look at bytes
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_CRC = Memo(zlib.crc32, 200_000)


def _slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > SLICE_BYTES:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


def features(texts: list[bytes], max_n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of every text, and for every feature of any of them its document and its bucket."""
    joined = SENTINEL.join(texts).lower()  # bytes: only A-Z change
    words, at = [], []
    for m in _WORD.finditer(joined):
        words.append(m.group())
        at.append(m.start())
    offsets = np.cumsum([0, *(len(t) + len(SENTINEL) for t in texts[:-1])])
    doc = np.searchsorted(offsets, np.array(at, np.int64), side="right") - 1
    n_words = np.bincount(doc, minlength=len(texts))
    docs, found = [], []
    for n in range(1, max_n + 1):
        runs = words if n == 1 else [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
        if not runs:
            continue
        hashed = np.fromiter(map(_CRC.__getitem__, runs), np.int64, len(runs)) % buckets
        inside = doc[: len(runs)] == doc[n - 1 :]  # runs across two documents are nobody's
        docs.append(doc[: len(runs)][inside])
        found.append(hashed[inside])
    empty = np.empty(0, np.int64)
    return n_words, np.concatenate([empty, *docs]), np.concatenate([empty, *found])


def _batches(texts: pd.Series, max_n: int, buckets: int):
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    for start, end in _slices(raw):
        yield features(raw[start:end], max_n, buckets)


def bucket_counts(docs: DataFrame, text_col: str = "text", max_n: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(``bucket``, ``n``): features of all texts, for buckets that hold any. Null and empty texts have none."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, found in _batches(batch["t"], max_n, buckets):
                total += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": held, "n": total[held]})

    return docs.select(F.col(text_col).alias("t")).mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Thousandths of the log ratio of the two smoothed distributions, rounded down, per bucket."""
    held = [np.zeros(buckets, np.int64) for _ in range(2)]
    for counts, side in zip((corpus, target), held):
        for row in counts.collect():  # one row per bucket at most
            side[row["bucket"]] = row["n"]
    s, t = held
    all_s, all_t = (float(side.sum() + buckets) for side in held)
    return np.array([math.floor(1000 * math.log((t_i + 1.0) * all_s / ((s_i + 1.0) * all_t))) for s_i, t_i in zip(s.tolist(), t.tolist())], np.int64)


def gumbel(id_: Column, seed: int) -> Column:
    """Thousandths of Gumbel noise that an id fixes, rounded down; a null id counts as an empty one."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weigh(
    docs: DataFrame, gains: np.ndarray, max_n: int = 1, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: its ``id``, ``n_words``, ``n_features``, ``weight`` and ``score``."""
    buckets = len(gains)

    @F.pandas_udf("n_words long, n_features long, weight long")
    def weighed(texts: pd.Series) -> pd.DataFrame:
        parts = []
        for n_words, doc, found in _batches(texts, max_n, buckets):
            size = len(n_words)
            n = np.bincount(doc, minlength=size)
            weight = np.bincount(doc, weights=gains[found], minlength=size).astype(np.int64)  # integers, exact in doubles
            parts.append(pd.DataFrame({"n_words": n_words, "n_features": n, "weight": weight}))
        return pd.concat(parts, ignore_index=True)

    rows = docs.select(F.col(id_col).alias("id"), weighed(F.col(text_col)).alias("w")).select("id", "w.*")
    return rows.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed))


def resample(
    docs: DataFrame,
    target: DataFrame,
    max_n: int = 1,
    buckets: int = BUCKETS,
    min_words: int = MIN_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
) -> DataFrame:
    """One row per document: its id, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` (null if not drawn).

    Of the N documents with at least ``min_words`` words, ``floor(percent * N / 100)`` with the highest scores are drawn and
    ranked 1, 2, 3 and so on; ties go to the smaller id, null ids first, and between equal ids to any. Words are runs of digits, letters
    a-z and characters beyond ASCII, A-Z in lower case. Null and empty texts have no features and weigh 0; repeated rows
    are counted and judged one by one; an empty target leaves the corpus' own counts; an empty table gives no rows. Very
    long texts are counted whole. Other columns are ignored, whatever their names.
    """
    gains = bucket_gains(bucket_counts(docs, text_col, max_n, buckets), bucket_counts(target, target_col, max_n, buckets), buckets)
    judged = stored(weigh(docs, gains, max_n, seed, id_col, text_col), "weights")
    able, rest = (judged.filter(c) for c in (F.col("n_words") >= min_words, F.col("n_words") < min_words))
    placed, n = global_row_numbers(able.withColumn("_down", -F.col("score")), ["_down", "id"], "_place_of")
    rank = F.when(F.col("_place_of") < percent * n // 100, F.col("_place_of") + 1)
    ranked = placed.withColumn("rank", rank).drop("_down", "_place_of")
    out = ranked.unionByName(rest.withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", "rank")


# crc32 of a word's bytes, byte by byte through the table of the polynomial
_CRC_SQL = """list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, strlen(f) + 1),
        lambda i: ('0x' || substr(hex(encode(f)), (2 * i - 1)::INT, 2))::UBIGINT)),
        lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255::UBIGINT)::INT + 1]))"""


@registry.add(
    "op11_importance_resampling",
    rf"""WITH words AS (SELECT doc_id, false AS target, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
        UNION ALL SELECT item_id, true, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
    found AS (SELECT doc_id, target, unnest(ws) AS f FROM words),
    steps AS (SELECT list(list_reduce(list_prepend(b::UBIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
            lambda c, z: CASE WHEN c & 1::UBIGINT = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY b) AS steps
        FROM range(256) AS r(b)),
    bucket AS (SELECT f, xor({_CRC_SQL}, 4294967295::UBIGINT) % 10000 AS b FROM (SELECT DISTINCT f FROM found), steps),
    n AS (SELECT b, count(*) FILTER (NOT target) AS s, count(*) FILTER (target) AS t FROM found JOIN bucket USING (f) GROUP BY b),
    al AS (SELECT sum(s)::DOUBLE + 10000 AS s_all, sum(t)::DOUBLE + 10000 AS t_all FROM n),
    gain AS (SELECT b, floor(1000 * ln((t + 1)::DOUBLE * s_all / ((s + 1)::DOUBLE * t_all)))::BIGINT AS g FROM n, al),
    weight AS (SELECT doc_id, sum(g)::BIGINT AS w FROM found JOIN bucket USING (f) JOIN gain USING (b) WHERE NOT target GROUP BY doc_id),
    score AS (SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(w, 0) AS weight, coalesce(w, 0) + floor(-1000 * ln(-ln(
            ((('0x' || left(sha256('2024:' || doc_id), 8))::UBIGINT)::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score
        FROM (SELECT * FROM words WHERE NOT target) LEFT JOIN weight USING (doc_id)),
    ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM score WHERE n_features >= 20)
    SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM score LEFT JOIN ranked USING (doc_id)""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
