"""A stored inverted index for keyword search: postings by shard and term, with bounds that let a search skip them.

A shard is a run of documents that one task read together, cut at a number of documents or words. It has one row with
the ids and lengths of its documents and one row per term: places, counts, and the largest count and smallest length among
them, from which an upper bound of any score from this row follows for every choice of BM25 parameters. The index is
built in one pass without a shuffle of postings, and stored in buckets by term.

A search first adds up the bounds of every (query, shard) from the narrow columns alone. The most promising shards of a
query are read first; the k-th best score found there is the threshold that every other shard must be able to reach.
Inside a shard, terms are added in the order of their bounds, and once the rest cannot lift a new document over the threshold, only
documents already close to it are finished. So common terms are hardly ever read through, no text is read, and
what is shuffled are compressed postings and k rows per query and shard, never (query, document) pairs.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from mnemolake.functions.text import tokens
from mnemolake.operators.common import top_k
from mnemolake.session import scratch_path, stored_rows

SHARD_DOCS = 8192
SHARD_WORDS = 4_000_000
BUCKETS = 16
QUERY_BLOCK = 2000  # queries that one task scores together
FIRST_SHARDS = 2  # shards of a query that are read before the others
SLACK = 1e-6  # scores are compared after rounding to six digits
COLUMNS = ["shard", "term", "places", "counts", "df", "top_count", "least_length", "ids", "lengths"]
_TOKEN = re.compile("[a-z0-9]+")


@dataclass
class TextIndex:
    """``postings``: shard, bucket, term, places, counts, df, top_count, least_length; ``shards``: shard, ids, lengths."""

    postings: DataFrame
    shards: DataFrame


def _shard_rows(shard: int, words: dict[str, int], codes: array, lengths: list[int | None], ids: pa.Array) -> Iterator[pa.RecordBatch]:
    """The rows of one shard: one per term, and one with its documents. ``codes`` are the words of all texts in order."""
    lens = np.array([n or 0 for n in lengths], np.int32)
    word_of = np.frombuffer(codes, np.int64) if len(codes) else np.empty(0, np.int64)
    keys, counts = np.unique((word_of << 32) | np.repeat(np.arange(len(lens)), lens), return_counts=True)
    word_of, places, counts = keys >> 32, (keys & 0xFFFFFFFF).astype(np.int32), counts.astype(np.int32)
    starts = np.flatnonzero(np.diff(word_of, prepend=-1))
    offsets = pa.array(np.append(starts, len(keys)), pa.int32())
    names, n = list(words), len(starts)
    int_list = lambda values: pa.ListArray.from_arrays(offsets, pa.array(values))
    if n:
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n, shard)), pa.array([names[w] for w in word_of[starts].tolist()], pa.string()), int_list(places), int_list(counts),
                pa.array(np.diff(np.append(starts, len(keys))).astype(np.int32)), pa.array(np.maximum.reduceat(counts, starts)),
                pa.array(np.minimum.reduceat(lens[places], starts)), pa.nulls(n, pa.list_(ids.type)), pa.nulls(n, pa.list_(pa.int32())),
            ],
            names=COLUMNS,
        )
    one = pa.array([0, len(lens)], pa.int32())
    nulls = [pa.nulls(1, t) for t in (pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.int32())]
    lists = [pa.ListArray.from_arrays(one, ids), pa.ListArray.from_arrays(one, pa.array(lengths, pa.int32()))]
    yield pa.RecordBatch.from_arrays([pa.array([shard]), *nulls, *lists], names=COLUMNS)


def _collect_shards(batches: Iterator[pa.RecordBatch], shard_docs: int, shard_words: int) -> Iterator[pa.RecordBatch]:
    number, id_type = TaskContext.get().partitionId() << 32, None
    words, codes, lengths, ids = {}, array("q"), [], []

    def shard():
        return _shard_rows(number, words, codes, lengths, pa.array(ids, id_type))

    for batch in batches:
        id_type = batch.schema.field("doc_id").type
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            found = _TOKEN.findall((text.as_py() or "").lower())
            codes.extend([words.setdefault(w, len(words)) for w in found])
            ids.append(doc_id)
            lengths.append(len(found) if text.is_valid else None)
            if len(ids) >= shard_docs or len(codes) >= shard_words:
                yield from shard()
                number += 1
                words, codes, lengths, ids = {}, array("q"), [], []
    if ids:
        yield from shard()


def build_index(docs: DataFrame, path: str | None = None, shard_docs: int = SHARD_DOCS, shard_words: int = SHARD_WORDS, buckets: int = BUCKETS) -> TextIndex:
    """Write the index of (``doc_id``, ``text``) to ``path``, by default a fresh folder of the shared scratch space.

    Ids are of any type that orders, without nulls; null texts count as documents, but not in the mean length.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "text-index")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        "shard long, term string, places array<int>, counts array<int>, df int, top_count int, least_length int, "
        f"ids array<{id_type}>, lengths array<int>"
    )
    rows = docs.select("doc_id", "text").mapInArrow(lambda b: _collect_shards(b, shard_docs, shard_words), schema)
    # -1: the rows of the shards themselves. Rebalancing splits large buckets, so a common term stays in no single task.
    bucket = F.when(F.col("term").isNull(), -1).otherwise(F.pmod(F.xxhash64("term"), F.lit(buckets))).cast("int")
    placed = rows.withColumn("bucket", bucket).hint("rebalance", "bucket")
    placed.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(path)
    return read_index(spark, path, id_type)


def read_index(spark: SparkSession, path: str, id_type: str = "bigint") -> TextIndex:
    schema = (
        "shard long, term string, places array<int>, counts array<int>, df int, top_count int, least_length int, "
        f"ids array<{id_type}>, lengths array<int>, bucket int"
    )
    rows = spark.read.schema(schema).parquet(path)
    postings = rows.filter("bucket >= 0").drop("ids", "lengths")
    return TextIndex(postings, rows.filter("bucket < 0").select("shard", "ids", "lengths"))


def _best(scores: np.ndarray, k: int) -> float:
    """The k-th best score, 0 where fewer documents have one."""
    return float(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0.0


def score_shard(terms: list[tuple[np.ndarray, np.ndarray]], n: int, k: int, least: float = 0.0, allowed: np.ndarray | None = None) -> np.ndarray:
    """Scores of the documents of a shard that can be among the best ``k`` of those that reach ``least``; others may be too low.

    ``terms`` has the places and weights of every query term. Terms of high weights come first; when those to come cannot
    lift a document without any of the former over the threshold, only documents near the threshold go on.
    """
    terms = sorted(terms, key=lambda t: -t[1].max())
    rest = np.cumsum([0.0, *(t[1].max() for t in reversed(terms))])[::-1]
    scores = np.zeros(n)
    limit = np.zeros(n) if allowed is None else np.where(allowed, 0.0, -np.inf)
    for i, (places, weights) in enumerate(terms):
        if i and least > rest[i]:
            open_ = np.flatnonzero(scores + limit + rest[i] >= least - SLACK)
            for later, w in terms[i:]:
                at = np.searchsorted(later, open_)
                hit = at < len(later)
                hit[hit] = later[at[hit]] == open_[hit]
                scores[open_[hit]] += w[at[hit]]
            break
        scores[places] += weights
        if i + 1 < len(terms):
            least = max(least, _best(scores + limit, k))
    return scores + limit


def _scorer(k: int, k1: float, b: float, mean_length: float):
    def score(key: tuple, held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        head = held[held["ids"].notna()]
        if not len(head) or not len(asked):
            return pd.DataFrame({"query_id": [], "doc_id": [], "score": []})
        ids, lengths = np.asarray(head["ids"].iat[0]), np.asarray(head["lengths"].iat[0], np.float64)
        allowed = None
        if head["allowed"].iat[0] is not None:
            allowed = np.zeros(len(ids), bool)
            allowed[np.asarray(head["allowed"].iat[0], np.int64)] = True
        norm = k1 * (1 - b + b * lengths / mean_length)
        weights = {}
        for term, places, counts in zip(*(held.loc[held["ids"].isna(), c] for c in ("term", "places", "counts"))):
            places, counts = np.asarray(places), np.asarray(counts, np.float64)
            weights[term] = places, counts * (k1 + 1) / (counts + norm[places])
        out = []
        for query_id, mine in asked.groupby("query_id", sort=False):
            terms = [(weights[t][0], idf * weights[t][1]) for t, idf in zip(mine["term"], mine["idf"]) if t in weights]
            scores = np.round(score_shard(terms, len(ids), k, float(mine["least"].iat[0]), allowed), 6)
            hits = np.flatnonzero(scores > 0)
            if len(hits) > k:
                hits = hits[scores[hits] >= _best(scores[hits], k)]
            hits = hits[np.lexsort((ids[hits], -scores[hits]))][:k]
            out.append(pd.DataFrame({"query_id": query_id, "doc_id": ids[hits], "score": scores[hits]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "doc_id": [], "score": []})

    return score


def search_index(
    index: TextIndex, queries: DataFrame, k: int = 10, min_score: float = 0.0, among: DataFrame | None = None, k1: float = 1.2, b: float = 0.75
) -> DataFrame:
    """Best ``k`` documents per query by BM25: (query_id, doc_id, score, rank), ties to the smaller id.

    ``among`` (doc_id) restricts the hits, not the statistics. Queries are read once; documents that share no term with a query
    are no hits.
    """
    totals = index.shards.select(
        F.count("*").alias("shards"), F.sum(F.size("ids")).alias("n"), F.sum(F.size(F.filter("lengths", lambda x: x.isNotNull()))).alias("texts"),
        F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x, F.lit(0)))).alias("words"),
    ).first()
    n = totals["n"] or 0
    mean_length = max(totals["words"] or 0, 1) / max(totals["texts"] or 0, 1)
    terms = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    wanted = terms.select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("bucket")).distinct()
    read = index.postings.filter(F.col("bucket").isin([r["bucket"] for r in wanted.collect()]))  # at most as many as buckets

    df = read.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("n_docs"))
    idf = F.log(1 + (n - F.col("n_docs") + 0.5) / (F.col("n_docs") + 0.5))
    asked = stored_rows(terms.join(df.select("term", idf.alias("idf")), "term"), "asked")
    top = F.col("top_count") * (k1 + 1) / (F.col("top_count") + k1 * (1 - b + b * F.col("least_length") / mean_length))
    bounds = asked.join(read.select("term", "shard", top.alias("top")), "term").groupBy("query_id", "shard").agg(
        F.sum(F.col("idf") * F.col("top")).alias("bound")
    )
    if among is not None:
        places = index.shards.select("shard", F.posexplode("ids").alias("at", "doc_id")).join(among.select("doc_id").distinct(), "doc_id", "left_semi")
        # places of a shard: bounded by its size
        allowed = places.groupBy("shard").agg(F.collect_list("at").alias("allowed"))
        shards = index.shards.join(allowed, "shard")
        bounds = bounds.join(allowed.select("shard"), "shard", "left_semi")
    else:
        shards = index.shards.withColumn("allowed", F.lit(None).cast("array<int>"))
    bounds = stored_rows(bounds, "bounds")  # one row per query and shard with any of its terms
    blocks = 1 + queries.count() // QUERY_BLOCK
    query_type, id_type = queries.schema["query_id"].dataType, index.shards.schema["ids"].dataType.elementType
    schema = f"query_id {query_type.simpleString()}, doc_id {id_type.simpleString()}, score double"

    def read_shards(pairs: DataFrame) -> DataFrame:
        """Best ``k`` of every (query, shard, least) pair."""
        dealt = pairs.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
        jobs = dealt.join(asked, "query_id").select("shard", "block", "query_id", "term", "idf", "least")
        needs = jobs.select("shard", "block", "term").distinct()
        lists = read.select("shard", "term", "places", "counts").join(needs, ["shard", "term"]).select("shard", "block", "term", "places", "counts")
        heads = shards.join(dealt.select("shard", "block").distinct(), "shard").select("shard", "block", "ids", "lengths", "allowed")
        held = lists.unionByName(heads, allowMissingColumns=True)
        jobs = jobs.toDF("of_shard", "of_block", "query_id", "term", "idf", "least")  # both sides stem from the same tables
        return held.groupBy("shard", "block").cogroup(jobs.groupBy("of_shard", "of_block")).applyInPandas(_scorer(k, k1, b, mean_length), schema)

    best, order = [F.desc("score"), F.asc("doc_id")], [F.desc("bound"), F.asc("shard")]
    ranked = top_k(bounds, ["query_id"], order, FIRST_SHARDS, "turn").withColumn("least", F.lit(0.0))
    first = read_shards(ranked.select("query_id", "shard", "least"))
    if totals["shards"] <= FIRST_SHARDS:
        return top_k(first.filter(F.col("score") >= min_score), ["query_id"], best, k)
    first = stored_rows(first, "first-shards")
    least = top_k(first, ["query_id"], best, k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    open_ = bounds.join(ranked.select("query_id", "shard"), ["query_id", "shard"], "left_anti").join(least, "query_id", "left")
    open_ = open_.withColumn("least", F.coalesce("least", F.lit(0.0))).filter(F.col("bound") >= F.col("least") - SLACK)
    found = first.unionByName(read_shards(open_.select("query_id", "shard", "least"))).filter(F.col("score") >= min_score)
    return top_k(found, ["query_id"], best, k)
