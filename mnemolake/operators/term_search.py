"""Keyword search for queries that are known beforehand, without an index of all terms.

The distinct terms of a bounded set of queries go to the tasks. One pass over the texts keeps, per document, its length and the
counts of these terms only; this narrow table is stored. A second pass over it scores all documents of a block against
all queries and keeps k rows per query and task. No text and no posting is shuffled, and the result is exact. More queries than the
bounds allow search a stored index (``text_index``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mnemolake.functions.text import tokens
from mnemolake.operators.common import bounded_rows, top_k
from mnemolake.session import stored_rows

MOST_QUERIES = 2000
MOST_PAIRS = 200_000  # (query, term)
BLOCK_WORDS = 2_000_000  # bytes of text that are counted together
BLOCK_CELLS = 2_000_000  # (document, query) scores that a task holds
#: everything but a-z and 0-9 becomes a space; what is not ASCII has no such byte in UTF-8
_SPACES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


@dataclass
class QueryIndex:
    """``rows``: doc_id, length, codes, counts and the kept columns; a code is a term's place in ``terms``, ``df`` is by code."""

    rows: DataFrame
    terms: list[str]
    df: np.ndarray
    n: int
    mean_length: float
    keep: tuple[str, ...] = ()


def asked_terms(queries: DataFrame, most_queries: int | None = None, most_pairs: int | None = None) -> dict | None:
    """The distinct terms per query id, or None when there are more than the bounds allow."""
    most_queries = MOST_QUERIES if most_queries is None else most_queries
    pairs = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    rows = bounded_rows(pairs, MOST_PAIRS if most_pairs is None else most_pairs)
    if rows is None:
        return None
    asked: dict = {}
    for query_id, term in rows:
        asked.setdefault(query_id, set()).add(term)
    return asked if len(asked) <= most_queries else None


def _counter(terms: list[str], keep: tuple[str, ...]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code_of = {t.encode(): i for i, t in enumerate(terms)}.get
        for batch in batches:
            texts, at = batch.column("text"), 0
            while at < len(texts):
                start, size, codes, found, lengths = at, 0, [], [], []
                while at < len(texts) and size < BLOCK_WORDS:
                    text = texts[at].as_py()
                    words = [] if text is None else text.lower().encode().translate(_SPACES).split()
                    known = [c for c in map(code_of, words) if c is not None]
                    codes.extend(known)
                    found.append(len(known))
                    lengths.append(None if text is None else len(words))
                    size += len(text or "")
                    at += 1
                row = np.repeat(np.arange(at - start), found)
                keys, counts = np.unique((row << 32) | np.array(codes, np.int64), return_counts=True)
                offsets = pa.array(np.searchsorted(keys >> 32, np.arange(at - start + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in (keys & 0xFFFFFFFF, counts)]
                part = batch.slice(start, at - start)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(lengths, pa.int32()), *lists, *(part.column(c) for c in keep)],
                    names=["doc_id", "length", "codes", "counts", *keep],
                )

    return count


def _holders(size: int):
    """Documents that hold a term, per code and task."""

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(batch.column("codes").flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["code", "df"])

    return hold


def index_for(docs: DataFrame, queries: DataFrame, keep: tuple[str, ...] = ()) -> QueryIndex | None:
    """Count the terms of the queries in (``doc_id``, ``text``), or None when the queries are too many. ``keep`` columns go along."""
    asked = asked_terms(queries)
    if asked is None:
        return None
    terms = sorted(set().union(*asked.values()))
    kept = [docs.schema[c] for c in keep]
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, length int, codes array<int>, counts array<int>" + "".join(
        f", {f.name} {f.dataType.simpleString()}" for f in kept
    )
    rows = stored_rows(docs.select("doc_id", "text", *keep).mapInArrow(_counter(terms, keep), schema), "query-terms")
    totals = rows.select(F.count("*").alias("n"), F.count("length").alias("texts"), F.sum(F.col("length").cast("long")).alias("words")).first()
    df = np.zeros(len(terms), np.int64)
    held = rows.select("codes").mapInArrow(_holders(len(terms)), "code int, df long").groupBy("code").agg(F.sum("df").alias("df"))
    for code, n in held.collect():  # at most one row per term of the queries
        df[code] = n
    return QueryIndex(rows, terms, df, totals["n"], max(totals["words"] or 0, 1) / max(totals["texts"] or 0, 1), tuple(keep))


def best_rows(found: pa.Table, n_queries: int, k: int) -> tuple[pa.Table, np.ndarray]:
    """The best ``k`` rows per query, ties to the smaller id, and the score that a further row must reach."""
    found = found.sort_by([("query_no", "ascending"), ("score", "descending"), ("doc_id", "ascending")])
    numbers = found.column("query_no").to_numpy()
    starts = np.searchsorted(numbers, np.arange(n_queries + 1))
    place = np.arange(len(numbers)) - starts[numbers]
    least, full = np.zeros(n_queries), np.flatnonzero(np.diff(starts) >= k)
    least[full] = found.column("score").to_numpy()[starts[full] + k - 1]
    return found.take(pa.array(np.flatnonzero(place < k))), least


def _scorer(asking: list[np.ndarray], n_queries: int, idf: np.ndarray, k: int, k1: float, b: float, mean_length: float, keep: tuple[str, ...]):
    """``asking`` has the numbers of the queries that hold a term, per code."""

    def block(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        lists, counts = part.column("codes"), part.column("counts").flatten().to_numpy().astype(np.float64)
        codes, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
        rows = np.repeat(np.arange(len(part)), sizes)
        lengths = part.column("length").fill_null(0).to_numpy().astype(np.float64)
        norm = k1 * (1 - b + b * lengths / mean_length)
        weights = idf[codes] * (counts * (k1 + 1) / (counts + norm[rows]))
        order = np.argsort(codes, kind="stable")
        codes, rows, weights = codes[order], rows[order], weights[order]
        scores = np.zeros((n_queries, len(part)))
        starts = np.flatnonzero(np.diff(codes, prepend=-1))
        for start, end in zip(starts, np.append(starts[1:], len(codes))):
            # terms are added in the same order for every document, so equal texts score alike
            at, w = rows[start:end], weights[start:end]
            for query in asking[codes[start]]:
                scores[query, at] += w
        return scores > 0, np.round(scores, 6)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, least, step = None, np.zeros(n_queries), max(1, BLOCK_CELLS // max(n_queries, 1))
        for batch in batches:
            for start in range(0, len(batch), step):
                part = batch.slice(start, step)
                hit, scores = block(part)
                if len(part) > k:
                    least = np.maximum(least, np.partition(scores, len(part) - k, axis=1)[:, len(part) - k])
                number, at = np.nonzero(hit & (scores >= least[:, None]))
                values = [pa.array(number.astype(np.int32)), pa.array(scores[number, at])]
                given = [part.column(c).take(pa.array(at)) for c in ("doc_id", *keep)]
                new = pa.Table.from_arrays([*values, *given], names=["query_no", "score", "doc_id", *keep])
                best, reached = best_rows(new if best is None else pa.concat_tables([best, new]), n_queries, k)
                least = np.maximum(least, reached)
        if best is not None:
            yield from best.combine_chunks().to_batches()

    return score


def search_for(
    index: QueryIndex, queries: DataFrame, k: int = 10, min_score: float = 0.0, among: DataFrame | None = None, k1: float = 1.2, b: float = 0.75
) -> DataFrame:
    """Best ``k`` documents per query by BM25: (query_id, doc_id, score, rank, kept columns), ties to the smaller id.

    ``queries`` are those of the index or some of them. ``among`` (doc_id) restricts the hits, not the statistics.
    """
    spark, code_of = index.rows.sparkSession, {t: i for i, t in enumerate(index.terms)}
    asked = asked_terms(queries)
    names, asking = list(asked), [[] for _ in index.terms]
    for number, query_id in enumerate(names):
        for term in asked[query_id]:
            asking[code_of[term]].append(number)
    idf = np.log(1 + (index.n - index.df + 0.5) / (index.df + 0.5))
    rows = index.rows if among is None else index.rows.join(among.select("doc_id").distinct(), "doc_id", "left_semi")
    id_type, query_type = index.rows.schema["doc_id"].dataType, queries.schema["query_id"].dataType
    schema = f"query_no int, score double, doc_id {id_type.simpleString()}" + "".join(
        f", {c} {index.rows.schema[c].dataType.simpleString()}" for c in index.keep
    )
    given = rows.select("doc_id", "length", "codes", "counts", *index.keep)
    scored = given.mapInArrow(_scorer(asking, len(names), idf, k, k1, b, index.mean_length, index.keep), schema)
    best = top_k(scored.filter(F.col("score") >= min_score), ["query_no"], [F.desc("score"), F.asc("doc_id")], k)
    numbers = spark.createDataFrame(list(enumerate(names)), f"query_no int, query_id {query_type.simpleString()}")
    out = best.join(numbers, "query_no").select("query_id", "doc_id", "score", "rank", *index.keep)
    # stored: the engine then knows how small it is, and joins texts to it without shuffling them
    return stored_rows(out, "hits")
