"""Vector arithmetic: JVM-side expressions and Arrow-batched scoring."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; zero when either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, size, out=np.zeros_like(matrix), where=size > 0)


def list_matrix(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as the rows of a matrix of doubles."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


#: Scores that ``best_rows`` holds at a time.
SCORES = 2_000_000


def best_rows(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, min_score: float,
    other: bool = False, strip: int = 512,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, row id, score) of the best ``k`` rows for every query; ``other`` leaves out rows with the query's id.

    Scores are products of doubles rounded to six digits before ranking, so that equal vectors tie exactly; ties
    go to the smaller id. At most ``strip`` queries and about ``SCORES`` scores are held at a time. Products of
    single precision, with a bound on their error, and the k-th best of the first rows tell what may be among the best;
    only that is scored in doubles, rounded and sorted.
    """
    lefts, rights, scores = [], [], []
    if len(ids) and len(query_ids):
        size, strip = rows.shape[1], max(1, min(strip, SCORES // len(ids)))
        narrow, across = queries.astype(np.float32), np.ascontiguousarray(rows.astype(np.float32).T)
        longest = lambda m: math.sqrt(np.nanmax(np.einsum("ij,ij->i", m, m), initial=0.0))
        # rounding moves two scores by less than the first part, single precision by less than the second
        slack = 2e-6 + (size + 4) * 1.2e-7 * longest(queries) * longest(rows)
        first = max(1024, len(ids) // 8, k)
    for start in range(0, len(query_ids) if len(ids) else 0, strip):
        strip_ids = query_ids[start : start + strip]
        products = narrow[start : start + strip] @ across
        if other:
            products[strip_ids[:, None] == ids[None, :]] = -np.inf
        floor = np.full((len(strip_ids), 1), min_score)
        if len(ids) > k:
            floor = np.fmax(floor, -np.partition(-products[:, :first], k - 1, axis=1)[:, k - 1 : k])
        at = np.flatnonzero((products >= floor - slack) & (products > -np.inf))
        line, at = np.divmod(at, len(ids))
        if len(line) * size <= products.size:
            found = np.einsum("ij,ij->i", queries[start + line], rows[at])
        else:
            found = (queries[start : start + strip] @ rows.T)[line, at]
        found = np.round(found, 6) + 0.0
        kept = found >= min_score
        line, at, found = line[kept], at[kept], found[kept]
        order = np.lexsort((ids[at], -found, line))
        line, at, found = line[order], at[order], found[order]
        best = np.arange(len(line)) - np.searchsorted(line, line) < k
        lefts.append(strip_ids[line[best]])
        rights.append(ids[at[best]])
        scores.append(found[best])
    if not lefts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(lefts), np.concatenate(rights), np.concatenate(scores)


def best_matches(corpus: DataFrame, query_rows: list, k: int, min_score: float) -> DataFrame:
    """Per Arrow batch the best ``k`` rows for every query: at most k rows per query and batch leave a task.

    ``corpus`` has (doc_id, embedding); ``query_rows`` is a bounded list of (query_id, embedding).
    """
    query_ids = np.array([r["query_id"] for r in query_rows], dtype=np.int64)
    queries = unit_rows(np.array([r["embedding"] for r in query_rows], dtype=np.float64))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = unit_rows(list_matrix(batch.column("embedding")))
            found = best_rows(query_ids, queries, batch.column("doc_id").to_numpy(), vectors, k, min_score)
            yield pa.RecordBatch.from_arrays(list(map(pa.array, found)), names=["query_id", "doc_id", "score"])

    return corpus.select("doc_id", "embedding").mapInArrow(score, "query_id long, doc_id long, score double")
