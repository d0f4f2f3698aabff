"""Vectors in blocks: exact nearest neighbours over a grid, and a stored index of cells and codes."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from mnemolake.functions.vectors import best_matches, best_rows, cosine, list_matrix, unit_rows
from mnemolake.operators.common import top_k
from mnemolake.session import stored_rows

#: Vectors of one block: a task holds two blocks and a strip of their scores.
BLOCK = 4096
#: The similarity graph takes larger blocks of large tables: every vector is sent once per block, and a cell sends k rows
#: per vector. It has about so many blocks until they reach the largest size.
GRAPH_BLOCKS, LARGEST_BLOCK = 12, 32_768
#: Rows that k-means is fitted on, the most cells it may make, and queries that probes are chosen with.
SAMPLE_ROWS, MAX_CELLS, SAMPLE_QUERIES = 50_000, 4096, 200
#: Codes run from -LEVEL to LEVEL, four bits after the dictionary encoding of Parquet.
LEVEL = 7

PAIRS = "query_id long, doc_id long, score double"


def _pairs(left: np.ndarray, right: np.ndarray, scores: np.ndarray) -> pa.Table:
    columns = [pa.array(left, pa.int64()), pa.array(right, pa.int64()), pa.array(scores, pa.float64())]
    return pa.Table.from_arrays(columns, names=["query_id", "doc_id", "score"])


def _blocks(rows: DataFrame, block: int) -> int:
    return max(1, -(-rows.filter(F.col("embedding").isNotNull()).count() // block))


def graph_blocks(n: int) -> int:
    """Blocks of a similarity graph of ``n`` vectors."""
    return max(1, -(-n // min(LARGEST_BLOCK, max(BLOCK, n // GRAPH_BLOCKS))))


# --- exact ---------------------------------------------------------------------------------------
def grid_search(
    queries: DataFrame, corpus: DataFrame, k: int = 10, min_score: float = -1.0, block: int = BLOCK, other: bool = False
) -> DataFrame:
    """Best ``k`` vectors per query by cosine, exact, for query tables of any size; with ``other`` not the query's own id.

    Both sides are hashed into blocks of about ``block`` vectors and every query block meets every corpus
    block in one cell of a grid. A cell sends at most k rows per query; no vector passes the driver. Rows
    without a vector are left out.
    """
    down, across = _blocks(queries, block), _blocks(corpus, block)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    asked = queries.filter("embedding IS NOT NULL").select(
        F.lit(True).alias("asked"), F.col("query_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"),
        part("query_id", down).alias("row"), every(across).alias("col"),
    )
    rows = corpus.filter("embedding IS NOT NULL").select(
        F.lit(False).alias("asked"), F.col("doc_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"),
        every(down).alias("row"), part("doc_id", across).alias("col"),
    )

    def score(table: pa.Table) -> pa.Table:
        asked = table.column("asked").to_numpy()
        ids, vectors = table.column("id").to_numpy(), unit_rows(list_matrix(table.column("v")))
        return _pairs(*best_rows(ids[asked], vectors[asked], ids[~asked], vectors[~asked], k, min_score, other))

    found = asked.unionByName(rows).groupBy("row", "col").applyInArrow(score, PAIRS)
    return top_k(found, ["query_id"], [F.desc("score"), F.asc("doc_id")], k)


def all_neighbours(vectors: DataFrame, k: int, min_score: float, block: int | None = None) -> DataFrame:
    """(src, dst, weight): the best ``k`` other vectors of every vector with cosine of at least ``min_score``.

    Vectors are hashed into blocks; each unordered pair of blocks meets once, in one cell of a triangular
    grid that scores both directions. A cell sends at most k rows per vector. By default blocks grow with the
    table up to ``LARGEST_BLOCK``, so that fewer copies and candidates are sent. Equal scores rank by the
    smaller id; rows without a vector have no edges.
    """
    n = _blocks(vectors, block) if block else graph_blocks(_blocks(vectors, 1))
    own = F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")
    rows = (
        vectors.filter("embedding IS NOT NULL")
        .select(F.col("doc_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"), own.alias("own"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        .select("id", "v", "own", F.least("own", "other").alias("row"), F.greatest("own", "other").alias("col"))
    )

    def score(table: pa.Table) -> pa.Table:
        ids, own = table.column("id").to_numpy(), table.column("own").to_numpy()
        vectors = unit_rows(list_matrix(table.column("v")))
        low = own == own.min() if len(own) else own.astype(bool)
        if low.all():
            sides = [(low, low)] if table.column("row")[0] == table.column("col")[0] else []
        else:
            sides = [(low, ~low), (~low, low)]
        found = [best_rows(ids[a], vectors[a], ids[b], vectors[b], k, min_score, other=True) for a, b in sides]
        return pa.concat_tables([_pairs(*f) for f in found] or [_pairs([], [], [])])

    near = rows.groupBy("row", "col").applyInArrow(score, PAIRS)
    ranked = top_k(near, ["query_id"], [F.desc("score"), F.asc("doc_id")], k)
    return ranked.select(F.col("query_id").alias("src"), F.col("doc_id").alias("dst"), F.col("score").alias("weight"))


def neighbours_of(nodes: DataFrame, vectors: DataFrame, k: int, min_score: float, block: int = BLOCK) -> DataFrame:
    """The rows of ``all_neighbours`` that leave the given nodes (doc_id), without scoring the other vectors' pairs."""
    asked = vectors.join(nodes.select("doc_id").distinct(), "doc_id", "left_semi").withColumnRenamed("doc_id", "query_id")
    near = grid_search(asked, vectors, k, min_score, block, other=True)
    return near.select(F.col("query_id").alias("src"), F.col("doc_id").alias("dst"), F.col("score").alias("weight"))


# --- stored index ----------------------------------------------------------------------------------
@dataclass(frozen=True)
class VectorIndex:
    """Centres of the cells, the rotation in front of the codes, and the stored rows.

    ``rows`` has (cell, doc_id, code, embedding), sorted by cell, so a search that names its cells skips
    the other row groups and one that ranks by code does not read the vectors.
    """

    path: str
    centres: np.ndarray
    rotation: np.ndarray
    rows: DataFrame


def _rotation(size: int, seed: int) -> np.ndarray:
    """A random rotation: afterwards no single dimension holds most of a vector."""
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))[0] if size else np.zeros((0, 0))


def _sample(corpus: DataFrame, n: int, sample_rows: int, seed: int) -> DataFrame:
    """All of ``n`` rows, or just under ``sample_rows`` of them: those whose keyed hash of the id is small, so that no task
    sorts or gathers the table. They are dealt over tasks of some 2,000 rows."""
    parts = 1 << 40
    share = 1.0 if n <= sample_rows else 0.97 * sample_rows / n
    kept = corpus.filter(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(parts)) < int(share * parts))
    return kept.repartition(max(1, min(n, sample_rows) // 2000), "doc_id")


def _fit_centres(corpus: DataFrame, n: int, cells: int, sample_rows: int, seed: int) -> np.ndarray:
    """k-means over the unit vectors of a bounded sample."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    sample = (
        _sample(corpus, n, sample_rows, seed)
        .withColumn("size", size)
        .filter("size > 0")
        .select(array_to_vector(F.transform("embedding", lambda x: x.cast("double") / F.col("size"))).alias("features"))
    )
    if sample.isEmpty():
        return np.zeros((1, len(corpus.first()["embedding"])))
    model = KMeans(k=cells, seed=seed, maxIter=15).fit(sample)
    return unit_rows(np.array(model.clusterCenters(), dtype=np.float64))


def build_vector_index(
    corpus: DataFrame, path: str, cells: int | None = None, sample_rows: int = SAMPLE_ROWS, seed: int = 7
) -> VectorIndex:
    """Store every row of ``corpus`` (doc_id, embedding) with its cell and its code.

    The default number of cells is the square root of the number of rows, at most ``MAX_CELLS`` and at
    most a tenth of the sample; only the centres are fitted on the sample. Rows are range partitioned by
    cell and hash of the id, so a cell with a third of all rows is spread over many files. The rows are stored before they
    are counted and sampled, and with their codes before the ranges are chosen, so each is computed once. Rows without a
    vector are left out; a zero vector goes to the first cell. An empty corpus has one cell.
    """
    spark = corpus.sparkSession
    given = corpus.select(F.col("doc_id").cast("long").alias("doc_id"), "embedding").filter("embedding IS NOT NULL")
    given = stored_rows(given, "vectors")
    first = given.first()
    n = given.count()
    size = len(first["embedding"]) if first else 0
    rotation = _rotation(size, seed)
    wanted = max(1, min(MAX_CELLS, cells or math.isqrt(n), min(n, sample_rows) // 10))
    centres = np.zeros((1, size)) if wanted == 1 else _fit_centres(given, n, wanted, sample_rows, seed)
    scale = LEVEL * math.sqrt(size) / 3  # three standard deviations of a rotated unit vector

    def encode(batches):
        for batch in filter(lambda b: b.num_rows, batches):
            unit = unit_rows(list_matrix(batch.column("embedding")))
            codes = np.clip(np.rint(unit @ rotation * scale), -LEVEL, LEVEL).astype(np.int8)
            cell = (unit @ centres.T).argmax(axis=1)
            offsets = np.arange(0, codes.size + 1, size, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell, pa.int32()), batch.column("doc_id"), pa.ListArray.from_arrays(offsets, codes.ravel()), batch.column("embedding")],
                names=["cell", "doc_id", "code", "embedding"],
            )

    kind = given.schema["embedding"].dataType.simpleString()
    coded = given.mapInArrow(encode, f"cell int, doc_id long, code array<tinyint>, embedding {kind}")
    placed = stored_rows(coded, "codes").repartitionByRange("cell", F.xxhash64("doc_id")).sortWithinPartitions("cell", "doc_id")
    placed.write.mode("overwrite").parquet(f"{path}/rows")
    matrices = [("centre", i, v.tolist()) for i, v in enumerate(centres)] + [("rotation", i, v.tolist()) for i, v in enumerate(rotation)]
    spark.createDataFrame(matrices, "kind string, i int, v array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/matrices")
    return open_vector_index(spark, path)


def open_vector_index(spark: SparkSession, path: str) -> VectorIndex:
    """An index stored before. The driver reads its centres (at most ``MAX_CELLS``) and its rotation."""
    stored = spark.read.parquet(f"{path}/matrices").orderBy("i").collect()
    matrix = lambda kind: np.array([r["v"] for r in stored if r["kind"] == kind])
    return VectorIndex(path, matrix("centre"), matrix("rotation"), spark.read.parquet(f"{path}/rows"))


def _probed(index: VectorIndex, queries: DataFrame, probes: int) -> DataFrame:
    """(query_id, v, cell): rotated unit vectors of the queries with their ``probes`` nearest cells."""
    centres, rotation = index.centres, index.rotation
    probes = min(probes, len(centres))
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding").filter("embedding IS NOT NULL")
    if not centres.size:  # an index of no rows knows no length of vectors
        asked = asked.limit(0)

    def probe(batches):
        for batch in filter(lambda b: b.num_rows, batches):
            unit = unit_rows(list_matrix(batch.column("embedding")))
            cells = np.argsort(-(unit @ centres.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
            turned = (unit @ rotation).astype(np.float32)
            lists = lambda m: pa.ListArray.from_arrays(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32), m.ravel())
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), lists(turned), lists(cells)], names=["query_id", "v", "cells"])

    found = asked.mapInArrow(probe, "query_id long, v array<float>, cells array<int>")
    return found.select("query_id", "v", F.explode("cells").alias("cell"))


def search_vector_index(
    index: VectorIndex, queries: DataFrame, k: int = 10, probes: int | None = None, candidates: int | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """Approximate best ``k`` rows per query: codes of the probed cells give candidates, exact cosines rank them.

    ``probes`` cells are read per query (default: all; ``choose_probes`` measures how many are needed) and
    the ``candidates`` rows with the best code scores (default 3 k) are scored on their vectors. Cells
    are cut into blocks on both sides, so neither a hot cell nor many queries meet in one task; a block
    sends at most ``candidates`` rows per query.
    """
    wanted = candidates or 3 * k
    asked = _probed(index, queries, probes or len(index.centres))
    sizes = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    # one row per cell, MAX_CELLS at most: broadcast, so that rows are dealt by block and never by cell alone
    grid = F.broadcast(sizes(index.rows.select("cell"), "across").join(sizes(asked.select("cell"), "down"), "cell"))
    part = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(grid, "cell").select(
        "cell", F.col("query_id").alias("id"), "v", F.lit(None).cast("array<tinyint>").alias("code"),
        part("query_id", "down").alias("row"), every("across").alias("col"),
    )
    right = index.rows.select("cell", "doc_id", "code").join(grid, "cell").select(
        "cell", F.col("doc_id").alias("id"), F.lit(None).cast("array<float>").alias("v"), "code",
        every("down").alias("row"), part("doc_id", "across").alias("col"),
    )

    def shortlist(table: pa.Table) -> pa.Table:
        asked = table.filter(pc.is_valid(table.column("v")))
        rows = table.filter(pc.is_valid(table.column("code")))
        found = best_rows(
            asked.column("id").to_numpy(), list_matrix(asked.column("v")),
            rows.column("id").to_numpy(), list_matrix(rows.column("code")), wanted, -math.inf,
        )
        return _pairs(*found)

    short = left.unionByName(right).groupBy("cell", "row", "col").applyInArrow(shortlist, PAIRS)
    # stored, so that the engine knows that they are few and does not shuffle the vectors to meet them
    short = stored_rows(top_k(short, ["query_id"], [F.desc("score"), F.asc("doc_id")], wanted).select("query_id", "doc_id"), "short")
    vectors = queries.select("query_id", F.col("embedding").alias("asked"))
    scored = short.join(index.rows.select("doc_id", "embedding"), "doc_id").join(vectors, "query_id")
    exact = scored.select("query_id", "doc_id", F.round(cosine(F.col("embedding"), F.col("asked")), 6).alias("score"))
    return top_k(exact, ["query_id"], [F.desc("score"), F.asc("doc_id")], k)


def choose_probes(index: VectorIndex, queries: DataFrame, k: int = 10, target: float = 0.95, sample: int = SAMPLE_QUERIES) -> int:
    """The fewest cells per query that hold ``target`` of the exact best ``k`` rows, measured on sampled queries.

    At most ``sample`` queries (those with the smallest hash of the id) travel to the tasks and meet all rows in
    one pass that shuffles no vector; the driver sees them and k cell numbers for each. Without queries or rows: all cells.
    """
    asked = queries.select("query_id", "embedding").filter("embedding IS NOT NULL").orderBy(F.xxhash64("query_id")).limit(sample).collect()
    if not asked:
        return len(index.centres)
    best = top_k(best_matches(index.rows, asked, k, -1.0), ["query_id"], [F.desc("score"), F.asc("doc_id")], k)
    hits = stored_rows(best, "best").join(index.rows.select("doc_id", "cell"), "doc_id").select("query_id", "cell").collect()
    if not hits:
        return len(index.centres)
    vectors = {r["query_id"]: r["embedding"] for r in asked}
    order = {q: np.argsort(-(index.centres @ unit_rows(np.array([v], dtype=np.float64))[0]), kind="stable") for q, v in vectors.items()}
    places = np.sort([int(np.flatnonzero(order[r["query_id"]] == r["cell"])[0]) for r in hits])
    return int(places[math.ceil(target * len(places)) - 1]) + 1


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Per query of ``exact`` the share of its rows whose score is at least reached in ``found``.

    Rows with equal scores can stand for each other, so the k-th best score decides, not the id.
    """
    floor = exact.groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("wanted"))
    hits = found.join(floor, "query_id").filter("score >= floor").groupBy("query_id").agg(F.count("*").alias("hits"))
    share = F.least(F.lit(1.0), F.coalesce("hits", F.lit(0)) / F.col("wanted"))
    return floor.join(hits, "query_id", "left").select("query_id", share.alias("recall"))
