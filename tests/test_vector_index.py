"""Blocked neighbours and the stored vector index against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from mnemolake.functions.vectors import best_rows
from mnemolake.operators import retrieval, vector_index as vi

VECTOR = "embedding array<double>"


def frame(spark, rows, key):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], f"{key} long, {VECTOR}")


def unit(m):
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def clustered(n, dims=16, centres=12, seed=1):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(centres, dims))[rng.integers(0, centres, n)] * 2 + rng.normal(size=(n, dims)) * 0.4


@pytest.mark.parametrize("block", [4096, 40, 7])
def test_all_neighbours_equal_brute_force(spark, block):
    m = clustered(120)
    m[5] = m[9] = m[11]
    m[7] = 0
    scores = np.round(unit(m) @ unit(m).T, 6) + 0.0
    want = set()
    for i in range(len(m)):
        best = sorted((j for j in range(len(m)) if j != i and scores[i, j] >= 0.2), key=lambda j: (-scores[i, j], j))[:6]
        want |= {(i, j, scores[i, j]) for j in best}
    got = vi.all_neighbours(frame(spark, [*enumerate(m), (900, None)], "doc_id"), 6, 0.2, block).collect()
    assert len(got) == len(want) and {(r["src"], r["dst"], r["weight"]) for r in got} == want


def test_grid_search_equals_one_pass(spark):
    corpus = frame(spark, enumerate(clustered(150)), "doc_id")
    asked = frame(spark, enumerate(clustered(31, seed=1)), "query_id")
    key = lambda df: sorted((r["query_id"], r["doc_id"], r["rank"], r["score"]) for r in df.collect())
    assert key(vi.grid_search(asked, corpus, 5, 0.1, 20)) == key(retrieval.vector_search(asked, corpus, 5, 0.1))


def test_index_reads_few_cells_of_clustered_vectors(spark, tmp_path):
    m = clustered(1500)
    m[:500] = m[0]  # a third of all rows are copies and share one cell
    corpus, asked = frame(spark, enumerate(m), "doc_id"), frame(spark, enumerate(m[490:560]), "query_id")
    index = vi.build_vector_index(corpus, str(tmp_path / "i"), cells=12)
    probes = vi.choose_probes(index, asked, 10)
    assert probes <= 4
    again = vi.open_vector_index(spark, str(tmp_path / "i"))
    assert again.rows.count() == 1500 and np.allclose(again.centres, index.centres)
    found = vi.search_vector_index(again, asked, 10, probes, 100, block=64)
    share = [r["recall"] for r in vi.recall(found, retrieval.vector_search(asked, corpus, 10)).collect()]
    assert len(share) == 70 and np.mean(share) >= 0.9


def test_all_candidates_give_exact_results(spark, tmp_path):
    m = np.random.default_rng(5).normal(size=(90, 8))
    m[3] = 0
    corpus, asked = frame(spark, [*enumerate(m), (500, None)], "doc_id"), frame(spark, [*enumerate(m[:20] + 0.1), (99, None)], "query_id")
    index = vi.build_vector_index(corpus, str(tmp_path / "i"))
    key = lambda df: sorted((r["query_id"], r["doc_id"], r["rank"]) for r in df.collect())
    assert key(vi.search_vector_index(index, asked, 5, candidates=90)) == key(retrieval.vector_search(asked, corpus, 5))


def test_empty_tables(spark, tmp_path):
    rows, none = frame(spark, enumerate(np.eye(3)), "doc_id"), frame(spark, [], "doc_id")
    asked, nobody = frame(spark, enumerate(np.eye(3)), "query_id"), frame(spark, [], "query_id")
    assert vi.all_neighbours(none, 3, 0.1).count() == 0
    assert vi.grid_search(asked, none).count() == vi.grid_search(nobody, rows).count() == 0
    assert retrieval.vector_search(nobody, rows).count() == retrieval.vector_search(asked, none).count() == 0
    index = vi.build_vector_index(none, str(tmp_path / "none"))
    assert vi.choose_probes(index, asked) == 1 and vi.search_vector_index(index, asked).count() == 0
    full = vi.build_vector_index(rows, str(tmp_path / "full"))
    assert vi.search_vector_index(full, nobody).count() == 0
    zero = vi.build_vector_index(frame(spark, [(i, [0, 0, 0]) for i in range(40)], "doc_id"), str(tmp_path / "zero"))
    assert vi.search_vector_index(zero, asked, 2).count() == 6


def test_best_rows_equals_sorting_every_score():
    rng = np.random.default_rng(5)
    ids = rng.permutation(300)
    rows = unit(rng.integers(-1, 2, (300, 4)).astype(float))  # many equal scores, some zero vectors
    rows[7] = np.nan
    for k, floor, other in ((3, -1.0, False), (15, 0.3, True), (400, -1.0, True), (5, 0.99, False)):
        got = list(zip(*(x.tolist() for x in best_rows(ids[:40], rows[:40], ids, rows, k, floor, other=other, strip=16))))
        want = []
        for q, v in zip(ids[:40].tolist(), rows[:40]):
            scored = [(round(float(s), 6) + 0.0, i) for s, i in zip(np.round(rows @ v, 6), ids.tolist()) if s >= floor and not (other and i == q)]
            want += [(q, i, s) for s, i in sorted(scored, key=lambda x: (-x[0], x[1]))[:k]]
        assert got == want


def test_graph_search_looks_for_edges_of_reached_nodes_only(spark, monkeypatch):
    def every(*_):
        raise AssertionError("scores all pairs of vectors for a search from a few nodes")

    vectors = spark.createDataFrame(
        [(i, np.random.default_rng(i).normal(size=4).tolist()) for i in range(60)], "doc_id long, embedding array<double>"
    )
    edges = vi.all_neighbours(vectors, 3, 0.2, block=16)
    nodes = vectors.select("doc_id").filter("doc_id % 7 = 0")
    want = sorted(map(tuple, edges.filter("src % 7 = 0").collect()))
    assert want and sorted(map(tuple, vi.neighbours_of(nodes.unionByName(nodes), vectors, 3, 0.2, block=16).select(*edges.columns).collect())) == want
    hits = nodes.select(F.lit(1).alias("query_id"), "doc_id", F.lit(1.0).alias("score"))
    found = [retrieval.graph_search(hits, e, 2, 50) for e in (edges, retrieval.similar_to(vectors, 0.2, 3, 16))]
    whole, asked = [sorted(map(tuple, f.collect())) for f in found]
    assert asked == whole
    monkeypatch.setattr(retrieval, "all_neighbours", every)
    assert entry.queries()["graph_search"](spark, "/root/testdata/sf0.001").count() > 0
