"""Communities: planted groups, components and modularity computed by SQL."""

import duckdb
import numpy as np
import pytest

from mnemolake.operators import communities as c

SCHEMA = "src long, dst long, weight double"


def planted(groups=6, size=12, seed=3):
    """Dense groups with a few weak links between the groups of each half: two components."""
    rng, edges = np.random.default_rng(seed), []
    for a in range(groups * size):
        for b in range(a + 1, groups * size):
            if a // size == b // size and rng.random() < 0.7:
                edges.append((a, b, 1.0))
            elif a // (groups // 2 * size) == b // (groups // 2 * size) and rng.random() < 0.03:
                edges.append((b, a, 0.5))
    return edges


@pytest.fixture(scope="module")
def result(spark):
    edges = planted()
    found = {r["doc_id"]: r["label"] for r in c.modularity_communities(spark.createDataFrame(edges, SCHEMA)).collect()}
    return edges, found


def test_planted_groups_are_found(result):
    _, found = result
    assert found == {n: n // 12 * 12 for n in range(72)}


def test_modularity_and_components_by_sql(spark, result):
    edges, found = result
    con = duckdb.connect()
    con.execute("CREATE TABLE e (src BIGINT, dst BIGINT, weight DOUBLE)")
    con.executemany("INSERT INTO e VALUES (?, ?, ?)", edges)
    con.execute("CREATE TABLE l (node BIGINT, label BIGINT)")
    con.executemany("INSERT INTO l VALUES (?, ?)", list(found.items()))
    q = con.execute("""WITH b AS (FROM e UNION ALL SELECT dst, src, weight FROM e),
        x AS (SELECT x.label AS a, y.label AS b, weight FROM b JOIN l x ON src = x.node JOIN l y ON dst = y.node),
        s AS (SELECT a, sum(weight) FILTER (a = b) AS i, sum(weight) AS t FROM x GROUP BY a)
        SELECT sum(i) / sum(t) - sum(t * t) / (sum(t) * sum(t)) FROM s""").fetchone()[0]
    both = c.symmetric_edges(spark.createDataFrame(edges, SCHEMA))
    labels = spark.createDataFrame(list(found.items()), "node long, label long")
    assert q == pytest.approx(c.modularity(both, labels)) and q > 0.6
    # a community never reaches beyond its component
    crossing = con.execute("""WITH RECURSIVE b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
        r AS (SELECT DISTINCT src AS node, src AS seen FROM b UNION SELECT r.node, b.dst FROM r JOIN b ON r.seen = b.src),
        k AS (SELECT node, min(seen) AS component FROM r GROUP BY node)
        SELECT count(*) FROM (SELECT label FROM l JOIN k USING (node) GROUP BY label HAVING count(DISTINCT component) > 1)""").fetchone()[0]
    assert crossing == 0


def test_hub_pairs_and_unusable_edges(spark):
    edges = [(0, i, 1.0) for i in range(1, 15)] + [(20, 21, 0.1), (21, 20, 0.3), (30, 30, 1.0), (40, 41, 0.0), (42, 43, None)]
    found = {r["doc_id"]: r["label"] for r in c.modularity_communities(spark.createDataFrame(edges, SCHEMA)).collect()}
    assert found == {**{i: 0 for i in range(15)}, 20: 20, 21: 20}
    assert c.modularity_communities(spark.createDataFrame([], SCHEMA)).count() == 0
