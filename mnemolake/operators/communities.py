"""Communities of a weighted graph by modularity, moved and merged until nothing improves."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mnemolake.session import scratch_path


def _written(rows: DataFrame) -> DataFrame:
    """``rows`` as a table in the shared folder. Unlike a checkpoint it starts with its true size and without the
    constraints of the plan behind it, which grow from round to round."""
    spark = rows.sparkSession
    path = scratch_path(spark, "communities")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def symmetric_edges(edges: DataFrame) -> DataFrame:
    """Both directions of every edge (src, dst, weight) once, with the larger weight; loops and weights that are
    null or not above zero are left out."""
    kept = edges.select("src", "dst", F.col("weight").cast("double").alias("weight")).filter("src <> dst AND weight > 0")
    turned = kept.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return kept.unionByName(turned).groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def modularity(both: DataFrame, labels: DataFrame) -> float:
    """Newman's modularity of ``labels`` (node, label) on symmetric edges; 0 for a graph without edges."""
    ends = both.join(labels.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(
        labels.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst"
    )
    inside = F.sum(F.when(F.col("a") == F.col("b"), F.col("weight")).otherwise(0.0))
    sums = ends.groupBy("a").agg(inside.alias("inside"), F.sum("weight").alias("total"))
    q = sums.agg(F.sum("inside").alias("i"), F.sum("total").alias("t"), F.sum(F.col("total") * F.col("total")).alias("s")).first()
    return q["i"] / q["t"] - q["s"] / q["t"] ** 2 if q["t"] else 0.0


def _moves(both: DataFrame, state: DataFrame, whole: float) -> DataFrame:
    """(node, label, degree, target, part): where every node of ``state`` gains most, and its part of the modularity.

    ``target`` equals ``label`` for nodes that stay: of equal gains staying comes first, then the smallest
    label. A node's links are summed per community before they meet the community totals, so a node or a
    community with very many edges is combined in the tasks that read it.
    """
    totals = state.groupBy(F.col("label").alias("target")).agg(F.sum("degree").alias("total"))
    other = state.select(F.col("node").alias("dst"), F.col("label").alias("target"))
    outer = F.when(F.col("src") != F.col("dst"), F.col("weight")).otherwise(0.0)
    links = both.join(other, "dst").select(F.col("src").alias("node"), "target", outer.alias("outer"), "weight")
    stay = state.select("node", F.col("label").alias("target"), F.lit(0.0).alias("outer"), F.lit(0.0).alias("weight"))
    options = links.unionByName(stay).groupBy("node", "target").agg(F.sum("outer").alias("outer"), F.sum("weight").alias("links"))
    scored = options.join(totals, "target").join(state, "node")
    stays = F.col("target") == F.col("label")
    others = F.col("total") - F.when(stays, F.col("degree")).otherwise(0.0)
    gain = F.round(F.col("outer") - F.col("degree") * others / whole, 9)
    part = F.when(stays, F.col("links") - F.col("degree") * F.col("total") / whole) / whole
    best = scored.groupBy("node").agg(
        F.first("label").alias("label"), F.first("degree").alias("degree"),
        F.max(F.struct(gain.alias("gain"), stays.alias("stays"), (-F.col("target")).alias("turned"))).alias("best"),
        F.max(part).alias("part"),
    )
    return best.select("node", "label", "degree", (-F.col("best.turned")).alias("target"), "part")


def _move_until_stable(both: DataFrame, max_rounds: int, patience: int, tolerance: float) -> tuple[DataFrame, float]:
    """Labels of one level and their modularity. In a round about half of the nodes may move, chosen by a hash of
    node and round, so that two neighbours do not swap for ever. Ends when no node gains by moving, or
    when modularity has not risen by ``tolerance`` for ``patience`` rounds; the best labels seen are returned."""
    degrees = both.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("degree"))
    state = _written(degrees.select("node", F.col("node").alias("label"), "degree"))
    whole = state.agg(F.sum("degree")).first()[0]
    best, best_q, waited = state, None, 0
    for number in range(max_rounds):
        moves = _written(_moves(both, state, whole))
        seen = moves.agg(F.sum("part").alias("q"), F.count_if(F.col("target") != F.col("label")).alias("movers")).first()
        waited = 0 if best_q is None or seen["q"] > best_q + tolerance else waited + 1
        if best_q is None or seen["q"] > best_q:
            best, best_q = moves, seen["q"]
        if not seen["movers"] or waited >= patience:
            break
        turn = F.pmod(F.xxhash64("node", F.lit(number)), F.lit(2)) == 0
        state = moves.select("node", F.when(turn, F.col("target")).otherwise(F.col("label")).alias("label"), "degree")
    names = best.groupBy("label").agg(F.min("node").alias("name"))
    return _written(best.join(names, "label").select("node", F.col("name").alias("label"))), best_q


def modularity_communities(
    edges: DataFrame, max_levels: int = 20, max_rounds: int = 100, patience: int = 3, tolerance: float = 1e-6
) -> DataFrame:
    """(doc_id, label): communities of ``edges`` (src, dst, weight; ids are numbers), named by their smallest node.

    Nodes move to the neighbouring community with the largest modularity gain until that is stable; then
    communities become nodes of a smaller graph, whose loops keep the inner weight, and move again. It
    ends when a level merges nothing or modularity no longer rises by ``tolerance``. Communities never
    join nodes that no path connects. A graph without edges has no rows. Every round is a fixed number
    of joins and aggregations and writes its table to the shared folder; the driver sees two sums per round.
    """
    both = _written(symmetric_edges(edges))
    nodes = both.select(F.col("src").alias("doc_id")).distinct().withColumn("label", F.col("doc_id"))
    if both.isEmpty():
        return nodes
    quality = None
    for _ in range(max_levels):
        moved, q = _move_until_stable(both, max_rounds, patience, tolerance)
        if quality is not None and q <= quality + tolerance:
            break
        quality = q
        nodes = _written(
            nodes.join(moved.select(F.col("node").alias("label"), F.col("label").alias("name")), "label").select("doc_id", F.col("name").alias("label"))
        )
        if moved.filter("node <> label").isEmpty():
            break
        a = moved.select(F.col("node").alias("src"), F.col("label").alias("a"))
        b = moved.select(F.col("node").alias("dst"), F.col("label").alias("b"))
        both = _written(
            both.join(a, "src").join(b, "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("weight").alias("weight"))
        )
    return nodes
