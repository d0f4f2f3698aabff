"""Connected components of a graph of any size by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mnemolake.llm.shared import stored


def _state(df: DataFrame) -> tuple:
    row = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """(``a``, ``b``) pairs of longs to one row (``node``, ``root``) per node: root is its component's smallest node.

    Large-star: every node links its larger neighbours to its smallest neighbour; small-star: its smaller
    neighbours and itself. Both keep the components and end in stars after about log(n) rounds. Minima are combined
    before they are shuffled and joined back by plain joins, which the engine splits at hubs. Each round is stored
    in the shared folder. Loops and repeated pairs are ignored; roots are rows too; no edges give no rows.
    """
    stars = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    stars = stored(stars, "stars")
    before = _state(stars)
    while before[0]:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = stored(large, "large-stars")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        stars = stored(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "stars")
        after = _state(stars)
        if after == before:
            break
        before = after
    out = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return out.unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
