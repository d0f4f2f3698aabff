"""Quality and timing measures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def rank_quality(ranked: DataFrame, relevant: DataFrame, depth: int = 5) -> DataFrame:
    """Per query: harmonic weight of relevant ranks in the first ``depth``, over the best possible."""
    head = ranked.filter(F.col("rank") <= depth).join(
        relevant.select("doc_id").distinct().withColumn("_rel", F.lit(1)), "doc_id", "left"
    )
    weight = 1 / F.col("rank")
    return head.groupBy("query_id").agg(
        F.round(
            F.coalesce(F.sum(F.when(F.col("_rel") == 1, weight)), F.lit(0.0)) / F.sum(weight), 3
        ).alias("quality")
    )


def quality_summary(per_query: DataFrame) -> DataFrame:
    return per_query.agg(
        F.round(F.avg("quality"), 6).alias("mean"),
        F.round(F.median("quality"), 6).alias("median"),
        F.min("quality").alias("min"),
        F.count("*").alias("queries"),
    )


SPLIT = 65_536  # buckets a range is split into, and so the most rows of a group that one task orders
ROUNDS = 3  # splits of a sixteenth of an octave: after them a bucket of doubles holds a value or two


def _octave(x: Column) -> Column:
    """A whole number that grows with a double: its sign and its binary logarithm in sixteenths."""
    size = F.floor(F.log2(F.abs(x)) * 16).cast("long") + 20_000
    bounded = F.when(F.abs(x) == float("inf"), F.lit(1 << 20)).otherwise(size)
    return F.when(F.isnan(x), F.lit(1 << 21)).when(x == 0, F.lit(0)).when(x > 0, bounded).otherwise(-bounded)


def values_at(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The values at given ranks of each group, by counting ranges and refining the one that holds the rank.

    ``counts`` (group, value, n) has one row per distinct value, ``wanted`` (group, which, rank) ranks from 1. Every round
    counts the values of the open range in buckets, which is combined before the shuffle, and keeps the bucket that
    holds the rank. A group's values are never ordered in one task, only its bucket counts. Returns
    (group, which, value); a rank beyond the group gives no row, null values count as no value.
    """
    counts = counts.filter(F.col("value").isNotNull())
    x, lo, hi = (F.col(c).cast("double") for c in ("value", "lo", "hi"))
    share = F.floor((x - lo) / (hi - lo) * SPLIT).cast("long")
    finer = F.when((hi > lo) & ~F.isnan(hi), share).otherwise(F.lit(0))

    def chosen(rows: DataFrame, by: str) -> DataFrame:
        upto = F.sum("n").over(Window.partitionBy("group", "which").orderBy(by))
        placed = rows.withColumn("upto", upto)
        return placed.filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))

    def narrowed(held: DataFrame, bucket: Column) -> DataFrame:
        parts = held.groupBy("group", "which", "rank", bucket.alias("bucket")).agg(
            F.sum("n").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")
        )
        return chosen(parts, "bucket").select("group", "which", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), "lo", "hi")

    inside = lambda open_: counts.join(open_, "group").filter(F.col("value").between(F.col("lo"), F.col("hi")))
    first = narrowed(counts.join(wanted, "group"), _octave(x))
    last = reduce(lambda open_, _: narrowed(inside(open_), finer), range(ROUNDS), first)
    return chosen(inside(last).drop("lo", "hi"), "value").select("group", "which", "value")


def latency_stats(runs: DataFrame, by: list[str], budget: float) -> DataFrame:
    """Mean, median, 95th percentile (a measured value), extremes and whether the budget holds.

    Percentiles are exact (``values_at``); a null in ``by`` is a group of its own. Null values count in ``n`` only; a
    group without any other has no measures.
    """
    counts = runs.groupBy(F.struct(*by).alias("group"), "value").agg(F.count("*").alias("n"))
    valued = F.sum(F.when(F.col("value").isNotNull(), F.col("n")))
    stats = counts.groupBy("group").agg(
        F.sum("n").alias("n"),
        F.round(F.sum(F.col("value") * F.col("n")) / valued, 6).alias("mean"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        valued.alias("valued"),
    )
    ranks = {"low": "(valued + 1) div 2", "high": "valued div 2 + 1", "p95": "(valued * 95 + 99) div 100"}
    wanted = stats.select("group", F.explode(F.array(*[
        F.struct(F.lit(name).alias("which"), F.expr(rank).alias("rank")) for name, rank in ranks.items()
    ])).alias("r")).select("group", "r.*")
    found = values_at(counts, wanted).groupBy("group").agg(*[
        F.max(F.when(F.col("which") == name, F.col("value"))).alias(f"_{name}") for name in ranks
    ])
    median = F.round((F.col("_low") + F.col("_high")) / 2, 6).alias("median")
    out = stats.join(found, "group", "left").select("group.*", "n", "mean", median, "min", "max", F.col("_p95").alias("p95"))
    return out.withColumn("within_budget", F.col("p95") <= budget)


def eval_summary(cases: DataFrame) -> DataFrame:
    passed, total = F.count_if("passed"), F.count("*")
    return cases.agg(
        passed.alias("passed"), (total - passed).alias("failed"),
        F.round(F.when(total > 0, passed / total).otherwise(0.0), 4).alias("score"),
    )


def compare_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change of every metric in percent; a metric may be missing on one side."""
    b = before.select("metric", F.col("value").alias("before"))
    a = after.select("metric", F.col("value").alias("after"))
    change = F.round((F.col("after") - F.col("before")) / F.col("before") * 100, 4)
    return b.join(a, "metric", "full_outer").withColumn("delta_pct", F.when(F.col("before") != 0, change))
