"""Small building blocks shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """Best ``k`` rows per group. Spark trims each partition to ``k`` before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def first_per(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """First row per group. Like ``top_k`` with one row: each partition sends one row per group."""
    return top_k(df, by, order, 1, "_first").drop("_first")


def with_group(df: DataFrame, by: list[str], *aggs: Column) -> DataFrame:
    """Add aggregates of a row's group to the row.

    The aggregation combines before its shuffle and the join back is one the engine can split when
    one group holds a large share of the rows; a window over the group could not be split.
    """
    return df.join(df.groupBy(*by).agg(*aggs), on=by, how="inner")


def bucketed_row_number(df: DataFrame, by: list[str], bucket: Column, order: list[Column], name: str) -> DataFrame:
    """Row numbers per group without sorting a whole group in one task.

    ``bucket`` must grow with the order (a day, say). Rows are numbered inside (group, bucket); the count
    of earlier buckets of the group is added.
    """
    rows = df.withColumn("_bucket", bucket)
    sizes = rows.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = Window.partitionBy(*by, "_bucket").orderBy(*order)
    numbered = rows.withColumn("_local", F.row_number().over(local)).join(offsets, [*by, "_bucket"])
    return numbered.withColumn(name, F.col("_before") + F.col("_local")).drop("_bucket", "_before", "_local")


def bounded_rows(df: DataFrame, limit: int) -> list | None:
    """Rows of a table that must be small, or None when it has more than ``limit`` rows."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None
