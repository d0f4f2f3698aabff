"""Reproducible shuffle into shards by a Feistel permutation of global row numbers.

Row numbers follow the id order. A permutation of [0, n) that can be computed for one number alone, and inverted,
then says in which shard and slot a row lies: no random numbers are stored and nothing is sorted again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mnemolake.llm.shared import Registry, let, stored, table

registry = Registry()

ROUNDS = 6
PRIME = (1 << 31) - 1
WALK = 64
LOW = 33  # bits of the place inside a partition in monotonically_increasing_id


def round_keys(seed: int) -> list[tuple[int, int]]:
    """Two numbers below the prime for every round, from a seed."""
    state, keys = seed % PRIME or 1, []
    for _ in range(2 * ROUNDS):
        state = state * 48271 % PRIME
        keys.append(state)
    return list(zip(keys[::2], keys[1::2]))


def _div(value, by: int) -> Column:
    return F.call_function("div", value, F.lit(by).cast("long"))


def _scramble(value, k1, k2):
    """A cubic modulo 2^31-1; every product stays below 2^62."""
    t = (value + k1) % PRIME
    return (t * t % PRIME * t + k2) % PRIME


def permute(number: Column, n: int, seed: int, inverse: bool = False) -> Column:
    """The place of ``number`` in a pseudo-random permutation of [0, n), or the number at a place.

    The permutation works on a grid of a x b cells, a*b >= n > a*b - a, and walks along its cycle until it is
    below n again. At most a cells lie outside, so a second step is rare and 64 are never used up; should it
    happen, the query fails rather than give a wrong place.
    """
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    b = max(1, -(-n // a))
    sides = list(enumerate(round_keys(seed)))
    keys = F.array(*[
        F.struct(F.lit(i % 2).alias("side"), F.lit(k1).cast("long").alias("k1"), F.lit(k2).cast("long").alias("k2"))
        for i, (k1, k2) in (reversed(sides) if inverse else sides)
    ])
    way = -1 if inverse else 1

    def turn(at, key):
        x = F.pmod(at["x"] + way * _scramble(at["y"], key["k1"], key["k2"]), F.lit(a).cast("long"))
        y = F.pmod(at["y"] + way * _scramble(at["x"], key["k1"], key["k2"]), F.lit(b).cast("long"))
        return F.struct(
            F.when(key["side"] == 0, x).otherwise(at["x"]).alias("x"), F.when(key["side"] == 0, at["y"]).otherwise(y).alias("y")
        )

    def once(v):
        start = F.struct(_div(v, b).alias("x"), (v % F.lit(b).cast("long")).alias("y"))
        return F.aggregate(keys, start, turn, lambda at: at["x"] * F.lit(b).cast("long") + at["y"])

    inside = F.lit(n)
    walked = let(
        once(number.cast("long")),
        lambda p: F.when(p < inside, p).otherwise(
            F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), p, lambda acc, _: F.when(acc < inside, acc).otherwise(once(acc)))
        ),
    )
    return let(walked, lambda p: F.when(p < inside, p).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long")))


def global_row_numbers(rows: DataFrame, order: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """Number rows 0, 1, ... in an order, without a single-task sort; also the number of rows.

    Rows are range-partitioned and sorted, stored with their place in the partition, and the sizes of the
    partitions before are added. The driver sees one count per partition.
    """
    spark = rows.sparkSession
    salted = rows.withColumn("_salt", F.monotonically_increasing_id())  # equal rows need not share a partition
    ranged = salted.repartitionByRange(*order, "_salt").sortWithinPartitions(*order, "_salt").drop("_salt")
    placed = stored(ranged.withColumn("_place", F.monotonically_increasing_id()), "row-places")
    sizes = dict(placed.groupBy(F.shiftright("_place", LOW).alias("p")).count().collect())
    before, total = [0] * (max(sizes, default=0) + 1), 0
    for p in range(len(before)):
        before[p] = total
        total += sizes.get(p, 0)
    starts = F.array(*[F.lit(x).cast("long") for x in before])
    part = F.shiftright("_place", LOW).cast("int")
    place = F.col("_place").bitwiseAND(F.lit((1 << LOW) - 1))
    return placed.withColumn(name, F.get(starts, part) + place).drop("_place"), total


def shard_rows(rows: DataFrame, order: list[str], shards: int, seed: int = 20240229) -> DataFrame:
    """Add ``row_number``, ``shard`` and ``slot``: a reproducible shuffle dealt out evenly.

    Shard sizes differ by at most one row and slots are gapless from 0. The same rows, shard count and seed give the
    same result on any cluster. Repeated rows get places of their own; null keys sort first; an empty table gives
    no rows. ``permute(shard + slot * shards, n, seed, inverse=True)`` finds the row number at a place.
    """
    numbered, n = global_row_numbers(rows, order)
    at = numbered.withColumn("_at", permute(F.col("row_number"), n, seed))
    return at.withColumns({"shard": (F.col("_at") % shards).cast("int"), "slot": _div(F.col("_at"), shards)}).drop("_at")


@registry.add("op8_feistel_shards")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    dealt = shard_rows(rows, ["doc_id", "text_crc32", "size"], 24)
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
