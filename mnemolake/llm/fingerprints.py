"""Document fingerprints by one-permutation MinHash, in column expressions only.

Every shingle of five words is hashed once; the top bits choose one of 128 bins and each bin keeps its smallest hash.
Empty bins are filled by optimal densification: each asks the others in an order of its own, the same for all
documents, and takes the value of the first that is not empty. Of every bin the four lowest bits are stored as one
hexadecimal digit, and the likeness of two fingerprints corrects for digits that agree by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from mnemolake.llm.shared import SPACE, Registry, let, table

registry = Registry()

WORDS = 5
BIN_BITS = 7
BINS = 1 << BIN_BITS
DIGIT_BITS = 4
GROUP_ROWS = 2000


BLANKS = " \t\n\x0b\x0c\r"


def shingles(text: Column) -> Column:
    """64-bit hashes of all runs of five words; a shorter text is one shingle, a blank or null one has none."""

    def hashed(ws):
        runs = F.transform(F.sequence(F.lit(0), F.size(ws) - WORDS), lambda i: F.xxhash64(*[F.get(ws, i + j) for j in range(WORDS)]))
        return F.when(F.size(ws) >= WORDS, runs).otherwise(F.array(F.xxhash64(F.array_join(ws, " "))))

    def split(trimmed):
        return F.when(trimmed == "", F.array().cast("array<bigint>")).otherwise(let(F.split(trimmed, SPACE), hashed))

    return let(F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(BLANKS)), split)


def _bin(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BIN_BITS).cast("int")


def _digit(h: Column) -> Column:
    return h.bitwiseAND(F.lit((1 << DIGIT_BITS) - 1).cast("long"))


def bin_minima(hashes: Column) -> Column:
    """The smallest hash of every bin that has one, in the order of the bins."""

    def firsts(s):
        before = F.concat(F.array(F.lit(None).cast("bigint")), s)  # one longer: the last pair has no hash and is dropped
        marked = F.zip_with(s, before, lambda h, b: F.when(b.isNull() | (_bin(h) != _bin(b)), h))
        return F.filter(marked, lambda h: h.isNotNull())

    def by_bin(m):  # signed order puts the upper half of the bins first
        return F.concat(F.filter(m, lambda h: h >= 0), F.filter(m, lambda h: h < 0))

    return let(let(F.sort_array(hashes), firsts), by_bin)


def fingerprint(text: Column) -> Column:
    """One hexadecimal digit per bin; empty for a text without words. Equal texts have equal fingerprints."""

    def borrowed(minima, i):
        # bin i asks the full bins in the order of a hash of both numbers; the digit rides in the lowest bits
        asked = F.transform(
            minima, lambda h: F.xxhash64(i, _bin(h)).bitwiseAND(F.lit(-(1 << DIGIT_BITS)).cast("long")).bitwiseOR(_digit(h))
        )
        return _digit(F.array_min(asked))

    def empty_bins(minima, low, high):
        """Digits of the bins from ``low`` to before ``high``, all of them empty."""
        none = F.array().cast("array<bigint>")
        return F.when(high > low, F.transform(F.sequence(low, high - 1), lambda i: borrowed(minima, i))).otherwise(none)

    def digits(minima):
        after = F.concat(F.slice(minima, F.lit(2), F.size(minima)), F.array(F.lit(None).cast("bigint")))
        runs = F.zip_with(
            minima, after,
            lambda h, n: F.concat(F.array(_digit(h)), empty_bins(minima, _bin(h) + 1, F.coalesce(_bin(n), F.lit(BINS)))),
        )
        return F.concat(empty_bins(minima, F.lit(0), _bin(F.get(minima, F.lit(0)))), F.flatten(runs))

    def spelled(minima):
        letters = F.transform(digits(minima), lambda d: F.substring(F.lit("0123456789abcdef"), (d + 1).cast("int"), F.lit(1)))
        return F.when(F.size(minima) == 0, "").otherwise(F.array_join(letters, ""))

    return let(bin_minima(shingles(text)), spelled)


def likeness(one: Column, other: Column) -> Column:
    """Estimated Jaccard similarity, 0 to 1: digits of unlike sets agree once in sixteen, which is taken off.

    Two empty fingerprints are alike, an empty and another one are not.
    """
    agree = F.size(F.filter(F.zip_with(F.split(one, ""), F.split(other, ""), lambda a, b: a == b), lambda same: same)) / F.lit(BINS)
    chance = 1 / (1 << DIGIT_BITS)
    corrected = F.greatest(F.lit(0.0), (agree - chance) / (1 - chance))
    return F.when((one == "") | (other == ""), (one == other).cast("double")).otherwise(corrected)


def with_next(docs: DataFrame, id_col: str, carried: list[str]) -> DataFrame:
    """Add ``next_<column>`` of the row with the next smaller id; the last row's next is the first.

    Rows are dealt to ranges of ids, four per shuffle partition, and the largest row of each range is sent to
    the range above as well, so the table is shuffled once and no task sorts all of it. The driver sees two numbers
    per range. Rows of one id follow each other in the order of the carried columns; null ids come last.
    """
    spark = docs.sparkSession
    lowest = -(1 << 63)
    rows = docs.withColumn("_id", F.coalesce(F.col(id_col).cast("long"), F.lit(lowest)))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.select(F.percentile_approx("_id", [i / n for i in range(1, n)], 100 * n)).first()[0] or []
    cuts = sorted(set(cuts))
    steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts])
    # the number of cuts not above the id, by halving
    found = F.aggregate(
        F.array(*[F.lit(s) for s in steps]) if steps else F.array().cast("array<int>"), F.lit(0),
        lambda at, s: F.when(F.get(bounds, at + s - 1) <= F.col("_id"), at + s).otherwise(at),
    )
    rows = rows.withColumn("_range", found if cuts else F.lit(0))
    tops = dict(rows.select("_id", "_range").groupBy("_range").agg(F.max("_id")).collect())
    used = sorted(tops)
    above = {r: used[(i + 1) % len(used)] for i, r in enumerate(used)}
    size = max(used, default=0) + 1
    top = F.get(F.array(*[F.lit(tops.get(r)).cast("long") for r in range(size)]), F.col("_range"))
    guest = F.get(F.array(*[F.lit(above.get(r)).cast("int") for r in range(size)]), F.col("_range"))
    wraps = F.col("_range") == F.lit(used[-1] if used else 0)
    own = F.struct(F.col("_range").alias("at"), F.lit(0).alias("guest"))
    # a guest stands below the rows of its range; so does the very first row, sent to the lowest range
    sent = F.when(F.col("_id") == top, F.array(own, F.struct(guest.alias("at"), F.when(wraps, 2).otherwise(1).alias("guest"))))
    dealt = rows.withColumn("_to", F.explode(F.coalesce(sent, F.array(own))))
    order = Window.partitionBy("_to.at").orderBy(F.col("_to.guest"), F.col("_id").desc(), *carried)
    following = dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried})
    return following.filter("_to.guest = 0").drop("_id", "_range", "_to")


def half_replaced(text: Column, other: Column) -> Column:
    """The text whose last half (rounded down) is replaced by as much of the start of the other, or all of it."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.left(text, F.length(text) - half), F.left(other, half))


@registry.add("op6_fingerprints")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    marked = docs.withColumn("fingerprint", fingerprint(F.col("text")))
    paired = with_next(marked, "doc_id", ["text", "fingerprint"])
    edited = paired.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), half_replaced(F.col("text"), F.col("next_text")).alias("edited"),
        "fingerprint", "next_fingerprint",
    )
    both = edited.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
