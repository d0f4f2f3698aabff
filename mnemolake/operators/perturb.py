"""Local differential privacy: repeatable noise on numbers, dates, words, names, mails and addresses.

Noise comes from a hash of the caller's secret and the value, so retried tasks agree. The secret must stay
secret: whoever knows it can undo the noise.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from mnemolake.functions import fixed
from mnemolake.functions.hashing import gumbel, laplace, uniform
from mnemolake.functions.text import SPACE, strip
from mnemolake.operators.common import bucketed_row_number, first_per


def sensitivity(kind: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in fixed.PII_SENSITIVITY.items() for x in kv])
    return F.coalesce(names[kind], F.lit(fixed.DEFAULT_SENSITIVITY))


def epsilon(kind: Column, preset: str = "default") -> Column:
    levels = F.create_map(*[F.lit(x) for kv in fixed.EPSILON_PRESETS[preset].items() for x in kv])
    return levels[sensitivity(kind)]


def epsilon_lookup(values: DataFrame, preset: str = "default") -> DataFrame:
    kind = F.col("pii_type")
    return values.withColumn("sensitivity", sensitivity(kind)).withColumn("epsilon", epsilon(kind, preset))


def privacy_budget(values: DataFrame, session: str, preset: str = "default") -> DataFrame:
    """Spent epsilon and number of perturbed values per session."""
    return epsilon_lookup(values, preset).groupBy(session).agg(
        F.round(F.sum("epsilon"), 6).alias("total_epsilon"), F.count("*").alias("perturbations")
    )


def perturb_digits(value: Column, eps: Column, seed: str, sensitivity: Column | float = 1.0) -> Column:
    """Add Laplace noise to every digit (modulo ten); all other characters stay."""
    scale = F.lit(sensitivity) / eps if isinstance(sensitivity, (int, float)) else sensitivity / eps

    def one(ch: Column, i: Column) -> Column:
        noisy = F.rint(ch.cast("double") + laplace(scale, uniform(seed, value, i)))
        return F.when(F.rlike(ch, F.lit("^[0-9]$")), F.pmod(noisy, F.lit(10.0)).cast("int").cast("string")).otherwise(ch)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def digit_sensitivity(kind: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in fixed.DIGIT_SENSITIVITY.items() for x in kv])
    return F.coalesce(known[kind], F.lit(1.0))


def _padded(pattern: str) -> str:
    """Output pattern with two-digit fields, as dates were written."""
    return re.sub(r"(?<![A-Za-z])([MdHhms])(?![A-Za-z])|(?<=T')([MdHhms])(?![A-Za-z])", lambda m: m.group(0) * 2, pattern)


def perturb_dates(value: Column, eps: Column, seed: str) -> Column:
    """Shift a date by days, a date with time also by minutes, a time by minutes within its day.

    The first format that parses gives the output format too; unparsable text gets digit noise.
    """
    text = strip(value)
    days = laplace(fixed.DATE_SHIFT_DAYS / eps, uniform(seed, value, F.lit("days"))).cast("int")
    minutes = laplace(fixed.TIME_SHIFT_MINUTES / eps, uniform(seed, value, F.lit("minutes"))).cast("int")
    shifted = []
    for pattern, kind in fixed.DATE_FORMATS:
        ts = F.try_to_timestamp(text, F.lit(pattern))
        if kind == "time":
            moved = F.timestamp_add("MINUTE", minutes, ts)  # only the clock is written back
        elif kind == "datetime":
            moved = F.timestamp_add("MINUTE", minutes, F.timestamp_add("DAY", days, ts))
        else:
            moved = F.timestamp_add("DAY", days, ts)
        shifted.append(F.date_format(moved, _padded(pattern)))
    return F.coalesce(*shifted, perturb_digits(value, eps, seed))


def pick_other(choices: Column, original: Column, seed: str, *parts: Column) -> Column:
    """Uniform choice among the values different from the original (any case)."""
    left = F.filter(choices, lambda c: F.lower(c) != F.lower(original))
    at = F.floor(uniform(seed, original, *parts) * F.size(left)).cast("int")
    return F.when(F.size(left) > 0, F.get(left, at)).otherwise(original)


def perturb_words(words: DataFrame, candidates: DataFrame, eps: float, seed: str, fallback=()) -> DataFrame:
    """Exponential mechanism: a similar word with probability ∝ exp(ε·similarity/2).

    ``candidates`` (word, candidate, similarity) keeps similarities from 0.2 to 0.95. Adding Gumbel noise to
    the scores and taking the maximum draws from exactly that distribution, one row per word. Words without
    candidates get a uniform choice from ``fallback``.
    """
    usable = candidates.filter(F.col("similarity").between(0.2, 0.95))
    noisy = F.round(eps * F.col("similarity") / 2 + gumbel(uniform(seed, F.col("word"), F.col("candidate"))), 9)
    scored = words.select("word").distinct().join(usable, "word").withColumn("_s", noisy)
    best = first_per(scored, ["word"], [F.desc("_s"), F.asc("candidate")]).select("word", "candidate")
    out = words.join(best, "word", "left")
    spare = pick_other(F.array(*[F.lit(f) for f in fallback]).cast("array<string>"), F.col("word"), seed)
    return out.withColumn("perturbed", F.coalesce("candidate", spare)).drop("candidate")


def perturb_names(names: DataFrame, first_names: list[str], last_names: list[str], seed: str) -> DataFrame:
    """New first and last names, unique within a session; middle parts stay.

    ``names`` (session_id, full_name). Names of a session are numbered in hashed order and take list entries
    without replacement; when a list is used up (or gives back the same name) ``perturbed`` is null and the
    caller uses a token. Adds the part mappings.
    """
    if not first_names or not last_names:
        raise ValueError("name lists must not be empty")
    rows = names.select("session_id", "full_name").distinct()
    key = F.md5(F.concat_ws("\u001f", F.lit(seed), "session_id", "full_name"))
    rows = rows.withColumn("_k", key)
    rows = bucketed_row_number(rows, ["session_id"], F.left("_k", F.lit(2)), [F.col("_k")], "_n")
    parts = F.split(strip(F.col("full_name")), SPACE + "+")
    rows = rows.withColumn("_parts", parts)
    shuffled = lambda values: F.transform(
        F.array_sort(F.transform(F.array(*[F.lit(v) for v in values]), lambda v: F.struct(
            F.md5(F.concat(F.lit(seed), F.col("session_id"), v)).alias("o"), v.alias("v")
        ))), lambda x: x["v"]
    )
    first = F.get(shuffled(first_names), (F.col("_n") - 1).cast("int"))
    last = F.get(shuffled(last_names), (F.col("_n") - 1).cast("int"))
    rows = rows.withColumn("_first", first).withColumn("_last", last)
    n = F.size("_parts")
    head, tail = F.get("_parts", F.lit(0)), F.get("_parts", n - 1)
    clash = F.lower("_first") == F.lower(head)
    clash = clash | ((n > 1) & (F.lower("_last") == F.lower(tail)))
    middle = F.slice("_parts", F.lit(2), F.greatest(n - 2, F.lit(0)))
    full = F.when(n == 1, F.col("_first")).otherwise(
        F.array_join(F.concat(F.array("_first"), middle, F.array("_last")), " ")
    )
    perturbed = F.when(~F.coalesce(clash, F.lit(True)), full)
    mappings = F.when(n == 1, F.array(F.struct(F.lit("first").alias("part"), F.col("_first").alias("perturbed"), head.alias("original")))).otherwise(
        F.array(
            F.struct(F.lit("first").alias("part"), F.col("_first").alias("perturbed"), head.alias("original")),
            F.struct(F.lit("last").alias("part"), F.col("_last").alias("perturbed"), tail.alias("original")),
        )
    )
    out = rows.select("session_id", "full_name", perturbed.alias("perturbed"), mappings.alias("part_mappings"))
    return out.withColumn("part_mappings", F.when(F.col("perturbed").isNotNull(), F.col("part_mappings")))


def perturb_email(value: Column, eps: Column, seed: str, names: list[str]) -> Column:
    """A plausible other address: name parts replaced, digits noised, a common domain."""
    choices = F.array(*[F.lit(n) for n in names])
    local = F.regexp_extract(value, "^(.*)@[^@]*$", 1)
    word = lambda p, i: F.when(
        F.rlike(p, F.lit(r"^\p{L}{3,}$")), F.lower(pick_other(choices, p, seed, i))
    ).otherwise(p)
    dotted = F.array_join(F.transform(F.split(local, r"\."), word), ".")
    letters, numbers = F.regexp_replace(local, r"[^\p{L}]", ""), F.regexp_replace(local, r"\D", "")
    mixed = F.concat(
        F.when(letters != "", F.lower(pick_other(choices, letters, seed))).otherwise(""),
        F.when(numbers != "", perturb_digits(numbers, eps, seed)).otherwise(""),
    )
    plain = F.rlike(local, F.lit(r"^\p{L}{3,}$"))
    new_local = F.when(F.contains(local, F.lit(".")), dotted).when(plain, F.lower(pick_other(choices, local, seed))).otherwise(mixed)
    domains = F.array(*[F.lit(d) for d in fixed.EMAIL_DOMAINS])
    domain = F.get(domains, F.floor(uniform(seed, value, F.lit("domain")) * len(fixed.EMAIL_DOMAINS)).cast("int"))
    return F.concat(new_local, F.lit("@"), domain)


def perturb_address(value: Column, eps: Column, seed: str, places: list[str]) -> Column:
    """Parts between commas: street number and name, postal code, or a place name."""
    choices = F.array(*[F.lit(p) for p in places])

    def street_word(w: Column, i: Column) -> Column:
        kept = F.rtrim(w, F.lit(".")).isin(*fixed.STREET_TYPES) | F.upper(w).isin(*fixed.STREET_DIRECTIONS)
        return F.when(kept, w).otherwise(pick_other(choices, w, seed, i))

    def part(p: Column, i: Column) -> Column:
        number, street = F.regexp_extract(p, r"^(\d+)\s+(.+)$", 1), F.regexp_extract(p, r"^(\d+)\s+(.+)$", 2)
        words = F.array_join(F.transform(F.split(street, r"\s+"), street_word), " ")
        return (
            F.when(number != "", F.concat(perturb_digits(number, eps, seed), F.lit(" "), words))
            .when(F.rlike(p, F.lit(r"^(\d+|\d{5}-\d{4})$")), perturb_digits(p, eps, seed))
            .otherwise(pick_other(choices, p, seed, i))
        )

    pieces = F.filter(F.transform(F.split(value, "[,;]"), lambda p: strip(p)), lambda p: p != "")
    return F.array_join(F.transform(pieces, part), ", ")
