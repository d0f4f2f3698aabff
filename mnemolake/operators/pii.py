"""Find personal data, replace it by tokens and bring it back.

Detection runs in Arrow batches and yields the spans of a text as one array; everything after it (overlaps,
tokens, rebuilding a text) is column expressions inside the row. Tokens come from a keyed hash of type and
value, so the same value gets the same token everywhere without a shuffle.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from mnemolake.functions import fixed
from mnemolake.functions.text import WORD, collapse_ws, unicode_regex

SPAN = "struct<pii_type:string,start:int,end:int,score:double,value:string>"
TOKEN_PATTERN = "<PII:[A-Z_]+:[0-9a-f]+>"
NOTICE = "[PII protection unavailable: content withheld]"


def patterns(types=None, min_score: float = 0.0, extra=()) -> list[tuple[str, str, float]]:
    """Patterns for the wanted types (a preset name or a list), plus the caller's own rows."""
    wanted = fixed.PII_PRESETS.get(types, None) if isinstance(types, str) else types
    rows = [*fixed.PII_PATTERNS, *extra]
    return [r for r in rows if (wanted is None or r[0] in wanted) and r[2] >= min_score]


def luhn_valid(number: str) -> bool:
    digits = [int(c) for c in number if c.isdigit()]
    doubled = [d * 2 - 9 if d > 4 else d * 2 for d in digits[-2::-2]]
    return (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0


def span_finder(rules: list[tuple[str, str, float]]):
    """A pandas UDF from texts to arrays of spans."""

    @F.pandas_udf(f"array<{SPAN}>")
    def find(texts: pd.Series) -> pd.Series:
        compiled = [(kind, re.compile(p), score) for kind, p, score in rules]

        def spans(text):
            found = []
            for kind, rx, score in compiled:
                for m in rx.finditer(text or ""):
                    if kind == "CREDIT_CARD" and not luhn_valid(m.group()):
                        continue
                    found.append({"pii_type": kind, "start": m.start(), "end": m.end(), "score": score, "value": m.group()})
            return found

        return texts.map(spans)

    return find


def detect_pii(docs: DataFrame, types=None, min_score: float = 0.0, extra=()) -> DataFrame:
    """Add ``spans``. Texts without any match never leave the JVM: a native test comes first."""
    rules = patterns(types, min_score, extra)
    # every built-in pattern needs a digit, an @ or a ://, but for vehicle numbers of letters alone; the caller's own
    # patterns are tested themselves
    tests = ["[0-9@]|://|[A-HJ-NPR-Z]{17}"] + [f"(?:{p})" for _, p, _ in extra]
    maybe = F.rlike("text", F.lit("|".join(tests)))
    none = F.array().cast(f"array<{SPAN}>")
    find = span_finder(rules)
    marked = docs.withColumn("_maybe", F.coalesce(maybe, F.lit(False)))
    hit = marked.filter("_maybe").drop("_maybe").withColumn("spans", find(F.col("text")))
    rest = marked.filter("not _maybe").drop("_maybe").withColumn("spans", none)
    return hit.unionByName(rest)


def span_table(detected: DataFrame) -> DataFrame:
    rows = detected.select("doc_id", F.explode_outer("spans").alias("s")).filter(F.col("s").isNotNull())
    return rows.select("doc_id", "s.*")


def resolve_overlaps(spans: Column) -> Column:
    """Best spans first (score, then length, then place); a span that overlaps a kept one is dropped."""
    ranked = F.array_sort(
        F.transform(
            spans,
            lambda s: F.struct(
                (-s["score"]).alias("a"), (s["start"] - s["end"]).alias("b"), s["start"].alias("c"), s["pii_type"].alias("d"),
                s.alias("s"),
            ),
        )
    )
    kept = F.aggregate(
        ranked,
        F.array().cast(f"array<{SPAN}>"),
        lambda acc, x: F.when(
            F.exists(acc, lambda k: (k["start"] < x["s"]["end"]) & (x["s"]["start"] < k["end"])), acc
        ).otherwise(F.array_append(acc, x["s"])),
    )
    return kept


def rebuild(text: Column, spans: Column, replacement) -> Column:
    """The text with every span replaced by ``replacement(span)``; spans must not overlap."""
    kind = "struct<pos:int,out:string>"
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("at"), s.alias("s"))))
    done = F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")).cast(kind),
        lambda acc, x: F.struct(
            x["s"]["end"].alias("pos"),
            F.concat(
                acc["out"], F.substring(text, acc["pos"] + 1, x["s"]["start"] - acc["pos"]), replacement(x["s"])
            ).alias("out"),
        ).cast(kind),
    )
    return F.concat(done["out"], F.substring(text, done["pos"] + 1, F.length(text)))


def rebuild_matches(text: Column, pattern: str, replacement) -> Column:
    """The text with every match of a pattern replaced by ``replacement(match)``."""
    # zip_with computes both arrays once per text; looking one up inside a lambda would compute it per element
    parts, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    joined = F.zip_with(parts, found, lambda p, m: F.when(m.isNull(), p).otherwise(F.concat(p, replacement(m))))
    return F.array_join(joined, "")


def normalized_value(value: Column) -> Column:
    return F.lower(collapse_ws(value))


def token(secret: str, session: Column, kind: Column, value: Column) -> Column:
    """``<PII:TYPE:id>``; the id is a keyed hash of session, type and normalized value."""
    seed = F.concat_ws("\u001f", F.lit(secret), session.cast("string"), kind, normalized_value(value))
    return F.concat(F.lit("<PII:"), kind, F.lit(":"), F.left(F.sha2(seed, 256), F.lit(16)), F.lit(">"))


def anonymize(detected: DataFrame, secret: str, session: Column, keep=None, on_error: str = "notice") -> DataFrame:
    """Replace spans by tokens: adds ``anonymized``, ``token_count``, ``types`` and ``replaced`` (the spans).

    ``keep(span)`` is a condition for spans that stay readable (consent). Rows whose ``failed`` column is
    true lose their text (``on_error='notice'``) unless the caller opens them (``'open'``).
    """
    rows = detected.withColumn("replaced", resolve_overlaps(F.col("spans")))
    if keep is not None:
        rows = rows.withColumn("replaced", F.filter("replaced", lambda s: ~keep(s)))
    text = rebuild(F.col("text"), F.col("replaced"), lambda s: token(secret, session, s["pii_type"], s["value"]))
    if "failed" in rows.columns:
        shown = F.lit(NOTICE) if on_error == "notice" else F.col("text")
        text = F.when(F.col("failed"), shown).otherwise(text)
        rows = rows.withColumn("replaced", F.when(F.col("failed"), F.slice("replaced", 1, 0)).otherwise(F.col("replaced")))
    return rows.select(
        "*",
        text.alias("anonymized"),
        F.size("replaced").alias("token_count"),
        F.array_sort(F.array_distinct(F.transform("replaced", lambda s: s["pii_type"]))).alias("types"),
    )


def consent_keep(exposed=()):
    """Condition for spans that consent leaves readable; critical types never are."""
    open_types = sorted(set(exposed) - set(fixed.CRITICAL_PII_TYPES))
    return lambda s: s["pii_type"].isin(*open_types) if open_types else F.lit(False)


def build_token_dictionary(anonymized: DataFrame, secret: str, session: Column) -> DataFrame:
    """One row per token: session, type, first original value, number of places."""
    rows = anonymized.select("doc_id", session.alias("session_id"), F.explode_outer("replaced").alias("s"))
    rows = rows.filter(F.col("s").isNotNull()).select("doc_id", "session_id", "s.*")
    named = rows.withColumn("token", token(secret, F.col("session_id"), F.col("pii_type"), F.col("value")))
    return named.groupBy("session_id", "pii_type", "token").agg(
        F.min_by("value", F.struct("doc_id", "start")).alias("original"), F.count("*").alias("uses")
    )


def stack_columns(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Several text columns of a row as rows (doc_id, field, text), to be anonymized with one dictionary."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in columns]))
    return docs.select("doc_id", pairs.alias("p")).select("doc_id", "p.field", "p.text")


def deanonymize(texts: DataFrame, dictionary: DataFrame, sessions: DataFrame | None = None, as_of: str | None = None) -> DataFrame:
    """Put originals back for every known token: adds ``restored``, ``unknown_tokens`` and ``status``.

    ``texts`` has (row_id, session_id, text). ``sessions`` (session_id, optional expires_at) lists the open
    sessions, those of the dictionary by default; missing ones and those past ``as_of`` restore nothing.
    """
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(TOKEN_PATTERN), F.lit(0)))
    rows = texts.withColumn("tokens", found)
    if sessions is None:
        sessions = dictionary.select("session_id").distinct()
    live = F.lit(True)
    if as_of and "expires_at" in sessions.columns:
        live = F.col("expires_at") >= F.lit(as_of).cast("timestamp")
    sessions = sessions.select("session_id", live.alias("_live"))
    j = rows.join(sessions, "session_id", "left")
    asked = j.filter(F.col("_live")).select("row_id", "session_id", F.explode_outer("tokens").alias("token"))
    known = asked.filter(F.col("token").isNotNull()).join(
        dictionary.select("session_id", "token", "original"), ["session_id", "token"]
    )
    maps = known.groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("token", "original"))).alias("m"))
    j = j.join(maps, "row_id", "left")
    value = lambda tok: F.coalesce(F.when(F.col("m").isNotNull(), F.col("m")[tok]), tok)
    return j.select(
        "row_id",
        "session_id",
        rebuild_matches(F.col("text"), TOKEN_PATTERN, value).alias("restored"),
        (F.size("tokens") - F.when(F.col("m").isNull(), 0).otherwise(F.size("m"))).alias("unknown_tokens"),
        F.when(F.col("_live").isNull(), "missing_session").when(~F.col("_live"), "expired_session").otherwise("ok").alias("status"),
    )


def deanonymize_perturbed(texts: DataFrame, mappings: DataFrame) -> DataFrame:
    """Swap perturbed values back, longest first, whole words, any case; phones with any separators.

    ``texts`` (row_id, session_id, text); ``mappings`` (session_id, pii_type, perturbed, original) with name
    parts as rows of their own. Mappings meet a text through an equi-join on its words (phones: on its digit
    runs), so a text only gathers mappings whose first word it contains.
    """
    digits = lambda c: F.regexp_replace(c, r"\D", "")
    words = F.regexp_extract_all(F.lower("text"), F.lit(WORD + "+"), F.lit(0))
    runs = F.transform(F.regexp_extract_all("text", F.lit(r"\d[\d\s\-.()]{5,}\d"), F.lit(0)), digits)
    keys = texts.select("row_id", "session_id", F.explode(F.array_distinct(F.concat(words, runs))).alias("key"))
    phone = (F.col("pii_type") == "PHONE_NUMBER") & (F.length(digits(F.col("perturbed"))) >= 7)
    flexible = F.concat(
        F.lit(r"[+(]?"), F.array_join(F.split(digits(F.col("perturbed")), ""), r"[\s\-.()]*"), F.lit(r"\)?")
    )
    exact = F.concat(F.lit(r"(?i)(?U:\b)\Q"), "perturbed", F.lit(r"\E(?U:\b)"))
    m = mappings.select(
        "session_id",
        F.when(phone, digits(F.col("perturbed")))
        .otherwise(F.regexp_extract(F.lower("perturbed"), WORD + "+", 0))
        .alias("key"),
        F.struct(
            (-F.length("perturbed")).alias("order"), F.col("perturbed").alias("p"),
            F.when(phone, flexible).otherwise(exact).alias("pattern"),
            F.regexp_replace("original", r"([\\$])", r"\\$1").alias("by"),
        ).alias("m"),
    )
    met = keys.join(m, ["session_id", "key"]).groupBy("row_id").agg(F.array_sort(F.collect_set("m")).alias("ms"))
    j = texts.join(met, "row_id", "left")
    restored = F.aggregate("ms", F.col("text"), lambda acc, x: F.regexp_replace(acc, x["pattern"], x["by"]))
    return j.select("row_id", "session_id", F.when(F.col("ms").isNull(), F.col("text")).otherwise(restored).alias("restored"))


def redact_fixed(text: Column, extra=()) -> Column:
    """Ordered redactions to fixed labels; ``extra`` rows (pattern, label) run first."""
    for pattern, label in (*extra, *fixed.REDACTIONS):
        text = F.regexp_replace(text, unicode_regex(pattern), label)
    return text


def redact_count_keys(counts: DataFrame, key: str = "key") -> DataFrame:
    """Redact group keys, then add up the counts of keys that became equal."""
    return counts.groupBy(redact_fixed(F.col(key)).alias(key)).agg(F.sum("n").alias("n"))


def pii_stats(decided: DataFrame) -> DataFrame:
    """Totals over decided values: anonymized, exposed, types and persons."""
    return decided.agg(
        F.count_if("anonymize").alias("anonymized"),
        F.count_if(~F.col("anonymize")).alias("exposed"),
        F.array_sort(F.collect_set("pii_type")).alias("types"),
        F.count_if(F.col("pii_type") == "PERSON").alias("persons"),
    )


def mark_values(rows: DataFrame) -> DataFrame:
    """Add ``marks``: where the values of a row occur in its text, longest first, never overlapping."""

    @F.pandas_udf("array<struct<start:int,end:int,value:string>>")
    def find(texts: pd.Series, values: pd.Series) -> pd.Series:
        def marks(text, wanted):
            names = sorted({v for v in (wanted if wanted is not None else []) if v}, key=lambda v: (-len(v), v))
            if not text or not names:
                return []
            rx = re.compile("|".join(re.escape(v) for v in names), re.IGNORECASE)
            return [{"start": m.start(), "end": m.end(), "value": m.group()} for m in rx.finditer(text)]

        return pd.Series([marks(a, b) for a, b in zip(texts, values)])

    return rows.withColumn("marks", find("text", "values"))
