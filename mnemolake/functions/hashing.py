"""Stable ids and hashes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from mnemolake.functions.text import collapse_ws


def content_hash(text: Column, source: Column) -> Column:
    """sha256 over ``source:text``; over the text alone when there is no source."""
    src = F.coalesce(source, F.lit(""))
    return F.sha2(F.when(src == "", text).otherwise(F.concat(src, F.lit(":"), text)), 256)


def body_text(text: Column, title: Column) -> Column:
    """The text, or the title when the text is empty."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.coalesce(title, F.lit(""))).otherwise(text)


def fingerprint(text: Column, title: Column) -> Column:
    """sha256 over the lowercased one-line text, or title when the text is empty. Never null."""
    return F.coalesce(F.sha2(collapse_ws(F.lower(body_text(text, title))), 256), F.lit(""))


def short_hash(value: Column, length: int) -> Column:
    return F.left(F.sha2(value, 256), F.lit(length))


def stable_id(kind, doc_ids: Column, query: Column) -> Column:
    """``kind:`` and 12 hex digits over kind, comma-joined ids and query."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    seed = F.concat(kind, F.lit(":"), doc_ids, F.lit(":"), query)
    return F.concat(kind, F.lit(":"), short_hash(seed, 12))


def uniform(seed: str, *parts: Column) -> Column:
    """Repeatable number in (0, 1) from a caller's secret and the parts of a row."""
    text = F.concat_ws("\u001f", F.lit(seed), *[p.cast("string") for p in parts])
    head = F.conv(F.left(F.md5(text), F.lit(12)), 16, 10).cast("double")
    return (head + 0.5) / float(16**12)


def laplace(scale: Column, u: Column) -> Column:
    """Laplace noise by inverting the distribution function at ``u``."""
    centred = u - 0.5
    return -scale * F.signum(centred) * F.log(1.0 - 2.0 * F.abs(centred))


def gumbel(u: Column) -> Column:
    return -F.log(-F.log(u))
