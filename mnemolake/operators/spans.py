"""Personal data in transcripts and scanned pages: from character spans to times and boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mnemolake.operators.pii import rebuild_matches

DIGIT_GROUPS = r"\b(?:\d{1,4}\s+){2,}\d{1,4}\b"


def normalize_digit_groups(text: Column) -> Column:
    """Join space-separated digit groups when together they have 9 to 19 digits."""

    def joined(match: Column) -> Column:
        digits = F.regexp_replace(match, r"\s+", "")
        return F.when(F.length(digits).between(9, 19), digits).otherwise(match)

    return rebuild_matches(text, DIGIT_GROUPS, joined)


def digit_group_map(text: Column) -> Column:
    """Array of (norm_start, norm_end, orig_start, orig_end) for every joined run."""
    kind = "struct<at:int,shift:int,out:array<struct<norm_start:int,norm_end:int,orig_start:int,orig_end:int>>>"
    parts, found = F.split(text, DIGIT_GROUPS, -1), F.regexp_extract_all(text, F.lit(DIGIT_GROUPS), F.lit(0))
    zero = F.struct(
        F.lit(0).alias("at"), F.lit(0).alias("shift"),
        F.array().cast("array<struct<norm_start:int,norm_end:int,orig_start:int,orig_end:int>>").alias("out"),
    ).cast(kind)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        n = F.length(F.regexp_replace(x["m"], r"\s+", ""))
        fits = n.between(9, 19)
        row = F.struct(
            (start + acc["shift"]).alias("norm_start"), (start + acc["shift"] + n).alias("norm_end"),
            start.alias("orig_start"), end.alias("orig_end"),
        )
        return F.struct(
            end.alias("at"),
            F.when(fits, acc["shift"] + n - F.length(x["m"])).otherwise(acc["shift"]).alias("shift"),
            F.when(fits, F.array_append(acc["out"], row)).otherwise(acc["out"]).alias("out"),
        ).cast(kind)

    pairs = F.zip_with(parts, found, lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    return F.aggregate(F.filter(pairs, lambda x: x["m"].isNotNull()), zero, step)["out"]


def spans_to_time(spans: DataFrame, words: DataFrame, width: int = 64) -> DataFrame:
    """Time range of character spans: start of the first to end of the last overlapping word.

    ``spans`` (doc_id, span_id, start, end), ``words`` (doc_id, char_start, char_end, time_start, time_end).
    Both sides are cut into stretches of ``width`` characters and meet by equi-join, so a span only sees
    words near it. Spans without a word get the whole recording.
    """
    stretch = lambda a, b: F.sequence(F.floor(a / width).cast("long"), F.floor((F.greatest(b, a + 1) - 1) / width).cast("long"))
    s = spans.select("doc_id", "span_id", "start", "end", F.explode(stretch(F.col("start"), F.col("end"))).alias("b"))
    w = words.select("*", F.explode(stretch(F.col("char_start"), F.col("char_end"))).alias("b"))
    overlap = (F.col("char_start") < F.col("end")) & (F.col("char_end") > F.col("start"))
    met = s.join(w, ["doc_id", "b"]).filter(overlap)
    found = met.groupBy("doc_id", "span_id").agg(
        F.min("time_start").alias("_start"), F.max("time_end").alias("_end"), F.count_distinct("char_start").alias("words")
    )
    whole = words.groupBy("doc_id").agg(F.min("time_start").alias("_first"), F.max("time_end").alias("_last"))
    out = spans.join(found, ["doc_id", "span_id"], "left").join(whole, "doc_id", "left")
    return out.select(
        "doc_id",
        "span_id",
        F.coalesce("_start", "_first", F.lit(0.0)).alias("start_time"),
        F.coalesce("_end", "_last", F.lit(0.0)).alias("end_time"),
        F.coalesce("words", F.lit(0)).alias("words"),
    )


def redact_transcript(text: Column, regions: Column) -> Column:
    """Replace the originals of all regions by their labels, longest first.

    ``regions`` is an array of (original, replacement). Every place of an original is replaced, so a value
    that is said twice cannot stay readable.
    """
    ordered = F.array_sort(F.transform(
        regions, lambda r: F.struct((-F.length(r["original"])).alias("n"), r["original"].alias("o"), r["replacement"].alias("r"))
    ))
    return F.aggregate(F.filter(ordered, lambda x: x["n"] < 0), text, lambda acc, x: F.replace(acc, x["o"], x["r"]))


def spans_to_boxes(rows: DataFrame, full_box: bool = False, buffer: float = 0.3) -> DataFrame:
    """Box of a span inside a text box: the whole box, or its share of the width with a small margin.

    ``rows`` has text, x, y, width, height, start and end.
    """
    n = F.length("text")
    whole = F.lit(full_box) | (n == 0)
    left = F.col("x") + F.floor(F.col("width") * F.col("start") / n)
    wide = F.floor(F.col("width") * ((F.col("end") - F.col("start")) / n))
    margin = F.floor(F.col("width") / n * buffer)
    px = F.greatest(F.col("x"), left - margin)
    right = F.least(F.col("x") + F.col("width"), px + wide + 2 * margin)
    return rows.select(
        *[c for c in rows.columns if c not in ("text", "x", "y", "width", "height")],
        F.when(whole, F.col("x")).otherwise(px).cast("long").alias("box_x"),
        F.col("y").alias("box_y"),
        F.when(whole, F.col("width")).otherwise(right - px).cast("long").alias("box_width"),
        F.col("height").alias("box_height"),
    )
