"""Column expressions over text. Everything here stays inside Catalyst."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from mnemolake.functions import fixed

# Unicode white space and word characters spelled out: much faster than the engine's Unicode mode
SPACE = r"[\s\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: The same characters, for functions that take no pattern.
SPACES = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\u0085\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
WORD = r"[\p{L}\p{N}_]"


def unicode_regex(pattern: str) -> str:
    r"""A pattern whose ``\b \s \w \d`` know all of Unicode, on any Java version."""
    for short, full in ((r"\b", r"(?U:\b)"), (r"\s", SPACE), (r"\w", WORD), (r"\d", r"\p{Nd}")):
        pattern = pattern.replace(short, full)
    return pattern


def flat_loops(pattern: str) -> str:
    r"""The same matches without loops that recurse once per word: long runs of names would exhaust Java's stack.

    A run of words that nothing has to follow never gives words back, so its loop may be possessive. Where a word
    of a list has to follow, the run goes on from one place before such a word to the next; it ends at the last
    one, as the greedy loop does by giving words back. Where such a run opens the pattern, no match begins at a
    later letter or word of a run that had none, so these places are passed over.
    """
    def flat(m: re.Match) -> str:
        word, after = m.group(1), m.group(2)
        if after is None:
            return rf"{word}(?:\s+{word})*+"
        stretch = rf"{word}(?:(?!{after})\s+{word})*+(?={after})"
        return rf"{stretch}(?:\s+{stretch})*+){after}"

    pattern = re.sub(r"(\[A-Z\]\[[A-Za-z-]+\][+*])\(\?:\\s\+\1\)\*(?:\)(\\s\+\(\?:[^()]*\)))?", flat, pattern)
    if pattern.startswith("([A-Z]") and "(?!" in pattern:
        pattern = r"(?=[A-Z])(?<![A-Z][A-Za-z]{0,40}\s{0,1})" + pattern
    # parts of identifiers: a border never lies inside them
    return re.sub(r"(\(\?:(?:_|\[A-Z\])\[a-z\]\+\)\+)(\\b)", r"\1+\2", pattern)


def required_words(pattern: str) -> list[str]:
    """Lowercase literals of which a match must contain one; empty if the pattern names none."""
    group = re.search(r"\((?:\?:)?([A-Za-z :'|-]{4,})\)(?![?*{])", pattern)
    if group and "|" not in pattern.replace(group.group(), ""):
        words = [w.lower() for w in group.group(1).split("|")]
    elif "(" not in pattern:
        heads = [re.match(r"(?:\\b)?([a-z:,-]{2,})(?![?*{])", part) for part in pattern.split("|")]
        words = [h.group(1) if h else "" for h in heads]
    else:
        words = [""]
    if "" in words:
        return []
    return [w for w in words if not any(o != w and o in w for o in words)]


def _parts(pattern: str, low: int, ends: str) -> tuple[list[tuple[int, int]], int]:
    """The alternatives of a pattern from one place on, as spans, and where they end."""
    parts, begin, i, depth = [], low, low, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif c == "[":
            i = _class_end(pattern, i)
        elif c == "(":
            depth += 1
        elif c == ")" and depth:
            depth -= 1
        elif not depth and c in ends:
            break
        elif not depth and c == "|":
            parts.append((begin, i))
            begin = i + 1
        i += 1
    return [*parts, (begin, i)], i


def _class_end(pattern: str, i: int) -> int:
    """Place of the bracket that closes a class without classes inside."""
    i += 2 if pattern[i + 1] == "^" else 1
    while pattern[i] != "]":
        i += 2 if pattern[i] == "\\" else 1
    return i


def first_class(pattern: str) -> str | None:
    """What a match can begin with, as the inside of a character class; None where that cannot be told easily."""
    def of(low: int, high: int) -> str | None:
        while pattern.startswith(r"\b", low):
            low += 2
        if low >= high:
            return None
        c = pattern[low]
        if c == "(":
            opened = low + (3 if pattern.startswith("(?:", low) else 1)
            if pattern[opened] == "?":
                return None
            spans, end = _parts(pattern, opened, ")")
            inner = [of(*span) for span in spans]
            found = None if None in inner else "".join(dict.fromkeys(inner))
        elif c == "[":
            end = _class_end(pattern, low)
            found = None if pattern[low + 1] == "^" else pattern[low + 1 : end]
        elif c == "\\":
            end = low + 1
            after = pattern[end]
            found = {"d": r"\p{Nd}"}.get(after, None if after.isalnum() else "\\" + after)
        else:
            end, found = low, c if c.isalnum() or c in "@#_`" else None
        return None if pattern.startswith(("?", "*", "{0"), end + 1) else found

    found = [of(*span) for span in _parts(pattern, 0, "")[0]]
    return None if None in found else "".join(dict.fromkeys(found))


def _ready(pattern: str, ignore_case: bool, loops: bool = False) -> Column:
    """The pattern as the engine gets it: a look at the first character spares most places the costly word borders."""
    first = first_class(pattern)
    flat = flat_loops(pattern) if loops else pattern
    ahead = f"(?=[{first}])" if first and not flat.startswith("(?=") else ""
    return F.lit(("(?i)" if ignore_case else "") + ahead + unicode_regex(flat))


#: Stands for any decimal digit among the words that a match needs.
DIGIT = "0"
#: Behind the end of a word: it stands before a capital letter. No lowercased word has this.
BEFORE_CAPITAL = " A"


def needed(pattern: str) -> list[list[str]]:
    """What a match must contain in lowercase: of every list at least one word. ``DIGIT`` is any decimal digit."""
    op = re._constants

    def of(items) -> list[list[str]]:
        sets, run = [], ""

        def close() -> None:
            nonlocal run
            if run:
                sets.append([run])
            run = ""

        for kind, value in items:
            if kind is op.LITERAL:
                run += chr(value).lower()
                continue
            if kind is op.AT:
                continue
            close()
            if kind is op.SUBPATTERN:
                sets.extend(of(value[-1]))
            elif kind is op.MAX_REPEAT and value[0] > 0:
                sets.extend(of(value[2]))
            elif kind is op.IN and value == [(op.CATEGORY, op.CATEGORY_DIGIT)]:
                sets.append([DIGIT])
            elif kind is op.BRANCH:
                each = [max(of(part), key=lambda words: min(map(len, words)), default=[]) for part in value[1]]
                if all(each):
                    sets.append([w for words in each for w in words])
        close()
        return sets

    # a word that contains another one of its list need not be asked for
    lists = [sorted({w for w in words if not any(o != w and o in w for o in words)}) for words in of(re._parser.parse(pattern))]
    return [words for words in lists if DIGIT in words or min(map(len, words)) > 1 or not any(w.isalnum() or w.isspace() for w in words)]


def has_match(
    text: Column, pattern: str, ignore_case: bool = False, low: Column | None = None, seen: Words | None = None
) -> Column:
    """Whether a pattern matches somewhere. A plain substring test runs first where the pattern allows it."""
    hit = F.rlike(text, _ready(pattern, ignore_case))
    if seen is not None:
        return reduce(lambda a, b: a & b, [*map(seen.any, needed(pattern)), hit])
    words = required_words(pattern)
    if not words:
        return F.rlike(text, F.lit(r"\p{Nd}")) & hit if r"\d" in pattern and "|" not in pattern else hit
    low = F.lower(text) if low is None else low
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words]) & hit


def find_all(
    text: Column, pattern: str, group: int = 0, ignore_case: bool = False, low: Column | None = None, seen: Words | None = None
) -> Column:
    """All matches of a pattern (or of one group), first to last."""
    found = F.regexp_extract_all(text, _ready(pattern, ignore_case, True), F.lit(group))
    words = required_words(pattern)
    if seen is not None:
        tests = [seen.any(words) for words in needed(pattern)]
        if not tests:
            return found
        some = reduce(lambda a, b: a & b, tests)
        if not words and r"\d" not in pattern:  # null for a null text
            return F.when(~some, F.array().cast("array<string>")).otherwise(found)
    elif words:
        some = reduce(lambda a, b: a | b, [F.contains(F.lower(text) if low is None else low, F.lit(w)) for w in words])
    elif r"\d" in pattern:
        some = F.rlike(text, F.lit(r"\p{Nd}"))
    else:
        return found
    return F.when(some, found).otherwise(F.array().cast("array<string>"))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once.

    For values used several times, or inside another lambda: the optimizer merges projections, so a column
    defined one step earlier may end up computed for every element of an array.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(text: Column) -> Column:
    """Lowercased runs of ASCII letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def match_spans(text: Column, pattern: str) -> Column:
    """All matches of a pattern that matches no empty text, as an array of (start, end, value); null texts have none."""
    kind = "struct<pos:int,out:array<struct<start:int,end:int,value:string>>>"
    pairs = F.zip_with(
        F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p, m: F.struct(F.length(p).alias("before"), m.alias("m"))
    )

    def step(acc, x):
        start = acc["pos"] + x["before"]
        end = start + F.length(x["m"])
        return F.struct(
            end.alias("pos"), F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end"), x["m"].alias("value"))).alias("out")
        ).cast(kind)

    zero = F.struct(F.lit(0).alias("pos"), F.array().alias("out")).cast(kind)
    return F.aggregate(F.filter(pairs, lambda x: x["m"].isNotNull()), zero, step)["out"]


def query_terms(text: Column, stop_words=fixed.STOP_WORDS_REASONING) -> Column:
    """Distinct tokens of three or more characters that are no stop words, first seen first."""
    stop = F.array(*[F.lit(w) for w in sorted(stop_words)])
    return F.array_distinct(
        F.filter(tokens(text), lambda t: (F.length(t) >= 3) & ~F.array_contains(stop, t))
    )


def long_terms(text: Column) -> Column:
    """Distinct tokens of three or more characters."""
    return F.array_distinct(F.filter(tokens(text), lambda t: F.length(t) >= 3))


def collapse_ws(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def strip(text: Column) -> Column:
    """Trim every kind of white space, not just blanks."""
    return F.btrim(text, F.lit(SPACES))


def preview(text: Column, limit: int, keep: int | None = None) -> Column:
    """One-line preview: collapse white space, cut to ``keep`` characters and add dots."""
    keep = limit - 3 if keep is None else keep
    return let(
        collapse_ws(F.coalesce(text, F.lit(""))),
        lambda flat: F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, keep)), F.lit("..."))),
    )


def clean_excerpt(text: Column, limit: int = 700) -> Column:
    return preview(text, limit, limit - 1)


def slug(label: Column, limit: int = 80) -> Column:
    flat = F.substring(F.regexp_replace(F.regexp_replace(F.lower(label), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, limit)
    return F.when(flat == "", F.lit("unknown")).otherwise(flat)


def title_case(label: Column) -> Column:
    return F.initcap(label)


def sentences(text: Column) -> Column:
    """Split after . ! or ? followed by white space."""
    return F.split(text, f"(?<=[.!?]){SPACE}+")


def lowered(df, text: str = "text", name: str = "_low"):
    """Add the lowercased text as a column of its own, so many tests share one conversion."""
    return df.withColumn(name, F.lower(text))


def stem(word: Column) -> Column:
    """First suffix rule that fits; words of up to three characters stay as they are.

    The rules are one literal map from suffix to (place, length, replacement): a word looks up its endings
    of every length in use and takes the earliest rule.
    """
    first = {}
    for place, (suffix, replacement) in enumerate(fixed.STEM_RULES):
        first.setdefault(suffix, (place, replacement))
    entries = []
    for suffix, (place, replacement) in first.items():
        rule = F.struct(
            F.lit(place).alias("place"), F.lit(len(suffix)).alias("size"), F.lit(replacement).alias("replacement")
        )
        entries += [F.lit(suffix), rule]
    rules = F.create_map(*entries)
    sizes = sorted({len(s) for s in first})
    found = F.array_min(
        F.array(*[F.when(F.length(word) > n + 1, rules[F.right(word, F.lit(n))]) for n in sizes])
    )
    cut = F.concat(F.left(word, F.length(word) - found["size"]), found["replacement"])
    return F.when((F.length(word) <= 3) | found.isNull(), word).otherwise(cut)


def count_hits(text: Column, words, seen: Words | None = None) -> Column:
    """How many of the words occur in the text as substrings."""
    if seen is not None:
        return F.size(F.array_intersect(seen.found, seen.listed(words)))
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(w)).cast("int") for w in words])


class Words:
    """Words that expressions ask for, all looked up in a text at once.

    Build the expressions first, then add the column that lists the words which occur as substrings of the lowercased
    text: with ``add``, or with another function of the texts that calls ``finder()``.
    """

    def __init__(self, name: str = "_seen"):
        self.name, self.asked = name, set()

    @property
    def found(self) -> Column:
        return F.col(self.name)

    def listed(self, words) -> Column:
        self.asked.update(words)
        return F.array(*[F.lit(w) for w in dict.fromkeys(words)])

    def any(self, words) -> Column:
        return F.arrays_overlap(self.found, self.listed(words))

    def before_capital(self, ends) -> Column:
        """A word with one of these ends stands before white space and a capital letter."""
        return self.any([end + BEFORE_CAPITAL for end in ends])

    def finder(self) -> WordFinder:
        return WordFinder(self.asked)

    def add(self, df):
        finder = self.finder()

        @F.pandas_udf("array<string>")
        def seen(texts: pd.Series, lows: pd.Series) -> pd.Series:
            return pd.Series([None if t is None else finder(t, low) for t, low in zip(texts, lows)], dtype=object)

        return df.withColumn(self.name, seen("text", "_low"))


class WordFinder:
    """The given words that a lowercased text contains.

    A look at three bytes at a time tells which beginnings and ends of words occur; only words with both are searched.
    """

    def __init__(self, words):
        self.words = sorted(w for w in words if w != DIGIT and not w.endswith(BEFORE_CAPITAL))
        self.ends = tuple(sorted(w.removesuffix(BEFORE_CAPITAL) for w in words if w.endswith(BEFORE_CAPITAL)))
        long = [w for w in self.words if len(w) > 2 and w.isascii()]
        self.short = [w for w in self.words if w not in long]
        self.ids = {part: i for i, part in enumerate(sorted({part for w in long for part in (w[:3], w[-3:])}), 1)}
        self.long = [(w, self.ids[w[:3]], self.ids[w[-3:]]) for w in long]
        self.table = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}

    def __call__(self, text: str, low: str) -> list[str]:
        if self.table is None:
            self.table = np.zeros(1 << 24, dtype=np.uint16)
            for part, i in self.ids.items():
                self.table[int.from_bytes(part.encode(), "big")] = i
        data = np.frombuffer(low.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        here = np.zeros(len(self.ids) + 1, dtype=bool)
        if len(data) > 2:
            wide = data.astype(np.uint32)
            here[self.table[(wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]]] = True
        here = here.tolist()
        found = [w for w in self.short if w in low]
        found += [w for w, first, last in self.long if here[first] and here[last] and w in low]
        if _ANY_DIGIT.search(low):
            found.append(DIGIT)
        if self.ends:
            words = text.split()
            before = {a for a, b in zip(words, words[1:]) if "A" <= b[0] <= "Z" and a.endswith(self.ends)}
            found += [end + BEFORE_CAPITAL for end in self.ends if any(a.endswith(end) for a in before)]
        return found


_ANY_DIGIT = re.compile(r"\d")


def two_match(text: Column, patterns, low: Column, seen: Words | None = None) -> Column:
    """At least two of two or three patterns match; the rarer later ones are tried first."""
    hits = [has_match(text, p, low=low, seen=seen) for p in reversed(patterns)]
    if len(hits) == 2:
        return hits[0] & hits[1]
    a, b, c = hits
    return F.when(a, b | c).otherwise(b & c)


def any_match(text: Column, patterns, low: Column, seen: Words | None = None) -> Column:
    return reduce(lambda a, b: a | b, [has_match(text, p, low=low, seen=seen) for p in patterns])


def first_text(*values: Column) -> Column:
    """First value that is not blank, trimmed; empty text if there is none."""
    return F.coalesce(*[F.nullif(strip(v.cast("string")), F.lit("")) for v in values], F.lit(""))


def glob_to_regex(pattern: str) -> str:
    """File-name pattern (``*``, ``?``, ``[...]``) as an anchored regular expression."""
    import fnmatch

    return "(?s)^" + fnmatch.translate(pattern).removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z") + "$"


def safe_concept_label(label: Column) -> Column:
    """Label that may show up in a cited-evidence graph."""
    return let(
        strip(label),
        lambda text: F.coalesce(
            F.length(text).between(3, 120)
            & ~F.rlike(F.lower(text), F.lit("pii_session_id|piisessionid"))
            & ~F.contains(text, F.lit("@"))
            & ~has_match(text, r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b")
            & F.rlike(text, F.lit("[a-zA-Z]")),
            F.lit(False),
        ),
    )


def safe_entity_label(label: Column) -> Column:
    """Label that may show up in an entity graph: no mail, phone, card or long number shapes."""
    text = strip(label)
    bracketed = F.startswith(text, F.lit("[")) & F.endswith(text, F.lit("]"))
    return F.coalesce(
        F.length(text).between(2, 100)
        & ~F.rlike(F.lower(text), F.lit("pii_session_id|piisessionid"))
        & ~F.contains(text, F.lit("@"))
        & ~F.rlike(text, F.lit(r"\b\d{3}[-.\s]?\d{2}[-.\s]?\d{4}\b"))
        & ~F.rlike(text, F.lit(r"\(\d{3}\)\s*\d{3}-\d{4}"))
        & ~F.rlike(text, F.lit(r"\b(?:\d{4}[-\s]){2,4}\d{3,4}\b"))
        & ~F.rlike(text, F.lit(r"\b\d{6,}\b"))
        & ~(bracketed & ~F.contains(F.upper(text), F.lit("PERSON")))
        & F.rlike(text, F.lit("[a-zA-Z]")),
        F.lit(False),
    )


def infer_entity_type(label: Column) -> Column:
    """Type of a free entity label; null means: leave it out (unsafe or a likely person)."""
    low = F.lower(strip(label))
    has = lambda words: F.rlike(low, F.lit("|".join(words)))
    return (
        F.when(~safe_entity_label(label), F.lit(None).cast("string"))
        .when(has(fixed.ORGANIZATION_MARKS), F.lit("organization"))
        .when(has(fixed.TECHNOLOGY_MARKS), F.lit("technology"))
        .when(F.rlike(label, F.lit(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3}\b")), F.lit(None).cast("string"))
        .otherwise(F.lit("named_entity"))
    )
