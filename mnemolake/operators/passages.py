"""Key passages, keyword topics and name counts of one text, in plain Python.

The same results as the expressions in ``enrich`` give for their tables, but a text is gone through once and nothing is
exploded, joined or shuffled. Python's white space is the set ``SPACES``.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

from mnemolake.functions import fixed

_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
_CASE_CHANGE, _CAPITALS = re.compile("[a-z][A-Z]"), re.compile("[A-Z][A-Z_][A-Z_]")
# without the word borders, which ``_alone`` looks at
_CAMEL = re.compile(r"(?<![A-Za-z])[a-z]+[A-Z][A-Za-z]*")
_SNAKE, _TWO_PARTS = re.compile(r"(?<![a-z_])[a-z]+_[a-z_]+"), re.compile(r"(?<![a-z_])[a-z]+_[a-z]+(?![a-z])")
_CONSTANT, _QUOTED = re.compile(r"(?<![A-Z_])[A-Z][A-Z_]{2,}"), re.compile(fixed.QUOTED)
_WORD_END = re.compile(r"[ \t\n\x0b\f\r,.:;!?()\[\]{}\"'/\\]+")


def _is_word(c: str) -> bool:
    """Whether a character belongs to a word for Java's Unicode word borders."""
    if c < "\x80":
        return c.isalnum() or c == "_"
    kind = unicodedata.category(c)
    return kind[0] in "LM" or kind in ("Nd", "Nl", "Pc") or c in "\u200c\u200d" or "\u24b6" <= c <= "\u24e9"


def _alone(pattern: re.Pattern, text: str) -> list[str]:
    """The matches that begin and end at word borders."""
    return [
        m.group() for m in pattern.finditer(text)
        if not (m.start() and _is_word(text[m.start() - 1])) and not (m.end() < len(text) and _is_word(text[m.end()]))
    ]


def _is_capital(c: str) -> bool:
    return "A" <= c <= "Z" or (c > "\x7f" and unicodedata.category(c) == "Lu")


class _Marks:
    """Which of the marks of telling sentences a text holds at all; only these are looked for in its sentences."""

    def __init__(self, text: str):
        low = text.lower()
        self.cues = [w for w in fixed.CUE_WORDS if w in low]
        self.camel, self.snake = _CASE_CHANGE.search(text) is not None, "_" in text

    def points(self, s: str, i: int, total: int) -> int:
        points = 3 - i if i < 3 else 0
        if total > 5 and i >= total - 2:
            points += 2
        size = len(s)
        points += 2 if 50 < size < 200 else 1 if size > 200 else 0
        if self.cues:
            low = s.lower()
            points += 2 * sum([w in low for w in self.cues])
        capitals = [c for c in [w[0] for w in s.split()[1:]] if c.isupper()]
        points += min(sum(map(_is_capital, capitals)), 3)
        if self.camel and _CASE_CHANGE.search(s) and _alone(_CAMEL, s):
            points += 1
        if self.snake and "_" in s and _alone(_TWO_PARTS, s):
            points += 1
        return points


def key_sentences(text: str, n: int, marks: _Marks) -> list[str]:
    kept = [s for s in map(str.strip, _SENTENCE_END.split(text)) if len(s) > 20]
    if not kept:
        return [text[:500]]
    total = len(kept)
    scored = sorted([(-marks.points(s, i, total), i, s) for i, s in enumerate(kept)])
    texts = [s for _, _, s in scored]
    if n < 3 or total <= 10:
        return texts[:n]
    third, picked = total // 3, []
    for low, high in ((0, third), (third, 2 * third), (2 * third, total)):
        picked += next(([s] for _, i, s in scored if low <= i < high and s not in picked), [])
    return list(dict.fromkeys(picked + texts))[:n]


def window_spans(text: str, size: int = 1000, overlap: int = 100) -> list[tuple[int, int]]:
    spans, pos, length = [], 0, len(text)
    while pos < length:
        end = min(pos + size, length)
        if end < length:
            mark = max(text.rfind(c, pos, end) for c in ".?!") - pos
            if mark > size // 2:
                end = pos + mark + 1
        spans.append((pos, end))
        pos = end - overlap if end < length else length
    return spans


def key_passages(text: str, n: int) -> list[str]:
    """Short texts as they are, medium texts by sentences, long texts by windows."""
    if len(text) < 200:
        return [text.strip()]
    marks = _Marks(text)
    if len(text) <= 1000:
        return key_sentences(text, n, marks)
    pooled: dict[str, tuple[float, str]] = {}
    for start, end in window_spans(text):
        for s in key_sentences(text[start:end], n, marks):
            pooled.setdefault(s.strip().lower(), (start / len(text), s))
    places, parts = list(pooled.values()), min(n, 3)
    texts = [s for _, s in places]
    if len(places) <= n:
        return texts
    first = [s for p in range(parts) for s in [x for at, x in places if p / parts <= at < (p + 1) / parts][:1]]
    return list(dict.fromkeys(first + texts))[:n]


_RULES: dict[str, list[tuple[str, str]]] = {}
for _suffix, _replacement in fixed.STEM_RULES:
    _RULES.setdefault(_suffix[-1], []).append((_suffix, _replacement))


def stem(word: str) -> str:
    """First suffix rule that fits; words of up to three characters stay as they are."""
    if len(word) > 3:
        for suffix, replacement in _RULES.get(word[-1], ()):
            if word.endswith(suffix) and len(word) > len(suffix) + 1:
                return word[: -len(suffix)] + replacement
    return word


class Topics:
    """Hits of a taxonomy of (keyword, topic, weight) in a lowercased text, per topic."""

    def __init__(self, taxonomy: list[tuple]):
        from mnemolake.llm.shared import Memo

        self.exact, self.stems = {}, {}
        for keyword, topic, weight in sorted((r for r in taxonomy if r[0] is not None), key=lambda r: r[0]):
            self.exact.setdefault(keyword, []).append((topic, weight))
            self.stems.setdefault(stem(keyword), topic)
        self.begun = {s[:2] for s in self.stems}
        self.known = Memo(self._look_up, 1_000_000)

    def _look_up(self, word: str) -> tuple[tuple, ...]:
        # a stem begins with the first two letters of its word
        if len(word) < 2 or (word not in self.exact and word[:2] not in self.begun):
            return ()
        found = [(t, float(w or 0), 0) if t is not None else (self.stems.get(stem(word)), 0.0, 1) for t, w in self.exact.get(word, [(None, 0.0)])]
        return tuple(f for f in found if f[0] is not None)

    def __call__(self, low: str) -> list[dict] | None:
        """``pos`` orders topics by the first word that hit."""
        hits: dict[str, list] = {}
        known = self.known
        for pos, (word, n) in enumerate(Counter(_WORD_END.split(low)).items()):
            for topic, weight, stemmed in known[word]:
                if topic not in hits:
                    hits[topic] = [0.0, 0, 0, pos]
                hit = hits[topic]
                hit[0] += n * weight
                hit[1] += n * stemmed
                hit[2] += n
        return [{"topic": t, "exact": e, "stemmed": s, "hits": n, "pos": p} for t, (e, s, n, p) in hits.items()] or None


_TOPICS: list = []


def shared_topics(taxonomy: list[tuple]) -> Topics:
    """The same object, with what it has looked up, for all batches of a worker with one taxonomy."""
    if not _TOPICS or _TOPICS[0][0] != taxonomy:
        _TOPICS[:] = [(taxonomy, Topics(taxonomy))]
    return _TOPICS[0][1]


def _name(word: str) -> str | None:
    """The letters, digits and underscores of a word that begins with a capital and has a small letter behind it."""
    if word.isascii():
        bare = word if word.isalpha() else "".join([c for c in word if c.isalnum() or c == "_"])
        return bare if bare and "A" <= bare[0] <= "Z" and not bare[1:].isupper() and any("a" <= c <= "z" for c in bare) else None
    bare = "".join([c for c in word if unicodedata.category(c)[0] in "LN" or c == "_"])
    return bare if bare and _is_capital(bare[0]) and any(unicodedata.category(c) == "Ll" for c in bare) else None


def entity_words(text: str) -> set[str]:
    """Capitalized words inside sentences, identifiers and quoted terms."""
    found, known, ended = set(), {}, True
    for word in text.split():
        if not ended and len(word) > 2 and not (word[0].islower() and word[0] < "\u0250"):
            if word not in known:
                known[word] = _name(word)
            if known[word]:
                found.add(known[word])
        ended = word[-1] in ".!?"
    if _CASE_CHANGE.search(text):
        found.update(_alone(_CAMEL, text))
    if "_" in text:
        found.update(_alone(_SNAKE, text))
    if _CAPITALS.search(text):
        found.update(_alone(_CONSTANT, text))
    found.update(_QUOTED.findall(text))
    return found


def key_entities(text: str, low: str, n: int = 10) -> list[str]:
    """The entities that occur most often as substrings in any case (then by name)."""
    if len(text) < 20:
        return []
    ranked = []
    for name in entity_words(text):
        part = name.lower()
        ranked.append((-(low.count(part) * len(part) / len(name)), name))
    return [name for _, name in sorted(ranked)[:n]]
