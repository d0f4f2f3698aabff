"""Main text of web pages as the maximum-scoring contiguous region.

A page is read as a sequence of words and tags. Words score positive, by how much text in their kind of element belongs to
articles; tags score negative, by how rarely they stand inside one. A linear scan finds the contiguous region
with the largest sum. The weights come from labelled pages: those that mark their article themselves (``article`` or
``main``), of which a bounded sample is counted on the driver. Elements without a class are counted by the place they
stand in, so an item of a menu says nothing of an item in an article. Menus, forms, asides, adverts and reader comments
inside the region are left out by their name or class.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from mnemolake.llm.shared import Registry, table

registry = Registry()

SAMPLE_PAGES = 400
#: raw elements run to their end tag or the end of the page; the other silent ones are left out if their end tag comes
RAW = ("script", "style", "textarea")
#: elements whose content is no text of the page. ``head`` is none: what may stand in it is silent or empty, all else ends it
SILENT = ("template", "noscript", "svg", "math", "title", "select", "iframe", "object", "button", "datalist", "canvas", "audio", "video")
FOREIGN = ("svg", "math")  # here and inside, a tag that ends in "/>" is a whole element
#: elements that break a line of text
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: elements that are judged by their name alone; their classes speak of the page
WHOLE = frozenset("html body article main".split())
#: names that usually hold no article, before any page is counted
BOILERPLATE = frozenset("nav aside footer form menu dialog fieldset".split())
#: elements that make a place: what stands in them is counted apart
LANDMARKS = BOILERPLATE | {"article", "main", "header"}
BOILERPLATE_CLASS = re.compile(
    r"(?:^|[-_ ])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|footer|masthead|menu|nav\w*|newsletter|notice|popup|promo\w*|"
    r"related|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[-_ ])"
)
#: a class token made of nothing but such names and neutral words leaves its element out of the region
_JUNK = (
    r"(?:ads?|advert\w*|banner|breadcrumbs?|comments?|complementary|consent|contentinfo|cookies?|disqus|footer|masthead|menu|nav|navbar|navigation|"
    r"newsletter|notice|popup|promo\w*|related|repl(?:y|ies)|respond|share|sharing|sidebar|social|sponsor\w*|subscribe|subscription|toolbar|widget)"
)
_NEUTRAL = (
    r"(?:area|articles?|author|bar|block|body|bottom|box|buttons?|container|content|form|inner|items?|left|links?|list|meta|outer|page|posts?|primary|"
    r"reader|right|secondary|section|signup|site|text|thread|top|user|wrap|wrapper|[0-9]+)"
)
JUNK_CLASS = re.compile(rf"(?:{_NEUTRAL}[-_]+)*{_JUNK}(?:[-_]+(?:{_JUNK}|{_NEUTRAL}))*")
PENALTIES = (2.0, 5.0, 10.0, 20.0, 40.0)
_REST = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(?P<raw>" + "|".join(RAW) + rf")(?=[\s/>])(?P<head>{_REST}>|[^>]*+>)(?P<inside>.*?(?:</(?P=raw)(?=[\s/>])[^>]*+>|\Z))"
    r"|<(?P<shut>/?)(?P<silent>" + "|".join(SILENT) + rf")(?=[\s/>])(?P<tail>{_REST}>|[^>]*+>)"
    rf"|<(?P<close>/?)(?P<name>[a-z][a-z0-9:-]*+)(?P<rest>{_REST})>|<[!?/][^>]*+>|(?P<text>[^<]++|<)",
    re.IGNORECASE | re.DOTALL,
)
_CLASS = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)


@dataclass
class Weights:
    """Share of the words of an element kind, and of the tags in a place, that stand inside articles; the tag penalty.

    A tag counts as ``place>name`` and, for names that were never counted there, as ``place>``.
    """

    words: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)
    penalty: float = 10.0


@dataclass(eq=False, slots=True)
class Block:
    """An open element: its name, one kind per token of its class, the keys it is counted by, and the words it holds."""

    name: str
    kinds: tuple[str, ...] = ()
    keys: tuple[str, ...] = ()
    words: int = 0

    @property
    def place(self) -> bool:
        return bool(self.kinds) or self.name in LANDMARKS

    @property
    def junk(self) -> bool:
        """Its name or a class says that it is no part of an article."""
        return self.name in BOILERPLATE or any(JUNK_CLASS.fullmatch(k.partition(".")[2]) for k in self.kinds)


def place_of(blocks: tuple | list) -> tuple[str, ...]:
    """Keys of the innermost element that makes a place; one empty key outside of all."""
    return next((b.keys for b in reversed(blocks) if b.place), ("",))


def _prior(kind: str) -> float:
    name, _, label = kind.rpartition(">")[2].partition(".")
    return 0.02 if name in BOILERPLATE or label and BOILERPLATE_CLASS.search(label) else 0.9


def read(page: str) -> list[tuple]:
    """The page as ("text", raw, open blocks, words) and ("tag", name, blocks around it, 0) events.

    A kind is the element name with one token of its class, id or role. A closing tag closes everything opened
    after its opening tag and is ignored without one; a new block ends an open paragraph. Comments, scripts and styles
    are gone, and so is all between the tags of a silent element; without an end tag only its own tag is.
    """
    events, open_, blocks, pos = [], [], (), 0
    begun, n_begun = [], Counter()  # silent elements: name, events before it, blocks open before it
    while pos < len(page):
        m = _TOKEN.match(page, pos)
        pos = m.end()
        text = m["text"]
        if text is not None:
            events.append(("text", text, blocks, len(text.split())))
            continue
        name = m["name"]
        if name is None:
            if m["raw"]:
                if m["head"].endswith("/>") and (n_begun["svg"] or n_begun["math"]):
                    pos = m.start("inside")
            elif m["silent"]:
                silent = m["silent"].lower()
                if not m["shut"]:
                    if not (m["tail"].endswith("/>") and (silent in FOREIGN or n_begun["svg"] or n_begun["math"])):
                        begun.append((silent, len(events), blocks))
                        n_begun[silent] += 1
                elif n_begun[silent]:
                    passed = None
                    while passed != silent:
                        passed, at, blocks = begun.pop()
                        n_begun[passed] -= 1
                    del events[at:]
                    open_ = list(blocks)
            continue
        name, outer = name.lower(), blocks
        if name in BLOCKS and name not in VOID:
            blocks = _move(open_, name, m)
        events.append(("tag", name, blocks if m["close"] else outer, 0))
    for _, _, blocks, n in events:
        if n:
            for block in blocks:
                block.words += n
    return events


def _move(open_: list[Block], name: str, m: re.Match) -> tuple:
    """Open or close an element; the blocks that are open then."""
    if m["close"]:
        at = next((i for i in reversed(range(len(open_))) if open_[i].name == name), None)
        if at is not None:
            del open_[at:]
    else:
        if open_ and open_[-1].name == "p":
            open_.pop()
        if not m["rest"].endswith("/"):
            labels = [] if name in WHOLE else _CLASS.findall(m["rest"])
            tokens = dict.fromkeys(" ".join(a or b or c for a, b, c in labels).lower().split())
            kinds = tuple(f"{name}.{token}" for token in tokens)
            keys = kinds or ((name,) if name in BOILERPLATE or name in WHOLE else tuple(f"{k}>{name}" for k in place_of(open_)))
            open_.append(Block(name, kinds, keys))
    return tuple(open_)


def count(pages: list[str]) -> Weights:
    """Weights from pages that mark their article; the penalty is the one that finds most of their words alone.

    What an article holds in an element that its name or class calls no part of it, is not the article's.
    """
    inside_words, words, inside_tags, tags = Counter(), Counter(), Counter(), Counter()
    read_pages = []
    for page in pages:
        events, truth = read(page), []
        page_words = sum(n for *_, n in events)
        for what, value, blocks, n in events:
            marked = next((i for i, b in enumerate(blocks) if b.name in ("article", "main")), None)
            article = marked is not None and not any(b.junk and 2 * b.words <= page_words for b in blocks[marked:])
            truth.append(article)
            if what == "tag":
                for k in {k for p in place_of(blocks) for k in (f"{p}>{value}", f"{p}>")}:
                    tags[k] += 1
                    inside_tags[k] += article
            else:
                for k in {k for b in blocks for k in b.keys}:
                    words[k] += n
                    inside_words[k] += n * article
        read_pages.append((events, truth))
    weights = Weights(
        {k: (inside_words[k] + 3 * _prior(k)) / (n + 3) for k, n in words.items()},
        {k: (inside_tags[k] + 3 * _prior(k)) / (n + 3) for k, n in tags.items()},
    )

    def quality(penalty):
        tried, right, wrong = Weights(weights.words, weights.tags, penalty), 0, 0
        for events, truth in read_pages:
            first, end = best_region(events, tried)
            for i, (what, _, _, n) in enumerate(events):
                if what == "text":
                    right += n * (truth[i] and first <= i < end)
                    wrong += n * (truth[i] != (first <= i < end))
        return 2 * right / max(1, 2 * right + wrong)

    if read_pages:
        weights.penalty = max(PENALTIES, key=quality)
    return weights


def counted(block: Block, weights: Weights) -> float | None:
    """The lowest share among the counted keys of an element; None if none was counted.

    A name that says enough stands in for unknown classes.
    """
    if block.name in ("html", "body"):
        return None
    name = weights.words.get(block.name) if block.name in BOILERPLATE else None
    return min((weights.words[k] for k in block.keys if k in weights.words), default=name)


def word_weight(blocks: tuple, weights: Weights, page_words: int) -> float:
    """The lowest share among the open elements, so that text in a menu inside an article is a menu's.

    Names and class tokens never counted go by what they look like, unless the element holds most words of the page:
    then it is a wrapper, and so is one without a class that was counted. ``html`` and ``body`` hold everything and say
    nothing.
    """
    low = 0.9 if blocks else 0.5
    for block in blocks:
        wrapper = 2 * block.words > page_words
        share = None if wrapper and not block.place else counted(block, weights)
        if share is not None:
            low = min(low, share)
        if block.name not in WHOLE and not wrapper:
            low = min([low, *(_prior(k) for k in (block.name, *block.kinds) if k not in weights.words)])
    return low


def tag_share(name: str, blocks: tuple, weights: Weights) -> float:
    """The share of a tag in the innermost place around it that was counted; elsewhere what its name looks like.

    A name never counted in that place goes by all tags there, so a list in an article is the article's.
    """
    for block in reversed(blocks):
        if block.place:
            for keys in ([f"{k}>{name}" for k in block.keys], [f"{k}>" for k in block.keys]):
                shares = [weights.tags[k] for k in keys if k in weights.tags]
                if shares:
                    return min(shares)
    return weights.tags.get(f">{name}", _prior(name))


def best_region(events: list[tuple], weights: Weights) -> tuple[int, int]:
    """First event and end of the region with the largest sum; the first of equals; empty without a word."""
    best, best_at, total, start = 0.0, (0, 0), 0.0, 0
    page_words = sum(n for *_, n in events)
    known: dict[int, float] = {}  # by the tuple of open blocks, which events share
    costs: dict[tuple[int, str], float] = {}
    for i, (what, value, blocks, n) in enumerate(events):
        if what == "text":
            if not n:
                continue
            if id(blocks) not in known:
                known[id(blocks)] = word_weight(blocks, weights, page_words)
            total += n * known[id(blocks)]
        else:
            at = (id(blocks), value)
            if at not in costs:
                costs[at] = weights.penalty * (1 - tag_share(value, blocks, weights)) + 0.001
            total -= costs[at]
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, best_at = total, (start, i + 1)
    return best_at


def main_text(page: str | None, weights: Weights) -> str:
    """The text of the best region: character references decoded, one line per block, white space as one space.

    Text in classes and boilerplate elements that by count almost never belong to articles is left out also inside the
    region, unless the element holds the whole region: then the region scan has judged it. The same goes for
    elements never counted whose name or class alone says menu, form, aside, advert or reader comments, unless
    they hold most of the region. Elements without a class, such as lists and tables, never drop text.
    """
    events = read(page or "")
    first, end = best_region(events, weights)
    worded = [(blocks, n) for _, _, blocks, n in events[first:end] if n]
    around = set(worded[0][0]).intersection(worded[-1][0]) if worded else set()
    region_words = sum(n for _, n in worded)
    left_out: dict[Block, bool] = {}

    def drops(block: Block) -> bool:
        if block in around or not block.place or block.name in WHOLE:
            return False
        share = counted(block, weights)
        return block.junk and 2 * block.words <= region_words if share is None else share < 0.1

    lines, line = [], []
    for what, value, blocks, _ in events[first:end]:
        if what == "tag":
            if value in BLOCKS:
                lines.append("".join(line))
                line = []
            continue
        for block in blocks:
            if block not in left_out:
                left_out[block] = drops(block)
        if not any(left_out[block] for block in blocks):
            line.append(html.unescape(value))
    lines.append("".join(line))
    clean = (" ".join(text.split()) for text in lines)
    return "\n".join(text for text in clean if text)


def learn(pages: DataFrame, html_col: str = "html", sample_pages: int = SAMPLE_PAGES) -> Weights:
    """Count weights on at most ``sample_pages`` different labelled pages, those with the least hashes of their content.

    The hashes are chosen first, so that only the chosen pages are sent to the driver, however many tasks there are.
    """
    marked = pages.filter(F.col(html_col).rlike("(?i)<(article|main)[ >]")).select(F.col(html_col).alias("html"), F.xxhash64(html_col).alias("h"))
    least = [r.h for r in marked.select("h").distinct().orderBy("h").limit(sample_pages).collect()]
    if not least:
        return count([])
    chosen = marked.filter(F.col("h") <= least[-1]).groupBy("h").agg(F.min("html").alias("html"))
    return count([r.html for r in sorted(chosen.collect(), key=lambda r: r.h)])


def extract(pages: DataFrame, weights: Weights, html_col: str = "html") -> DataFrame:
    """Add ``text``, the main text of every page. Null and empty pages and pages without words give an empty text.

    All rows and other columns stay, repeated rows included; a column named ``text`` is replaced.
    """

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(page, weights) for page in batch], dtype=object)

    return pages.withColumn("text", texts(F.col(html_col)))


@registry.add("op4_html_main_text")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, learn(pages)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
