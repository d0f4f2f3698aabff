"""Removal of passages that stand in an earlier document, by suffix automata of reference shards.

A window is 50 consecutive words. The reference is what has to be recognised: every window that more than one document
holds, taken once, from the document with the smallest id. Its passages are dealt to shards of bounded size. A suffix automaton
of a shard's passages goes to the tasks that read documents for this shard; documents stream through it word by word,
the length of the longest match with any passage is kept (matching statistics, cut at 50), and where it reaches 50 in a
passage of a smaller id, the words of the window are removed.

* Finding the reference: the smallest hash of the 16-word runs of a window is its anchor. Equal windows have equal
  anchors, and a text has one distinct anchor in about 18 words; only windows under an anchor of two different texts are
  counted as a whole (by digests, combined before the shuffle). Most texts drop out here, and so do all copies of a text
  but the first: they lose every window to it.
* Sending: an automaton is not broadcast to every task, as the reference grows with the corpus. Documents go to the shards
  with whose passages they share an anchor that an earlier document has. A shard that many documents need is copied to
  many groups, each with a bounded share of the documents; a passage in a third of all rows is one passage of one shard.
* Digests choose the reference only; what is removed was matched word by word.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from mnemolake.llm.feistel_shards import global_row_numbers
from mnemolake.llm.shared import SPACE, Memo, Registry, stored, table

registry = Registry()

WINDOW = 50
RUN = 16  # words of an anchor
PASSAGE_WORDS = 2_000  # longer passages are cut, with an overlap of one word less than a window
SHARD_WORDS = 50_000  # reference words of an automaton
PART_WORDS = 500_000  # document words that stream through one copy of an automaton
LAST = (1 << 63) - 1  # the place of documents without id: after all others
_ODD = np.uint64(0x9E3779B97F4A7C15)
_WORD_HASH = Memo(xxhash.xxh64_intdigest, 150_000)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()  # bytes: ASCII white space only


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_WORD_HASH.__getitem__, words), np.uint64, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(h: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """The hash of every run of ``length`` words, put together from runs of 1, 2, 4, ... words."""
    rows = len(h) - length + 1
    if rows <= 0:
        return np.empty(0, np.uint64)
    block, size, done, out = _mix(h + np.uint64(seed)), 1, 0, np.zeros(rows, np.uint64)
    while True:
        if length & size:
            out = _mix(out * _ODD + block[done : done + rows])
            done += size
        if 2 * size > length:
            return out
        block = _mix(block[:-size] * _ODD + block[size:])  # mixed each time: the order of the words counts
        size *= 2


def window_anchors(h: np.ndarray, window: int) -> np.ndarray:
    """For every window the smallest hash of its runs of ``RUN`` words."""
    low, held, span = run_hashes(h, min(RUN, window), 1), 1, window - min(RUN, window) + 1
    if len(low) < span:
        return np.empty(0, np.uint64)
    while 2 * held <= span:
        low = np.minimum(low[:-held], low[held:])
        held *= 2
    return np.minimum(low[: len(low) - (span - held)], low[span - held :]) if span > held else low


class Automaton:
    """Suffix automaton of passages; every state knows the owner of a passage that holds its words."""

    def __init__(self):
        self.ids: dict[bytes, int] = {}
        self.edges, self.link, self.length, self.owner = [{}], [-1], [0], [None]

    def _state(self, length: int, owner, edges: dict, link: int) -> int:
        self.edges.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.owner.append(owner)
        return len(self.link) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The state of the words that reach ``q`` from ``p``; a copy of ``q`` if that stands for longer ones too."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.owner[q], dict(self.edges[q]), self.link[q])
        while p >= 0 and self.edges[p].get(c) == q:
            self.edges[p][c] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def add(self, words: list[bytes], owner: int) -> None:
        edges, link, last = self.edges, self.link, 0
        for word in words:
            c = self.ids.setdefault(word, len(self.ids))
            if c in edges[last]:
                last = self._split(last, edges[last][c], c)
                continue
            new, p = self._state(self.length[last] + 1, owner, {}, 0), last
            while p >= 0 and c not in edges[p]:
                edges[p][c] = new
                p = link[p]
            if p >= 0:
                link[new] = self._split(p, edges[p][c], c)
            last = new

    def spans(self, words: list[bytes], owner: int, window: int) -> list[tuple[int, int]]:
        """Maximal runs (start, end) of words under windows that a passage of a smaller owner holds."""
        edges, link, length, known = self.edges, self.link, self.length, self.ids.get
        state, match, out = 0, 0, []
        for i, word in enumerate(words):
            c = known(word)
            while state and c not in edges[state]:
                state = link[state]
                match = length[state]
            if c not in edges[state]:
                continue
            state = edges[state][c]
            match += 1
            if match < window:
                continue
            while length[link[state]] >= window:
                state = link[state]
            match = window
            if self.owner[state] < owner:
                if out and i + 1 - window <= out[-1][1]:
                    out[-1] = (out[-1][0], i + 1)
                else:
                    out.append((i + 1 - window, i + 1))
        return out


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents with their place among the ids and a 128-bit digest (``h``, ``g``) of the text."""
    text = F.coalesce(text_col, F.lit(""))
    place = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    return docs.select(F.col(id_col).alias("id"), place.alias("place"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g"), text.alias("text"))


def _classes(keyed: DataFrame, window: int) -> DataFrame:
    """One row per different text: first and last ``place``, number of words, distinct anchors, and ``node``, numbered by place."""

    def anchors(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for words in map(words_of, texts):
            rows.append((len(words), np.unique(window_anchors(word_hashes(words), window)).view(np.int64)))
        return pd.DataFrame(rows, columns=["n_words", "anchors"])

    read = F.pandas_udf(anchors, "n_words long, anchors array<long>")
    rows = stored(keyed.select("place", "h", "g", read("text").alias("r")).select("place", "h", "g", "r.*"), "anchored")
    first = F.first(F.struct("n_words", "anchors")).alias("f")  # equal in all copies
    merged = rows.groupBy("h", "g").agg(F.min("place").alias("place"), F.max("place").alias("last"), first)
    return global_row_numbers(merged.select("h", "g", "place", "last", "f.*"), ["place"], "node")[0]


def _windows(suspects: DataFrame, window: int) -> DataFrame:
    """(``node``, ``x``, ``y``): the windows under a shared anchor; (x, y), 96 bits, is their digest."""

    def digests(texts: pd.Series, shared: pd.Series) -> pd.DataFrame:
        rows = []
        for text, anchors in zip(texts, shared):
            h = word_hashes(words_of(text))
            over = window_anchors(h, window)
            under = np.isin(over, np.asarray(anchors, np.int64).view(np.uint64))
            rows.append((run_hashes(h, window, 2)[under].view(np.int64), over[under].astype(np.uint32).view(np.int32)))
        return pd.DataFrame(rows, columns=["x", "y"], dtype=object)

    drawn = suspects.select("node", F.pandas_udf(digests, "x array<long>, y array<int>")("text", "shared.anchor").alias("d"))
    return drawn.select("node", F.explode(F.arrays_zip("d.x", "d.y")).alias("w")).select("node", "w.x", "w.y")


def _passages(wanted: DataFrame, window: int) -> DataFrame:
    """Maximal runs of wanted windows as texts, with their anchors and ``home``, the first document of any of these.

    ``wanted`` has (node, place, text, shared, xs); passages of copies and their variants share a home as a rule.
    """

    @F.pandas_udf("array<struct<start: long, words: long, text: string, anchors: array<long>, home: long>>")
    def cut(texts: pd.Series, shared: pd.Series, first: pd.Series, xs: pd.Series) -> pd.Series:
        out = []
        for text, anchors, firsts, digests in zip(texts, shared, first, xs):
            words = words_of(text)
            h = word_hashes(words)
            held = np.isin(run_hashes(h, window, 2), np.asarray(digests, np.int64).view(np.uint64))
            at = window_anchors(h, window).view(np.int64)
            home = dict(zip(np.asarray(anchors).tolist(), np.asarray(firsts).tolist()))
            edges = np.flatnonzero(np.diff(np.concatenate([[0], held.astype(np.int8), [0]]))).tolist()
            rows = []
            for start, end in zip(edges[::2], edges[1::2]):
                for a in range(start, end, PASSAGE_WORDS):
                    b = min(a + PASSAGE_WORDS, end)
                    mine = np.unique(at[a:b]).tolist()
                    piece = words[a : b + window - 1]
                    rows.append({
                        "start": a, "words": len(piece), "text": b" ".join(piece).decode("utf-8", "surrogatepass"), "anchors": mine,
                        "home": min(home[x] for x in mine),
                    })
            out.append(rows)
        return pd.Series(out, dtype=object)

    cuts = wanted.select("node", "place", F.explode(cut("text", "shared.anchor", "shared.first", "xs")).alias("p"))
    return cuts.select("node", "place", "p.*")


def _sharded(passages: DataFrame) -> DataFrame:
    """Add ``shard``: small homes share shards of about ``SHARD_WORDS`` words, larger ones are split."""
    homes = passages.groupBy("home").agg(F.sum("words").alias("home_words"))
    shards = 1 + (passages.agg(F.sum("words")).first()[0] or 0) // SHARD_WORDS
    pieces = F.ceil(F.col("home_words") / SHARD_WORDS)
    split = F.xxhash64("home", F.pmod(F.xxhash64("node", "start"), pieces))
    small = F.pmod(F.xxhash64("home"), F.lit(shards))
    return passages.join(homes, "home").withColumn("shard", F.when(F.col("home_words") <= SHARD_WORDS, small).otherwise(split)).drop("home_words")


def _stream(window: int):
    def stream(group: pd.DataFrame) -> pd.DataFrame:
        automaton, rows = Automaton(), []
        is_reference = group["reference"].to_numpy()
        for place, text in zip(group["place"][is_reference].tolist(), group["text"][is_reference]):
            automaton.add(words_of(text), place)
        for node, place, text in zip(*(group[c][~is_reference].tolist() for c in ("node", "place", "text"))):
            rows += [(node, start, end) for start, end in automaton.spans(words_of(text), place, window)]
        return pd.DataFrame(rows, columns=["node", "start", "end"], dtype="int64")

    return stream


def _matched(passages: DataFrame, suspects: DataFrame, window: int) -> DataFrame:
    """(``node``, ``start``, ``end``): spans of words that a passage of a smaller id holds."""
    held = passages.select("shard", F.explode("anchors").alias("anchor")).distinct()
    asked = suspects.select("node", "place", F.explode("shared").alias("s")).filter(F.col("s.first") < F.col("place"))
    routes = asked.select("node", F.col("s.anchor").alias("anchor")).join(held, "anchor").select("node", "shard").distinct()
    reading = stored(routes.join(suspects.select("node", "place", "text", "n_words"), "node"), "reading")
    loads = reading.groupBy("shard").agg(F.ceil(F.sum("n_words") / PART_WORDS).alias("parts"))
    copies = passages.join(loads, "shard").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = reading.join(loads, "shard").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    columns = ["shard", "part", "node", "place", "text"]
    both = copies.select(*columns, F.lit(True).alias("reference")).unionByName(dealt.select(*columns, F.lit(False).alias("reference")))
    return both.groupBy("shard", "part").applyInPandas(_stream(window), "node long, start long, end long")


def _without(window: int):
    def without(texts: pd.Series, copies: pd.Series, spans: pd.Series) -> pd.DataFrame:
        """Number of words, number of removed ones and the text of the others."""
        rows = []
        for text, copy, cut in zip(texts, copies, spans):
            words = words_of(text)
            if copy:
                left = [] if len(words) >= window else words
            elif cut is not None:
                gone = np.zeros(len(words), bool)
                for span in cut:
                    gone[span["start"] : span["end"]] = True
                left = [w for w, g in zip(words, gone.tolist()) if not g]
            else:
                left = words
            rows.append((len(words), len(words) - len(left), b" ".join(left).decode("utf-8", "surrogatepass")))
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept"])

    return without


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, ``n_words``, ``n_removed`` and ``kept``, the words that stay, joined by one space.

    A word goes if a window of ``window`` words over it also starts in a document with a smaller id. Windows are judged on
    the input. Ids are integers; a null id comes after all others, and rows that share an id, null included, remove
    nothing from each other, so repeated rows all stay as they are (or all lose what an earlier id has). Null and empty texts have no
    words; texts shorter than a window lose nothing; very long texts are read whole. An empty table gives no rows. Other columns are
    ignored, whatever their names.
    """
    keyed = _keyed(docs, id_col, text_col)
    classes = stored(_classes(keyed, window), "texts")
    # anchors of different texts: the copies of a text lose all their windows to its first document, without being read
    anchors = classes.select("node", "place", F.explode("anchors").alias("anchor"))
    shared = anchors.groupBy("anchor").agg(F.min("place").alias("first"), F.max("place").alias("last")).filter("first < last").drop("last")
    marks = anchors.select("node", "anchor").join(shared, "anchor").groupBy("node").agg(F.collect_list(F.struct("anchor", "first")).alias("shared"))
    marked = stored(marks.join(classes.drop("anchors", "last"), "node"), "marked")
    # plain sort-merge joins at every size: neither side has a bound
    texts = keyed.join(marked.select("node", "place", "h", "g").hint("merge"), ["place", "h", "g"]).dropDuplicates(["node"]).select("node", "text")
    suspects = stored(texts.join(marked, "node"), "suspects")

    windows = _windows(suspects, window)
    # nodes are numbered by place: the smallest is the first text with the window
    repeated = windows.groupBy("x", "y").agg(F.min("node").alias("node"), F.max("node").alias("last")).filter("node < last")
    per_text = repeated.groupBy("node").agg(F.collect_list("x").alias("xs"))  # the windows of one text at most
    passages = stored(_passages(suspects.join(per_text, "node"), window), "passages")
    spans = _matched(stored(_sharded(passages), "sharded"), suspects, window)
    spans = spans.groupBy("node").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    lost = classes.select("node", "h", "g", F.col("place").alias("first"), "last").join(spans, "node", "left")
    lost = stored(lost.filter("last > first OR spans IS NOT NULL").drop("node", "last"), "lost")
    cut = F.pandas_udf(_without(window), "n_words long, n_removed long, kept string")
    out = keyed.join(lost.hint("merge"), ["h", "g"], "left").withColumn("copy", F.coalesce(F.col("place") > F.col("first"), F.lit(False)))
    return out.select("id", cut("text", "copy", "spans").alias("c")).select(F.col("id").alias(id_col), "c.*")


@registry.add(
    "op12_repeated_passages",
    rf"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '{SPACE}'), lambda x: x <> '') AS ws FROM documents),
    g AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM
        (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 49)) AS i FROM w)),
    f AS (SELECT h, min(doc_id) AS first FROM g GROUP BY h),
    gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS p FROM g JOIN f USING (h) WHERE first < doc_id),
    per AS (SELECT doc_id, list(p) AS gone FROM gone GROUP BY doc_id)
    SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(array_to_string(CASE WHEN gone IS NULL THEN ws
        ELSE list_filter(ws, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256 FROM w LEFT JOIN per USING (doc_id)""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
