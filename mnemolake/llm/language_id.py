"""Language identification by a linear-chain conditional random field over words.

Each word is scored per language from its affixes, character n-grams and its place in a learned lexicon; learned
transitions tie neighbouring words together; forward-backward gives every word a distribution over languages, also in
text that switches between them. A document's language is the one with the largest mean probability over its words.

The model is fitted on the driver from a bounded sample of labelled rows (``per_language`` texts of each language, of at
most ``sample_chars`` characters each); prediction runs in Arrow batches over all rows and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from mnemolake.llm.shared import Registry, table

registry = Registry()

PER_LANGUAGE = 300
SAMPLE_CHARS = 4000
HASH_BITS = 17
SEQUENCES, STEPS, EPOCHS = 1200, 48, 25
BLOCK = 32
FLOOR = 1e-6  # least factor of a word for a language, against 1 for its best
BATCH_WORDS = 100_000
UNDECIDED = "und"
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_KINDS = 9  # one, two and three characters, three prefixes, two suffixes, the word itself


@dataclass
class Model:
    """Languages, one weight row per hashed feature, and transition factors (row: from, column: to)."""

    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray


def core(token: str) -> str:
    """The word in a token: lower case, without what is no letter at its ends; empty if it has no letter."""
    word = token.lower()
    if word.isalpha():
        return word
    first, last = 0, len(word)
    while first < last and not word[first].isalpha():
        first += 1
    while last > first and not word[last - 1].isalpha():
        last -= 1
    return word[first:last]


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature numbers of all words, and the word each belongs to. Words must not be empty."""
    text = "".join(f"\x02{w}\x03" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), sizes)
    starts = np.cumsum(sizes) - sizes
    ends = starts + sizes
    mixed = (codes + np.uint64(7)) * _GOLD
    hashes, owners = [], []

    def add(kind, values, own):
        with np.errstate(over="ignore"):
            hashes.append(((values + np.uint64(kind * 1_000_003)) * _GOLD) >> np.uint64(64 - HASH_BITS))
        owners.append(own)

    gram = mixed
    for n in (1, 2, 3):
        if n > 1:
            gram = gram[:-1] * np.uint64(31) + mixed[n - 1 :]
        same = owner[: len(gram)] == owner[n - 1 :]
        add(n - 1, gram[same], owner[: len(gram)][same])
    for n in (1, 2, 3):  # prefixes with the mark before the word
        long = np.flatnonzero(sizes - 2 >= n)
        value = np.zeros(len(long), np.uint64)
        for j in range(n):
            value = value * np.uint64(31) + mixed[starts[long] + 1 + j]
        add(2 + n, value, long)
    for n in (2, 3):
        long = np.flatnonzero(sizes - 2 >= n)
        value = np.zeros(len(long), np.uint64)
        for j in range(n):
            value = value * np.uint64(31) + mixed[ends[long] - 2 - j]
        add(4 + n, value, long)
    # the lexicon: the whole word
    whole = np.add.reduceat(mixed * (np.arange(len(mixed), dtype=np.uint64) - np.repeat(starts, sizes).astype(np.uint64) + np.uint64(3)) ** np.uint64(2), starts)
    add(8, whole, np.arange(len(words)))
    return np.concatenate(hashes).astype(np.int64), np.concatenate(owners)


def _emissions(weights: np.ndarray, ids: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(owners, weights[ids, k], n) for k in range(weights.shape[1])], axis=1)


def fit(texts: list[str], labels: list[str], seed: int = 7) -> Model | None:
    """Fit weights and transitions by gradient ascent on the likelihood of made-up code-switched sequences.

    Spans of texts of different languages are strung together, so that the transitions learn both to stay and to
    switch. None without a labelled word.
    """
    languages = sorted(set(labels))
    number = {language: i for i, language in enumerate(languages)}
    vocabulary: dict[str, int] = {}
    docs = []
    for text, label in zip(texts, labels):
        words = [w for w in map(core, text.split()) if w]
        if words:
            docs.append((np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words]), number[label]))
    if not docs:
        return None
    rng, k = np.random.default_rng(seed), len(languages)
    by_language = [[d for d, n in docs if n == i] for i in range(k)]
    present = [i for i in range(k) if by_language[i]]
    seen, gold = np.empty((SEQUENCES, STEPS), np.int64), np.empty((SEQUENCES, STEPS), np.int64)
    for s in range(SEQUENCES):
        at = 0
        while at < STEPS:
            language = present[rng.integers(len(present))]
            doc = by_language[language][rng.integers(len(by_language[language]))]
            n = min(STEPS - at, len(doc), 1 + int(rng.geometric(1 / 16)))
            first = rng.integers(len(doc) - n + 1)
            seen[s, at : at + n], gold[s, at : at + n] = doc[first : first + n], language
            at += n
    used, places = np.unique(seen, return_inverse=True)
    places = places.reshape(seen.shape)
    words = list(vocabulary)
    ids, owners = features([words[i] for i in used.tolist()])
    weights, transitions = np.zeros((1 << HASH_BITS, k)), np.zeros((k, k))
    squares, t_squares = np.full_like(weights, 1e-6), np.full_like(transitions, 1e-6)
    target = np.eye(k)[gold]
    moves = np.zeros((k, k))
    np.add.at(moves, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
    for _ in range(EPOCHS):
        score = _emissions(weights, ids, owners, len(used))[places]
        e = np.exp(score - score.max(axis=2, keepdims=True))
        a = np.exp(transitions)
        forward, backward = np.empty_like(e), np.empty_like(e)
        state = np.full((SEQUENCES, k), 1 / k)
        for t in range(STEPS):
            state = (state @ a) * e[:, t]
            state /= state.sum(axis=1, keepdims=True)
            forward[:, t] = state
        state = np.ones((SEQUENCES, k))
        for t in reversed(range(STEPS)):
            backward[:, t] = state
            state = (state * e[:, t]) @ a.T
            state /= state.sum(axis=1, keepdims=True)
        gamma = forward * backward
        gamma /= gamma.sum(axis=2, keepdims=True)
        pairs = forward[:, :-1, :, None] * a * (e[:, 1:] * backward[:, 1:])[:, :, None, :]
        pairs /= pairs.sum(axis=(2, 3), keepdims=True)
        wrong = (target - gamma).reshape(-1, k)
        of_word = np.stack([np.bincount(places.ravel(), wrong[:, i], len(used)) for i in range(k)], axis=1)
        gradient = np.stack([np.bincount(ids, of_word[owners, i], 1 << HASH_BITS) for i in range(k)], axis=1) - 0.05 * weights
        squares += gradient**2
        weights += 0.2 * gradient / np.sqrt(squares)
        t_gradient = (moves - pairs.sum(axis=(0, 1))) / SEQUENCES - 0.01 * transitions
        t_squares += t_gradient**2
        transitions += 0.2 * t_gradient / np.sqrt(t_squares)
    return Model(languages, weights.astype(np.float32), np.exp(transitions - transitions.max()))


def posteriors(e: np.ndarray, sizes: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Forward-backward over many chains at once: word factors ``e`` (words x languages), words per chain.

    Exact: chains are cut into blocks of equal length, each block's transfer matrix is multiplied out for all blocks
    together, the blocks of a chain are then passed in order, and the words inside all blocks together again.
    """
    k = e.shape[1]
    blocks_of = -(-sizes // BLOCK)
    blocks = int(blocks_of.sum())
    first_block = np.cumsum(blocks_of) - blocks_of
    within = np.arange(len(e)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row, column = np.repeat(first_block, sizes) + within // BLOCK, within % BLOCK
    # longest blocks first: the blocks that have a word at a place are then a slice
    length = np.bincount(row, minlength=blocks)
    order = np.argsort(-length, kind="stable")
    rank = np.empty(blocks, np.int64)
    rank[order] = np.arange(blocks)
    live = np.searchsorted(-length[order], -np.arange(1, BLOCK + 1), side="right").tolist()
    row, first_of = rank[row], first_block
    words = np.ones((BLOCK, blocks, k))
    words[column, row] = np.maximum(e, FLOOR)  # so that a block's product stays within the range of a double
    through = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
    for t, n in enumerate(live):
        if n:
            through[:n] = (through[:n].reshape(-1, k) @ a).reshape(n, k, k) * words[t, :n, None, :]
    through /= through.max(axis=(1, 2), keepdims=True)
    before, after = np.full((blocks, k), 1 / k), np.ones((blocks, k))
    most = int(blocks_of.max(initial=0))
    chains = np.argsort(-blocks_of, kind="stable")
    reach = np.searchsorted(-blocks_of[chains], -np.arange(most), side="left").tolist()  # chains of more than j blocks
    for j in range(1, most):
        start = first_of[chains[: reach[j]]]
        here, last = rank[start + j], rank[start + j - 1]
        state = (before[last][:, None, :] @ through[last])[:, 0]
        before[here] = state / state.sum(axis=1, keepdims=True)
    for j in reversed(range(1, most)):
        start = first_of[chains[: reach[j]]]
        here, last = rank[start + j], rank[start + j - 1]
        state = (through[here] @ after[here][:, :, None])[:, :, 0]
        after[last] = state / state.sum(axis=1, keepdims=True)
    forward = np.empty_like(words)
    for t, n in enumerate(live):
        before[:n] = (before[:n] @ a) * words[t, :n]
        forward[t, :n] = before[:n]
    for t, n in reversed(list(enumerate(live))):
        forward[t, :n] *= after[:n]
        after[:n] = (after[:n] * words[t, :n]) @ a.T
    gamma = forward[column, row]
    return gamma / gamma.sum(axis=1, keepdims=True)


class Numbers(dict):
    """Numbers tokens in the order they are first asked for."""

    def __missing__(self, token):
        n = self[token] = len(self)
        return n


class Labeler:
    """Applies a model; factors of tokens are kept in a table of bounded size."""

    def __init__(self, model: Model, limit: int = 700_000):
        self.model, self.limit = model, limit
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.has_word = Numbers(), np.empty(0, bool)
        self.table = np.empty((0, len(self.model.languages)), np.float32)

    def _learn(self) -> None:
        """Factors of the tokens numbered since the last call; tokens without a letter have no word."""
        tokens = list(islice(self.numbers, len(self.table), None))
        words = list(map(core, tokens))
        has_word = np.fromiter(map(bool, words), bool, len(words))
        factors = np.ones((len(words), self.table.shape[1]), np.float32)
        if has_word.any():
            ids, owners = features([w for w in words if w])
            score = _emissions(self.model.weights, ids, owners, int(has_word.sum()))
            factors[has_word] = np.exp(score - score.max(axis=1, keepdims=True))
        self.table, self.has_word = np.concatenate([self.table, factors]), np.concatenate([self.has_word, has_word])

    def word_rows(self, docs: list[list[str]]) -> list[np.ndarray]:
        """Table rows of the words of every text."""
        if len(self.numbers) > self.limit:
            self._forget()
        rows = [np.fromiter(map(self.numbers.__getitem__, tokens), np.int64, len(tokens)) for tokens in docs]
        if len(self.numbers) > len(self.table):
            self._learn()
        return [r[self.has_word[r]] for r in rows]

    def label(self, texts: list[str]) -> list[tuple[str, float, list]]:
        """Language, score and runs (language, words) of every text."""
        found = self.word_rows([t.split() for t in texts])
        sizes = np.array([len(r) for r in found], np.int64)
        some = np.flatnonzero(sizes)
        out: list = [(UNDECIDED, 0.0, [])] * len(texts)
        if not len(some):
            return out
        rows = np.concatenate([found[i] for i in some])
        gamma = posteriors(self.table[rows].astype(float), sizes[some], self.model.transitions)
        starts = np.cumsum(sizes[some]) - sizes[some]
        means = np.add.reduceat(gamma, starts, axis=0) / sizes[some, None]
        best, words = means.argmax(axis=1), gamma.argmax(axis=1)
        names = self.model.languages
        for j, i in enumerate(some.tolist()):
            mine = words[starts[j] : starts[j] + sizes[i]]
            cuts = np.flatnonzero(np.diff(mine)) + 1
            runs = [(names[mine[a]], int(b - a)) for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(mine)])]
            out[i] = (names[best[j]], float(min(1.0, means[j, best[j]])), runs)
        return out


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, sample_chars: int = SAMPLE_CHARS) -> Model | None:
    """Fit a model on at most ``per_language`` rows of each language, chosen by a hash of the text."""
    known = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = known.select(F.col(lang_col).alias("lang"), F.left(F.col(text_col), F.lit(sample_chars)).alias("text"), F.xxhash64(text_col).alias("h"))
    order = Window.partitionBy("lang").orderBy("h", "text")
    sample = rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_language).orderBy("lang", "n").collect()
    return fit([r.text for r in sample], [r.lang for r in sample])


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` (0 to 1) and ``runs``: the stretches of words in one language, in order.

    Null and empty texts and texts without a letter are ``und`` with score 0 and no runs, as is everything without a
    model. All rows and other columns stay; columns named like the new ones are replaced.
    """

    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        labeler = Labeler(model) if model is not None else None
        for texts in batches:
            rows, held, words = [], [], 0
            for text in texts:
                held.append(text or "")
                words += len(held[-1]) // 6
                if words > BATCH_WORDS:
                    rows += labeler.label(held) if labeler else [(UNDECIDED, 0.0, [])] * len(held)
                    held, words = [], 0
            if held:
                rows += labeler.label(held) if labeler else [(UNDECIDED, 0.0, [])] * len(held)
            yield pd.DataFrame({
                "lang_pred": [r[0] for r in rows], "score": [r[1] for r in rows],
                "runs": [[{"lang": a, "words": b} for a, b in r[2]] for r in rows],
            })

    kind = "lang_pred string, score double, runs array<struct<lang:string,words:int>>"
    found = docs.withColumn("_language", F.pandas_udf(_typed(label), kind)(F.col(text_col)))
    return found.withColumns({c: F.col(f"_language.{c}") for c in ("lang_pred", "score", "runs")}).drop("_language")


def _typed(fn):
    """Give a function the type hints that Spark reads, as objects."""
    fn.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return fn


def held_out(doc_id: Column) -> Column:
    """A quarter of the documents, by their id; they are never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def identify_documents(docs: DataFrame) -> DataFrame:
    """Learn from the labelled documents that are not held out, and judge all of them."""
    marked = docs.withColumn("held_out", held_out(F.col("doc_id")))
    return identify(marked, learn(marked.filter(~F.col("held_out")).select("text", "lang")))


@registry.add("op2_language_crf")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify_documents(docs).select("doc_id", "held_out", "lang_pred", "score")
