"""Best-fit packing of token sequences with large-item matching.

Documents are tokenized and cut in Arrow batches; only (id, piece, length) rows are dealt to groups of bounded size,
and every group is packed on its own: pieces above a third of the capacity pair at most twice per sequence by
greedy matching, smaller ones go to the fullest sequence they fit.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from mnemolake.llm.shared import Memo, Registry, byte_tokens, stored, table

registry = Registry()

CAPACITY = 4096
END = 1
GROUP_PIECES = 20_000
PIECES = "piece int, start long, length long, ids array<int>, ids_crc32 long"
_WORD = re.compile(r"[^ \t\n\r\x0b\x0c]+")
MARK = "\0"  # end of a word for the merger; words that hold it go to the library
_PLAIN = re.compile("[!-~\u00c0-\u00ff]+")
#: the tokenizer's own split, for plain characters
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
_MARKED = "\\g<0>" + MARK
_ENCODERS: dict = {}


class WordEncoder:
    """Ids of a text under a tokenizer that drops white space and never merges across it.

    Such a tokenizer encodes a text as the concatenation of its words, so words are encoded once and kept in a
    bounded cache. The normalizer (NFC, lower case) works within words: ASCII white space composes with nothing.
    Words of plain Latin letters, digits and ASCII signs go to a quick merger with the same merges (the rank of a merge
    is the id of its token, and every token is what its own characters merge to); all others to the library.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = {t: i for t, i in byte_tokens(self.tokenizer, "</w>", MARK.encode()).items() if t.decode("utf-8", "replace") not in self.specials}
        self.merger = tiktoken.Encoding("words", pat_str=f"[^{MARK}]*{MARK}", mergeable_ranks=ranks, special_tokens={})
        self.memo = Memo(self._make, 300_000)

    def _make(self, word: str) -> bytes:
        if _PLAIN.fullmatch(word) and not any(t in word for t in self.specials):
            ids = self.merger.encode_ordinary(_PIECE.sub(_MARKED, word.lower()))
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        return b"".join(map(self.memo.__getitem__, _WORD.findall(text)))


def word_encoder(path: str) -> WordEncoder:
    """One encoder for every file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def token_pieces(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END, id_col: str = "doc_id", text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids`` and ``ids_crc32``.

    A document is its ids and ``end_id``; a null or empty text is ``end_id`` alone. Only documents longer than the
    capacity are cut, every ``capacity`` tokens. ``with_ids=False`` leaves ``ids`` null, which saves moving them.
    """

    @F.pandas_udf(f"array<struct<{PIECES.replace(' ', ':').replace(',:', ',')}>>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder, end = word_encoder(path), np.uint32(end_id).astype("<u4").tobytes()
        for texts in batches:
            rows = []
            for text in texts:
                raw = encoder.ids(text or "") + end
                pieces = []
                for i, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    ids = np.frombuffer(part, "<i4") if with_ids else None
                    pieces.append({"piece": i, "start": at // 4, "length": len(part) // 4, "ids": ids, "ids_crc32": zlib.crc32(part)})
                rows.append(pieces)
            yield pd.Series(rows)

    cut_rows = docs.select(F.col(id_col).alias(id_col), F.explode(cut(F.col(text_col))).alias("p"))
    return cut_rows.select(id_col, "p.*")


def fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every length.

    Large items (over a third) are matched greedily: from the longest down, each takes the longest other large item
    that still fits. Then the rest, longest first, go into the bin whose gap they fill best, or open a new one.
    """
    order = np.argsort(-lengths, kind="stable").tolist()
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    size = lengths.tolist()
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]  # large items by length
    gaps: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by what is left
    open_gaps = large = count = 0
    third = capacity // 3
    for i in reversed(order):
        if size[i] > third:
            waiting[size[i]].append(i)
            large |= 1 << size[i]

    def take(length):
        nonlocal large
        item = waiting[length].pop()
        if not waiting[length]:
            large &= ~(1 << length)
        return item

    def leave(b, gap):
        nonlocal open_gaps
        if gap:
            gaps[gap].append(b)
            open_gaps |= 1 << gap

    while large:
        first = take(large.bit_length() - 1)
        bins[first], offsets[first], gap = count, 0, capacity - size[first]
        fits = large & ((1 << (gap + 1)) - 1)
        if fits:
            second = take(fits.bit_length() - 1)
            bins[second], offsets[second] = count, size[first]
            gap -= size[second]
        leave(count, gap)
        count += 1
    for i in order:
        n = size[i]
        if n > third:
            continue
        fits = open_gaps >> n
        if fits:
            gap = n + (fits & -fits).bit_length() - 1
            b = gaps[gap].pop()
            if not gaps[gap]:
                open_gaps &= ~(1 << gap)
        else:
            b, gap, count = count, capacity, count + 1
        bins[i], offsets[i] = b, capacity - gap
        leave(b, gap - n)
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` from 1 to the capacity.

    Rows are dealt by a hash of their columns to so many groups that one holds about ``group_pieces`` rows however
    large the input; a group wastes less than a sequence or two, about one in ten thousand. Whole pieces of full length
    fill a sequence alone. Equal rows (copies) spread over the groups by a running number, so none is hot. An empty
    table gives no rows.
    """
    rows = stored(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-rows.count() // group_pieces))

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_row", ignore_index=True)
        bins, offsets = fit(rows["length"].to_numpy(), capacity)
        return rows.assign(sequence_id=rows["_group"].to_numpy() * (1 << 32) + bins, offset=offsets)

    dealt = rows.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)).cast("long"))
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema]
    placed = dealt.groupBy("_group").applyInPandas(place, ", ".join([*kept, "sequence_id long", "offset long"]))
    return placed.drop("_row", "_group")


def packed_sequences(packed: DataFrame) -> DataFrame:
    """The training sequences: ``sequence_id`` and the ``ids`` of its pieces in order, at most a capacity each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


@registry.add("op10_best_fit_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False).drop("ids")
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
