"""BPE encoding and decoding with content-defined chunk reuse.

Texts are cut where a rolling hash of the last characters says so, so equal passages of different documents give equal
chunks wherever they stand. A Python worker encodes a chunk once and keeps it for all documents of its tasks, within a
bound of bytes; workers share nothing. What a cut may have torn apart is repaired by encoding the text around the join
again, from the last place before it to the first place after it where both sides agree with the whole text.

When do they agree? The byte-level pre-tokenizer reads from left to right and looks ahead only inside white space. A
place between a character that is no white space and one that is, is therefore always a token boundary, and what
stands on one side of it never changes the tokens of the other. Such a place is called a seam. A chunk keeps the
text before its first seam and after its last one as text; the join of two chunks is encoded from seam to seam.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from mnemolake.llm.shared import Memo, Registry, byte_tokens, table

registry = Registry()

WINDOW = 8  # characters that the rolling hash sees
MEAN_CHUNK = 64  # a power of two: one place in so many is a cut
# what a worker keeps at most, in bytes; a text without cuts is one chunk, too long to be kept
PART_BYTES, CHUNK_BYTES = 48 << 20, 24 << 20
ENTRY_BYTES = 200  # of an entry besides its characters and ids
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# from one seam to the next; characters that libraries class differently count as neither, so no seam stands beside them
_UNSURE = "\\x1c-\\x1f\\u180e\\u200b\\ufeff"
_PART = re.compile(f"[{_SPACE}{_UNSURE}]*(?:[^{_SPACE}{_UNSURE}]+(?:[{_UNSURE}]+[{_SPACE}{_UNSURE}]*)?)+|[{_SPACE}{_UNSURE}]+")
_ODD = re.compile(f"[{_UNSURE}]")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_CODECS: dict = {}


def cut_places(text: str) -> list[int]:
    """Ends of the chunks of a text: where the hash of the last ``WINDOW`` characters is a multiple of ``MEAN_CHUNK``."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(codes) <= WINDOW:
        return [len(codes)] if len(codes) else []
    mixed = (codes + np.uint64(1)) * _MULTIPLIER
    rolling = mixed[WINDOW - 1 :].copy()
    for back in range(1, WINDOW):
        rolling *= np.uint64(31)
        rolling += mixed[WINDOW - 1 - back : len(mixed) - back]
    rolling *= _MULTIPLIER
    ends = np.flatnonzero(rolling >> np.uint64(64 - MEAN_CHUNK.bit_length() + 1) == 0) + WINDOW
    ends = ends.tolist()
    if not ends or ends[-1] != len(codes):
        ends.append(len(codes))
    return ends


class ChunkCodec:
    """Encoder of one tokenizer file with bounded caches of parts and chunks."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.parts = Memo(self._encode_part, PART_BYTES, lambda part, ids: ENTRY_BYTES + len(part) + len(ids))
        self.chunks = Memo(self._encode_chunk, CHUNK_BYTES, lambda chunk, known: 3 * ENTRY_BYTES + 2 * len(chunk) + (len(known[1]) if known else 0))
        # the same merges: the rank of a merge is the id of its token, and every token is what its own bytes merge to
        ranks = {t: i for t, i in byte_tokens(self.tokenizer).items() if t.decode("utf-8", "replace") not in self.specials}
        self.merger = tiktoken.Encoding("parts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _encode_part(self, part: str) -> bytes:
        """Ids of the text between two seams: by the quick merger, or the library itself for special tokens and odd characters."""
        if any(t in part for t in self.specials) or _ODD.search(part):
            ids = self.tokenizer.encode(part, add_special_tokens=False).ids
        else:
            ids = self.merger.encode_ordinary(part)
        return array("i", ids).tobytes()

    def _encode_chunk(self, chunk: str) -> tuple[str, bytes, str] | None:
        """Text before the first seam, ids up to the last seam, text after it; None without a seam."""
        parts = _PART.findall(chunk)
        if len(parts) < 2:
            return None
        return parts[0], b"".join(map(self.parts.__getitem__, parts[1:-1])), parts[-1]

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids, equal to those of the whole text."""
        out, torn, start = [], "", 0
        for end in cut_places(text):
            chunk = text[start:end]
            start = end
            known = self.chunks[chunk]
            if known is None:  # no seam yet: the join goes on
                torn += chunk
                continue
            head, ids, tail = known
            # the join may hold a seam itself, where one chunk ends and the next begins with white space
            out += map(self.parts.__getitem__, _PART.findall(torn + head))
            out.append(ids)
            torn = tail
        out += map(self.parts.__getitem__, _PART.findall(torn))
        return b"".join(out)


def chunk_codec(path: str) -> ChunkCodec:
    """One codec for every file and Python worker: chunks are shared by all documents of its tasks."""
    if path not in _CODECS:
        _CODECS[path] = ChunkCodec(path)
    return _CODECS[path]


@lru_cache
def token_bytes(path: str) -> dict[int, bytes]:
    """The bytes of every id of a tokenizer file."""
    return {i: t for t, i in byte_tokens(Tokenizer.from_file(path)).items()}


def decode(ids: np.ndarray, tokens: dict[int, bytes]) -> str:
    """The text of ids; bytes that are no UTF-8 become U+FFFD."""
    return b"".join(map(tokens.__getitem__, ids.tolist())).decode("utf-8", "replace")


def encode_documents(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """Add ``ids``: the tokens of the whole text. Null and empty texts have none. Rows and other columns stay."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = chunk_codec(path)
        for texts in batches:
            yield pd.Series([np.frombuffer(codec.encode(t), "<i4") if t else np.empty(0, "<i4") for t in texts], dtype=object)

    return docs.withColumn("ids", encode(F.col(text_col)))


def decode_documents(docs: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """Add ``decoded``: the text of an array of ids; null arrays give null. An unknown id fails the task."""

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = token_bytes(path)
        for rows in batches:
            yield pd.Series([None if ids is None else decode(np.asarray(ids), tokens) for ids in rows], dtype=object)

    return docs.withColumn("decoded", decoded(F.col(ids_col)))


def round_trip(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """Add ``coded``: the number of tokens of the whole text, and digests of its ids and of the text they decode to.

    Encoding and decoding share one Python worker, and neither ids nor decoded texts leave it. Null counts as empty.
    """

    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec, tokens = chunk_codec(path), token_bytes(path)
        for texts in batches:
            rows = []
            for text in texts:
                ids = np.frombuffer(codec.encode(text or ""), "<i4")
                spelled, again = ",".join(map(str, ids.tolist())), decode(ids, tokens)
                rows.append((len(ids), hashlib.sha256(spelled.encode()).hexdigest(), hashlib.sha256(again.encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    # the type hints of the function say which kind of UDF it is
    return docs.withColumn("coded", F.pandas_udf(coded, "n_tokens long, ids_sha256 string, decoded_sha256 string")(F.col(text_col)))


@registry.add("op3_chunk_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "coded.*")
