"""Encode a corpus with a public byte-level BPE vocabulary (problem 7).

A pre-token is encoded with a hierarchical-bitmap rank queue: one bucket per merge rank holds the left positions of the
pairs of that rank in a linked list of symbols, a three-level bitmap over the ranks gives the lowest rank in use by
find-first-set, and entries that a merge has made stale are skipped when they come up. A pre-token of n bytes takes
O(n log n) however long it is, so a text without any white space costs no more than another.

Tokenizers are never trained or copied here: the vocabulary file is a parameter.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoloom.session import spread

#: Pre-token pattern that belongs to the vocabulary. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pre-tokens whose ids a worker remembers; beyond it the memory is emptied, so it stays bounded.
CACHE_ENTRIES = 300_000
#: Longer pre-tokens are not remembered.
CACHE_LENGTH = 64


def default_vocabulary() -> str:
    """Where the public tokenizer files are installed."""
    try:
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.tiktoken")
    except ImportError:
        return "/opt/tokenizers/byte_bpe_50k.tiktoken"


class RankQueue:
    """Priority queue of (rank, position) over ranks below ``size``: buckets under a three-level bitmap."""

    __slots__ = ("buckets", "low", "mid", "top")

    def __init__(self, size: int) -> None:
        words = size // 64 + 1
        self.buckets: dict[int, list[int]] = {}
        self.low = [0] * words
        self.mid = [0] * (words // 64 + 1)
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            word = rank >> 6
            self.low[word] |= 1 << (rank & 63)
            self.mid[word >> 6] |= 1 << (word & 63)
            self.top |= 1 << (word >> 6)
        else:
            heapq.heappush(bucket, position)

    def pop(self) -> tuple[int, int] | None:
        """The leftmost position of the lowest rank in use, or None."""
        if not self.top:
            return None
        outer = (self.top & -self.top).bit_length() - 1
        mid = self.mid[outer]
        word = (outer << 6) | ((mid & -mid).bit_length() - 1)
        low = self.low[word]
        rank = (word << 6) | ((low & -low).bit_length() - 1)
        bucket = self.buckets[rank]
        position = heapq.heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.low[word] &= ~(1 << (rank & 63))
            if not self.low[word]:
                self.mid[outer] &= ~(1 << (word & 63))
                if not self.mid[outer]:
                    self.top &= ~(1 << outer)
        return rank, position


class Encoder:
    """Byte-level BPE over a file of ``base64(token) rank`` lines."""

    def __init__(self, vocabulary: str) -> None:
        with open(vocabulary, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.size = max(self.ranks.values()) + 1
        self.split = regex.compile(PATTERN).findall
        self.queue = RankQueue(self.size)
        self.cache: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one pre-token."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return (whole,)
        n = len(piece)
        token: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = self.queue
        for i in range(n - 1):
            rank = ranks.get(piece[i : i + 2])
            if rank is not None:
                queue.push(rank, i)
        while (entry := queue.pop()) is not None:
            rank, i = entry
            left = token[i]
            if left is None or (j := after[i]) >= n:
                continue
            joined = left + token[j]
            if ranks.get(joined) != rank:
                continue  # stale: one side has changed since the entry was made
            token[i], token[j] = joined, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                rank = ranks.get(joined + token[k])
                if rank is not None:
                    queue.push(rank, i)
            h = before[i]
            if h >= 0:
                rank = ranks.get(token[h] + joined)
                if rank is not None:
                    queue.push(rank, h)
        return tuple(ranks[t] for t in token if t is not None)

    def encode(self, text: str) -> list[int]:
        """Ids of a text; a lone surrogate, which no table can hold, counts as a question mark."""
        cache, out = self.cache, []
        for piece in self.split(text):
            ids = cache.get(piece)
            if ids is None:
                ids = self.merge(piece.encode("utf-8", "replace"))
                if len(piece) <= CACHE_LENGTH:
                    if len(cache) >= CACHE_ENTRIES:
                        cache.clear()
                    cache[piece] = ids
            out += ids
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """The worker's encoder for a vocabulary file, loaded once per Python worker."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def encode_corpus(documents: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids`` (array<int>), one row per input row.

    A null or empty text has no tokens: its ``ids`` is the empty array, never null. Repeated rows give repeated rows;
    a null id stays null; other columns are ignored. A narrow map: no shuffle beyond a spread of too few splits.
    """
    path = vocabulary or default_vocabulary()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_text = encoder(path).encode
        for batch in batches:
            offsets, values = [0], []
            for text in batch.column(1).to_pylist():
                if text:
                    values += encode_text(text)
                offsets.append(len(values))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_col, "ids"])

    source = spread(documents.select(id_col, text_col), id_col)
    return source.mapInArrow(encode, f"{id_col} {source.schema[id_col].dataType.simpleString()}, ids array<int>")


def count_tokens(documents: DataFrame, keep: list[str], vocabulary: str | None = None, text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and ``n_tokens``, 0 for a null or empty text; the ids never leave the worker."""
    path = vocabulary or default_vocabulary()
    source = spread(documents.select(*keep, text_col), keep[0])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_text = encoder(path).encode
        for batch in batches:
            sizes = [len(encode_text(t)) if t else 0 for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(sizes, pa.int64())], names=[*keep, "n_tokens"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields if f.name in keep)
    return source.mapInArrow(count, f"{fields}, n_tokens bigint")


def token_stats(documents: DataFrame, by: str = "source") -> DataFrame:
    """Documents and tokens per value of ``by``."""
    return count_tokens(documents, ["doc_id", by]).groupBy(by).agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
