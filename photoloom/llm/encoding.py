"""Encoding of a corpus with a public byte-level BPE tokenizer (problem 6), by merge replay.

Merges never cross the words that the tokenizer's pattern cuts a text into, so every distinct word is encoded once and looked up
from then on.  The words that a block of the corpus adds are encoded together: an inverted index maps each pair of neighbouring
tokens to the positions where it stands, a heap gives the pairs in rank order, and each merge is replayed at all positions of its
pair at once; only the two neighbours of a merged token get new pairs in the index.

The index is sharded by blocks of documents, not by words: no word is ever sent anywhere, the plan has no shuffle, and a word that
a third of all texts hold costs one lookup each.  The words kept by a worker are bounded (``WORDS``); beyond, the oldest half goes.

Defined results
---------------
* a null or empty text has the empty list (a null text is told apart by its own column, if the caller keeps it).
* the strings of special tokens are ordinary text; lone surrogates cannot occur in a column of strings.
* a text of any length is encoded whole; repeated rows are encoded like any others; an empty table gives an empty result.
* extra columns are not looked at; ``ids`` replaces nothing, as only the key and the ids come out.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Vocabulary file (a parameter of every function that encodes): lines of base64 token and rank.
BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that cuts texts into words, as the vocabulary's publishers state it (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Most words that a worker keeps.
WORDS = 400_000


@lru_cache(maxsize=2)
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=2)
def cutter(pattern: str):
    return regex.compile(pattern)


def replay(words: list[bytes], ranks: dict[bytes, int]) -> list[list[int]]:
    """The token ids of each word: all merges over all words, in rank order."""
    text: list[bytes] = []
    after: list[int] = []
    before: list[int] = []
    starts = []
    for w in words:
        starts.append(len(text))
        base = len(text)
        text.extend(w[i : i + 1] for i in range(len(w)))
        before.extend([-1, *range(base, base + len(w) - 1)] if w else [])
        after.extend([*range(base + 1, base + len(w)), -1] if w else [])
    index: dict[tuple[bytes, bytes], list[int]] = {}
    heap: list[tuple[int, bytes, bytes]] = []

    def note(p: int) -> None:
        pair = (text[p], text[after[p]])
        at = index.get(pair)
        if at is not None:
            at.append(p)
        elif (rank := ranks.get(pair[0] + pair[1])) is not None:
            index[pair] = [p]
            heapq.heappush(heap, (rank, *pair))

    for p, n in enumerate(after):
        if n >= 0:
            note(p)
    while heap:
        # Pairs that give the same token have one rank: they are replayed together, from left to right.
        rank, a, b = heapq.heappop(heap)
        spots = [(p, a, b) for p in index.pop((a, b))]
        while heap and heap[0][0] == rank:
            _, a, b = heapq.heappop(heap)
            spots += [(p, a, b) for p in index.pop((a, b))]
        spots.sort()
        for p, a, b in spots:
            n = after[p]
            # A position may have changed since it was noted.
            if text[p] != a or n < 0 or text[n] != b:
                continue
            text[p] = a + b
            text[n] = b""
            after[p] = after[n]
            after[n] = -1
            if after[p] >= 0:
                before[after[p]] = p
                note(p)
            if before[p] >= 0:
                note(before[p])
    out = []
    for w, p in zip(words, starts, strict=True):
        ids = []
        while w and p >= 0:
            ids.append(ranks[text[p]])
            p = after[p]
        out.append(ids)
    return out


class Encoder:
    """Encodes texts, keeping the ids of the words it has met (as little-endian 32-bit integers)."""

    def __init__(self, path: str = BYTE_BPE_50K, pattern: str = PATTERN, words: int = WORDS):
        self.ranks, self.cut, self.most, self.known = ranks_of(path), cutter(pattern), words, {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        cut = [self.cut.findall(t) if t else [] for t in texts]
        if len(self.known) > self.most:
            self.known = dict(islice(self.known.items(), len(self.known) // 2, None))
        new = list({w for words in cut for w in words}.difference(self.known))
        for w, ids in zip(new, replay([w.encode() for w in new], self.ranks), strict=True):
            self.known[w] = np.array(ids, dtype="<i4").tobytes()
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in cut]


def _batches(path: str, key: str, counts: bool):
    #: Texts that are encoded at once: they bound the words and the index of a block.
    block = 2048

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for whole in batches:
            for k in range(0, whole.num_rows, block):
                batch = whole.slice(k, block)
                ids = encoder.encode(batch.column(1).to_pylist())
                sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
                if counts:
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes)], names=[key, "n_tokens"])
                else:
                    ends = np.concatenate([[0], np.cumsum(sizes)])
                    lists = pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))
                    yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "ids"])

    return work


def encode(documents: DataFrame, *, key: str = "doc_id", text: str = "text", tokenizer: str = BYTE_BPE_50K) -> DataFrame:
    """``key``, ids (array of int) of each row."""
    kind = dict(documents.dtypes)[key]
    return documents.select(key, text).mapInArrow(_batches(tokenizer, key, counts=False), f"`{key}` {kind}, ids array<int>")


def token_counts(documents: DataFrame, *, key: str = "doc_id", text: str = "text", tokenizer: str = BYTE_BPE_50K) -> DataFrame:
    """``key``, n_tokens (long) of each row."""
    kind = dict(documents.dtypes)[key]
    return documents.select(key, text).mapInArrow(_batches(tokenizer, key, counts=True), f"`{key}` {kind}, n_tokens long")
