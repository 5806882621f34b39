"""Byte-pair encoding of a corpus with a public vocabulary of ranks.

A text is cut into words by a fixed pattern; the bytes of a word are the first symbols of a doubly
linked list. A priority queue holds the neighbouring pairs that the vocabulary can merge, lowest rank
first, then leftmost. Merging a pair relinks the list and queues the new pairs; entries whose symbols
have changed meanwhile are stale and skipped. n bytes take O(n log n), so a word of a million
characters is no trouble. Words seen before come from a bounded memory.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class BytePairEncoder:
    """Encodes and decodes; the text of a special token is ordinary text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, remember: int = 300_000) -> None:
        self.ranks, self.remember = ranks, remember
        self.words = regex.compile(pattern)
        self.known: dict[str, tuple[int, ...]] = {}
        self.bytes_of = {rank: token for token, rank in ranks.items()}

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word's bytes."""
        ranks = self.ranks
        n = len(word)
        start = list(range(n))
        end = list(range(1, n + 1))  # the symbol at i is word[start[i]:end[i]]; end 0: merged away
        before = list(range(-1, n - 1))
        after = [*range(1, n), -1]
        queue = []
        for i in range(n - 1):
            if (rank := ranks.get(word[i : i + 2])) is not None:
                queue.append((rank, i, i + 1, i + 2))
        heapq.heapify(queue)
        while queue:
            _, left, right, stop = heapq.heappop(queue)
            if not end[left] or after[left] != right or end[right] != stop:
                continue  # stale
            end[left], end[right] = stop, 0
            after[left] = after[right]
            if after[left] >= 0:
                before[after[left]] = left
                follower = after[left]
                if (rank := ranks.get(word[left : end[follower]])) is not None:
                    heapq.heappush(queue, (rank, left, follower, end[follower]))
            if before[left] >= 0:
                leader = before[left]
                if (rank := ranks.get(word[leader:stop])) is not None:
                    heapq.heappush(queue, (rank, leader, left, stop))
        out, i = [], 0 if n else -1
        while i >= 0:
            out.append(ranks[word[start[i] : end[i]]])
            i = after[i]
        return out

    def encode_word(self, word: str) -> tuple[int, ...]:
        ids = self.known.get(word)
        if ids is None:
            raw = word.encode("utf-8")
            ids = (self.ranks[raw],) if raw in self.ranks else tuple(self.merge(raw))
            if len(word) <= 64:
                if len(self.known) >= self.remember:
                    self.known.clear()
                self.known[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for an empty or null one."""
        out: list[int] = []
        known, encode_word = self.known, self.encode_word
        for word in self.words.findall(text or ""):
            out += known.get(word) or encode_word(word)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")


def encode_texts(df: DataFrame, key: str, text: str, ranks_path: str) -> DataFrame:
    """``(<key>, ids)``, one row per input row. Null and empty texts give an empty list.

    The vocabulary is read on the driver and sent out once; its size is fixed. Rows keep their
    partition: nothing is shuffled.
    """
    kind = df.schema[key].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = BytePairEncoder(shared.value)
        for batch in batches:
            at, flat, ends = 0, [], [0]
            for row, value in enumerate(batch.column(1)):
                flat += encoder.encode(value.as_py())
                ends.append(len(flat))
                if len(flat) > 2_000_000 or row == batch.num_rows - 1:
                    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, np.int32)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, row + 1 - at), ids], names=["key", "ids"])
                    at, flat, ends = row + 1, [], [0]

    out = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, ids array<int>")
    return out.withColumnRenamed("key", key)
