"""Problem 7: every text as its token ids of a public byte-level tokenizer.

A text is split by the tokenizer's pattern, and each pre-token's bytes are merged by rank with a hierarchical-bitmap
rank queue: a bucket per merge rank holds the positions in a linked list where that merge applies, three levels of
bitmaps tell the lowest rank that has any by find-first-set, and entries made stale by other merges are skipped when
met. A pre-token of n bytes takes time in proportion to n, so one very long pre-token is no worse than many short ones.
Pre-tokens seen before are remembered, up to a fixed number, since most of a corpus repeats them.

Cases: a null or an empty text has an empty list; blanks and control characters are encoded as they are; strings that
look like special tokens are ordinary text; repeated rows keep a row each; extra columns are ignored. Needed are doc_id
and text. The rank file's path is a parameter; it is read on the driver and broadcast (50,256 ranks).
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

RANK_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value of the tokenizer: the pattern that splits text before the merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens remembered by a task, and the longest one that is.
REMEMBERED, LONGEST = 300_000, 64


def read_ranks(path: str = RANK_FILE) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class RankQueue:
    """Positions by merge rank, lowest rank first; three levels of 64-bit words say which ranks have any."""

    def __init__(self):
        self.buckets: dict[int, list[int]] = {}
        self.low: dict[int, int] = {}
        self.middle: dict[int, int] = {}
        self.top = 0

    def add(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        a, b = rank >> 6, rank >> 12
        self.low[a] = self.low.get(a, 0) | 1 << (rank & 63)
        self.middle[b] = self.middle.get(b, 0) | 1 << (a & 63)
        self.top |= 1 << b

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank and its positions from left to right, removed; None if there is none."""
        if not self.top:
            return None
        b = (self.top & -self.top).bit_length() - 1
        word = self.middle[b]
        a = b << 6 | (word & -word).bit_length() - 1
        bits = self.low[a]
        rank = a << 6 | (bits & -bits).bit_length() - 1
        bits &= bits - 1
        self.low[a] = bits
        if not bits:
            word &= ~(1 << (a & 63))
            self.middle[b] = word
            if not word:
                self.top &= ~(1 << b)
        bucket = self.buckets.pop(rank)
        bucket.sort()
        return rank, bucket


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token. A merge makes a token of higher rank than its parts, so merges it enables come later
    in the queue, and within one rank they are done from left to right."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    alive = bytearray(b"\x01") * n
    queue = RankQueue()
    get = ranks.get
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            queue.add(rank, i)
    while (item := queue.pop()) is not None:
        rank, positions = item
        for i in positions:
            if not alive[i]:
                continue
            j = end[i]
            if j >= n or get(piece[i : end[j]]) != rank:
                continue  # stale: one of the two parts has grown since
            stop = end[j]
            end[i], alive[j] = stop, 0
            if stop < n:
                before[stop] = i
                after = get(piece[i : end[stop]])
                if after is not None:
                    queue.add(after, i)
            left = before[i]
            if left >= 0:
                joined = get(piece[left:stop])
                if joined is not None:
                    queue.add(joined, left)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str = SPLIT):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for piece in self.split(text):
            ids = known.get(piece)
            if ids is None:
                ids = merge(piece.encode("utf-8"), self.ranks)
                if len(piece) <= LONGEST:
                    known[piece] = ids
            out += ids
        return out


def _encode(held) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(held.value)
        for batch in batches:
            names, texts = batch.column("doc_id"), batch.column("text")
            for at in range(0, batch.num_rows, 1000):
                lists = [encoder.encode(t) for t in texts.slice(at, 1000).to_pylist()]
                offsets = np.cumsum([0, *map(len, lists)], dtype=np.int32)
                flat = pa.array(np.fromiter((i for x in lists for i in x), np.int32, int(offsets[-1])))
                yield pa.RecordBatch.from_arrays([names.slice(at, 1000), pa.ListArray.from_arrays(pa.array(offsets), flat)], ["doc_id", "ids"])

    return run


def token_ids(documents: DataFrame, path: str = RANK_FILE) -> DataFrame:
    """(doc_id, ids) of every row of ``documents``; no shuffle."""
    held = documents.sparkSession.sparkContext.broadcast(read_ranks(path))
    return documents.select("doc_id", "text").mapInArrow(_encode(held), "doc_id long, ids array<int>")
