"""Byte-level BPE with a hierarchical-bitmap rank queue.

Bytes of all pre-tokens of a batch stand in one linked list, cut between pre-tokens. Every adjacent pair that is a
token lies in the bucket of its merge rank; a bitmap of three levels over the ranks gives the lowest bucket in use by
find-first-set. Its positions are merged from left to right, the pairs this creates go to their buckets (a lower rank
simply becomes the first set bit), and entries whose pair has changed since are stale and skipped. Pre-tokens share no
pair, so one queue serves the batch and a bucket is merged with array operations. A pre-token of n bytes costs
O(n log n) at worst, however long it is.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from granary.llm.chunks import Memory
from granary.llm.common import slices, text_column


class RankQueue:
    """Ranks in use, as a bitmap with two summary levels; ``buckets[r]`` holds arrays of list positions."""

    def __init__(self, ranks: int):
        self.low = [0] * (ranks // 64 + 1)
        self.mid = [0] * (ranks // 4096 + 1)
        self.top = 0
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, ranks: np.ndarray, at: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        ranks, at = ranks[order], at[order]
        starts = np.flatnonzero(np.diff(ranks, prepend=-1))
        for r, a, b in zip(ranks[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(ranks)], strict=True):
            held = self.buckets.get(r)
            if held is None:
                self.buckets[r] = [at[a:b]]
                self.low[r >> 6] |= 1 << (r & 63)
                self.mid[r >> 12] |= 1 << ((r >> 6) & 63)
                self.top |= 1 << (r >> 12)
            else:
                held.append(at[a:b])

    def pop(self) -> tuple[int, np.ndarray]:
        """The lowest rank in use with its positions in ascending order."""
        i = (self.top & -self.top).bit_length() - 1
        j = i << 6 | ((self.mid[i] & -self.mid[i]).bit_length() - 1)
        r = j << 6 | ((self.low[j] & -self.low[j]).bit_length() - 1)
        self.low[j] &= self.low[j] - 1
        if not self.low[j]:
            self.mid[i] &= self.mid[i] - 1
            if not self.mid[i]:
                self.top &= self.top - 1
        held = self.buckets.pop(r)
        return r, held[0] if len(held) == 1 else np.unique(np.concatenate(held))

    def __bool__(self) -> bool:
        return self.top != 0


class Ranks:
    """A vocabulary of byte strings with their ranks; a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values()) + 1
        self.tokens = [b""] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each concatenation, or -1 where it is no token."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], -1)

    def encode(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the bytes, no token reaching over one of ``ends`` (ascending, the last is the number of bytes); bytes of each."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # one cell more than bytes: its token is none, and no pair holds it
        token = np.append(self.single[data], -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        last = np.zeros(n + 1, bool)
        last[ends - 1] = True
        rank = np.full(n + 1, -1, np.int64)
        inner = np.flatnonzero(~last[:n])
        rank[inner] = self.pair(token[inner], token[inner + 1])
        after[:n][last[:n]] = n  # the list is cut after each string
        before[0] = n
        before[ends[:-1]] = n
        alive = np.ones(n, bool)
        queue = RankQueue(self.size)
        first = np.flatnonzero(rank >= 0)
        if len(first):
            queue.push(rank[first], first)
        while queue:
            r, at = queue.pop()
            at = at[rank[at] == r]  # the others are stale
            if not len(at):
                continue
            if len(at) > 1:
                chained = np.concatenate([[False], after[at[:-1]] == at[1:]])
                if chained.any():  # overlapping pairs as in "aaa": every second one of a run
                    place = np.arange(len(at))
                    run = np.maximum.accumulate(np.where(chained, 0, place))
                    at = at[(place - run) % 2 == 0]
            gone = after[at]
            rest = after[gone]
            token[at] = r
            alive[gone] = False
            rank[gone] = -1
            after[at] = rest
            before[rest] = at
            rank[at] = np.where(rest < n, self.pair(np.full(len(at), r), token[rest]), -1)
            left = before[at]
            left = left[left < n]
            rank[left] = self.pair(token[left], token[after[left]])
            changed = np.concatenate([at, left])
            changed = changed[rank[changed] >= 0]
            if len(changed):
                queue.push(rank[changed], changed)
        at = np.flatnonzero(alive)
        return token[at], np.diff(at, append=n)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def read_ranks(data: bytes) -> Ranks:
    """Lines of base64 token and rank."""
    return Ranks({base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())})


@lru_cache(1)
def _encoder(path: str, pattern: str) -> tuple[Ranks, Memory]:
    """Per worker: the rank table with the pieces encoded so far."""
    import regex

    with open(path, "rb") as f:
        ranks = read_ranks(f.read())
    split = regex.compile(pattern).findall

    def encode(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for text in texts:
            data = np.frombuffer(text.encode(), np.uint8)
            begins = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # of characters
            yield ranks.encode(data, begins[np.cumsum([len(x) for x in split(text)], dtype=np.int64)])

    return ranks, Memory(encode, most=150_000, joined=1_000_000)


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids]) per row: the text encoded by ``path``'s ranks and decoded again.

    ``path`` is the vocabulary file on every machine (base64 token and rank per line). Every match of ``pattern`` is
    encoded separately, and no special token is known. Null is the empty text, which has no ids. Repeated rows stay.
    ``keep_ids`` adds the ids as an array. Other columns are not carried.
    """
    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks, memory = _encoder(path, pattern)
        for batch in slices(batches, "text", 2_000_000):
            rows = []
            for doc_id, coded in zip(batch.doc_id, memory.batch(batch.text.tolist()), strict=True):
                ids = np.frombuffer(coded, "<u4")
                row = (doc_id, len(ids), hashlib.sha256(coded).hexdigest(), hashlib.sha256(ranks.decode(ids)).hexdigest())
                rows.append((*row, ids.astype("int32")) if keep_ids else row)
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in kinds.split(", ")])
            yield out.astype({"doc_id": "Int64"})

    chosen = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_column(text_col).alias("text"))
    return chosen.mapInPandas(run, kinds)
