"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary (hash and displace: n keys, n slots) resolves every
pre-token that is a vocabulary entry as it stands. Tier two: the others are merged with a heap of candidate
pairs over a doubly linked list of bytes, lowest rank first and leftmost among equals, in O(n log n). Both tiers
see each distinct pre-token once per lookup generation of a worker.

Defined results: a null text is an empty one and has no ids; null ids decode to empty bytes; ids and repeated
rows are kept; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_texts, text_slices


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PerfectHash:
    """A minimal perfect hash: each of n distinct keys gets its own slot below n."""

    def __init__(self, keys: list[bytes], per_bucket: int = 4):
        n = self.n = len(keys)
        self.buckets = max(1, n // per_bucket)
        for self.seed in range(64):
            h = self._hash(keys)
            if len(np.unique(h)) == n:
                break
        b = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(b, kind="stable")
        starts = np.searchsorted(b[order], np.arange(self.buckets + 1))
        taken = np.zeros(n, bool)
        self.shift = np.zeros(self.buckets, np.int64)
        sizes = np.diff(starts)
        tries = np.arange(1, 65, dtype=np.uint64)
        for k in np.argsort(-sizes, kind="stable"):
            if sizes[k] < 2:
                break
            own = h[order[starts[k] : starts[k + 1]]]
            first = 0
            while True:  # 64 displacements at a time: the first that sends the bucket to free, distinct slots
                at = np.sort(self._slot(own[None, :], tries[:, None] + np.uint64(first)), axis=1)
                good = ~taken[at].any(axis=1) & (at[:, 1:] != at[:, :-1]).all(axis=1)
                if good.any():
                    break
                first += len(tries)
            taken[at[i := int(good.argmax())]] = True
            self.shift[k] = first + i + 1
        free = np.flatnonzero(~taken)
        single = np.flatnonzero(sizes == 1)  # the rest take what is free: minus one minus the slot
        self.shift[single] = -1 - free[: len(single)]

    def _hash(self, keys: list[bytes]) -> np.ndarray:
        return np.fromiter((xxhash.xxh64_intdigest(k, self.seed) for k in keys), np.uint64, len(keys))

    def _slot(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        x = (h ^ (np.atleast_1d(d) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(32)
        return (x % np.uint64(self.n)).astype(np.int64)

    def __call__(self, keys: list[bytes]) -> np.ndarray:
        """Slots; a key outside the set gets the slot of some other key, which the caller compares."""
        h = self._hash(keys)
        d = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        return np.where(d < 0, -1 - d, self._slot(h, np.abs(d).astype(np.uint64)))


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a pre-token: a heap of pairs over linked bytes."""
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or (j := after[i]) >= n or after[j] != end:
            continue
        alive[j] = False
        after[i] = end
        if end < n:
            before[end] = i
            if (r := ranks.get(piece[i : after[end]])) is not None:
                heapq.heappush(heap, (r, i, after[end]))
        if (p := before[i]) >= 0 and (r := ranks.get(piece[p:end])) is not None:
            heapq.heappush(heap, (r, p, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Encoder:
    """ids of a text as little-endian 32-bit integers.

    The pattern never joins what stands before a space to what follows it, unless white space stands on both
    sides, so a text is cut at its spaces and each run (with its space) is split by the pattern once per lookup
    generation. Texts with such white space are split as a whole.
    """

    #: bytes of a lookup before it starts afresh (with what Python needs for an entry); bounds a worker's memory and
    #: never changes a result
    MEMO, ENTRY = 125 << 20, 200

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.spaced = re.compile(r" (?=\s|\Z)(?<=\s )").search
        keys = list(ranks)
        self.hashed = PerfectHash(keys)
        self.key_at: list[bytes] = [b""] * len(keys)
        for key, slot in zip(keys, self.hashed(keys).tolist(), strict=True):
            self.key_at[slot] = key
        self.pieces: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.pieces_size = self.runs_size = 0
        self.whole = pattern != public_tokenizers.PATTERN  # another pattern may join runs

    def _learn(self, pieces: list[str]) -> None:
        raw = [p.encode() for p in pieces]
        for piece, b, slot in zip(pieces, raw, self.hashed(raw).tolist(), strict=True):
            ids = [self.ranks[b]] if self.key_at[slot] == b else merge(b, self.ranks)
            self.pieces[piece] = b"".join([i.to_bytes(4, "little") for i in ids])
            self.pieces_size += self.ENTRY + 4 * len(piece) + 4 * len(ids)

    def _split(self, texts: list[str]) -> list[bytes]:
        found, known = [self.split(t) for t in texts], self.pieces
        new = {p for f in found for p in f}.difference(known)
        if new:
            if self.pieces_size > self.MEMO:
                known.clear()
                self.pieces_size = 0
                new = {p for f in found for p in f}
            self._learn(list(new))
        return [b"".join([known[p] for p in f]) for f in found]

    def __call__(self, text: str) -> bytes:
        if self.whole or self.spaced(text):
            return self._split([text])[0]
        first, *rest = text.split(" ")
        known = self.runs
        head = self._split([first])[0] if first else b""
        try:
            return head + b"".join([known[r] for r in rest])
        except KeyError:
            if self.runs_size > self.MEMO:
                known.clear()
                self.runs_size = 0
            new = list(set(rest).difference(known))
            ids = self._split([f" {r}" for r in new])
            known.update(zip(new, ids, strict=True))
            self.runs_size += sum(self.ENTRY + 4 * len(r) + len(i) for r, i in zip(new, ids, strict=True))
            return head + b"".join([known[r] for r in rest])


@lru_cache(1)
def _encoder(path: str, pattern: str) -> Encoder:
    """One for each worker process, which runs many tasks."""
    return Encoder(read_ranks(path), pattern)


def encode(df: DataFrame, ranks_path: str | None = None, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>: the text's ids, without special tokens."""
    path = ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        for batch in text_slices(batches):
            parts = [encoder(t) if t else b"" for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, parts)]) // 4
            ids = pa.array(np.frombuffer(b"".join(parts), "<i4"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)], names=["doc_id", "ids"])

    return keyed_texts(df, id_col, text_col).mapInArrow(work, "doc_id long, ids array<int>")


def decode(df: DataFrame, ranks_path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, ids, decoded binary: the bytes that the ids stand for; unknown ids are an error."""
    path = ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {i: b for b, i in read_ranks(path).items()}.__getitem__
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                out = [b"".join(map(token, ids)) if ids else b"" for ids in (x.as_py() if x.is_valid and len(x.values) < 64 else x.values.to_numpy().tolist() if x.is_valid else None for x in batch.column(1))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["doc_id", "ids", "decoded"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(work, "doc_id long, ids array<int>, decoded binary")
