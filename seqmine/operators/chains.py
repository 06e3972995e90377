"""Chains of items within reach of one another, counted in numpy blocks by Python workers.

Workers get the items of sequences one after another, `at` from 0 within each, and keep whole sequences together. All
ids in a block are dense integers, so nothing in it is told apart by a hash; beyond it an item is its 64-bit hash and a
chain the hash of its prefix's and its last item's, as Spark's xxhash64 has them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CANDIDATES = "seq long, pre long, item long, n long"
#: Items of a block (a sequence more at most), and chains that are extended at once (those of one item more at most).
BLOCK, PIECE = 1 << 17, 1 << 21

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, k: int) -> np.ndarray:
    return (x << np.uint64(k)) | (x >> np.uint64(64 - k))


def _hash_long(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    h = seed + _P5 + np.uint64(8)
    h ^= _turned(x * _P2, 31) * _P1
    h = _turned(h, 27) * _P1 + _P4
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def chain_hash(pre: np.ndarray, item: np.ndarray) -> np.ndarray:
    """xxhash64(pre, item) of arrays of longs."""
    with np.errstate(over="ignore"):
        first = _hash_long(pre.view(np.uint64), np.full(len(pre), 42, np.uint64))
        return _hash_long(item.view(np.uint64), first).view(np.int64)


class Mask:
    """A bit for each remainder of the hashes that may go on; others that share a bit pass too and are counted in vain."""

    def __init__(self, words: np.ndarray) -> None:
        self.words, self.last = words, np.int64(len(words) * 64 - 1)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        bit = codes & self.last
        return (self.words[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1


def _pieces(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Runs whose sizes sum to `most` at most, or single ones."""
    total, start = np.cumsum(sizes), 0
    while start < len(sizes):
        done = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, done + most, "right")))
        yield slice(start, stop)
        start = stop


def _distinct(unit: np.ndarray, pre: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct triples; pre is any long, unit and item are dense."""
    _, local = np.unique(pre, return_inverse=True)
    pairs, pair = np.unique(local * (int(item.max(initial=0)) + 1) + item, return_inverse=True)
    _, first = np.unique(unit * len(pairs) + pair, return_index=True)
    return unit[first], pre[first], item[first]


def block_chains(at: np.ndarray, pos: np.ndarray, code: np.ndarray, k: int, gamma: int, masks: list[Mask]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, pre, item): the distinct chains of k items of each sequence (numbered from 0), by hash of prefix and item.

    masks[m] has what chains of m + 1 items may go on. Items are sorted by position within a sequence."""
    begins = at == 0
    # a distance beyond reach is as good as any other, and sequences are that far apart
    step = np.empty(len(pos), np.int64)
    step[1:] = np.minimum(pos[1:] - pos[:-1], gamma + 2)
    step[begins] = gamma + 2
    keep = masks[0](code)
    unit, place, code = (np.cumsum(begins) - 1)[keep], np.cumsum(step)[keep], code[keep]
    names, item = np.unique(code, return_inverse=True)
    low, high = np.searchsorted(place, place, "right"), np.searchsorted(place, place + gamma + 1, "right")
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    room = 4 * PIECE

    def extend(end: np.ndarray, pat: np.ndarray, codes: np.ndarray, length: int) -> None:
        """Chains by their last item's place and number; codes: the hash of each number."""
        nonlocal room
        sizes = high[end] - low[end]
        for piece in _pieces(sizes, PIECE):
            n = sizes[piece]
            i = np.repeat(np.arange(piece.start, piece.start + len(n)), n)
            j = low[end[i]] + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            kinds, kind = np.unique(pat[i] * len(names) + item[j], return_inverse=True)
            pre, last = codes[kinds // len(names)], kinds % len(names)
            if length + 1 == k:
                _, first = np.unique(unit[j] * len(kinds) + kind, return_index=True)
                found.append((unit[j[first]], pre[kind[first]], last[kind[first]]))
                if sum(len(x[0]) for x in found) > room:
                    found[:] = [_distinct(*(np.concatenate(x) for x in zip(*found, strict=True)))]
                    room = max(room, 2 * len(found[0][0]))
                continue
            longer = chain_hash(pre, names[last])
            on = masks[length](longer)[kind]
            ends = np.unique(j[on] * len(kinds) + kind[on])
            extend(ends // max(1, len(kinds)), ends % max(1, len(kinds)), longer, length + 1)

    extend(np.arange(len(item)), item, names, 1)
    if not found:
        return unit[:0], code[:0], code[:0]
    got = found[0] if len(found) == 1 else _distinct(*(np.concatenate(x) for x in zip(*found, strict=True)))
    return got[0], got[1], names[got[2]]


def _summed(pre: np.ndarray, item: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    items, local = np.unique(item, return_inverse=True)
    pres, before = np.unique(pre, return_inverse=True)
    kinds, kind = np.unique(before * max(1, len(items)) + local, return_inverse=True)
    total = np.zeros(len(kinds), np.int64)
    np.add.at(total, kind, n)
    return pres[kinds // max(1, len(items))], items[kinds % max(1, len(items))], total


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Columns as arrays, whole sequences together; a null seq is marked in `apart`."""
    held: list[dict[str, np.ndarray]] = []
    rows = 0

    def joined() -> dict[str, np.ndarray]:
        return {c: np.concatenate([h[c] for h in held]) for c in held[0]}

    for batch in batches:
        got = {c: batch.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        if "seq" in got:
            got["apart"] = batch.column("seq").is_valid().to_numpy(zero_copy_only=False)
        held.append(got)
        rows += batch.num_rows
        if rows >= BLOCK and (cuts := np.flatnonzero(got["at"] == 0)).size and (cut := rows - batch.num_rows + int(cuts[-1])):
            every = joined()
            yield {c: x[:cut] for c, x in every.items()}
            held = [{c: x[cut:] for c, x in every.items()}]
            rows -= cut
    if rows:
        yield joined()


def counted_chains(k: int, gamma: int, masks) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: rows (at, code[, pos][, n][, seq]) to CANDIDATES. masks: a broadcast list of arrays of words.

    pos is at where it is missing, n (a sequence's weight) is 1. A seq says that the sequence comes in several parts: its
    chains stay rows of their own, to be told apart by it. All others are summed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may = [Mask(x) for x in masks.value]
        for b in _blocks(batches):
            unit, pre, item = block_chains(b["at"], b.get("pos", b["at"].astype(np.int64)), b["code"], k, gamma, may)
            first = np.flatnonzero(b["at"] == 0)[unit]
            n = b["n"][first] if "n" in b else np.ones(len(unit), np.int64)
            apart = b["apart"][first] if "apart" in b else np.zeros(len(unit), bool)
            if not apart.all():
                whole = ~apart
                pres, items, total = _summed(pre[whole], item[whole], n[whole])
                yield pa.record_batch([pa.nulls(len(pres), pa.int64()), pa.array(pres), pa.array(items), pa.array(total)], ["seq", "pre", "item", "n"])
            if apart.any():
                yield pa.record_batch([pa.array(x[apart]) for x in (b["seq"][first], pre, item, n)], ["seq", "pre", "item", "n"])

    return work
