"""Language-model scoring by deleted interpolation of bigram, unigram and uniform estimates.

P(w | v) = l2(b) c(v w) / c(v) + l1(b) c(w) / N + l0(b) / (V + 1), where b is the bucket of the context's frequency
c(v) in powers of two. The mixture weights of each bucket come from expectation-maximisation on held-out counts:
a part of the training documents is deleted from all counts, and its bigrams are predicted by what is left. The
final estimates use all training documents.

How it runs. Documents are stored as compressed blocks of two megabytes, the deleted ones in blocks of their
own. A block sends each of its distinct n-grams once, as sorted hashes and counts in one array for each shard of
the hash space, so that counting shuffles some bytes for each distinct n-gram of a block, and a frequent n-gram
is one entry of each block like any other. A shard adds the counts up and answers each block in the order in which
it asked. Blocks with their answers score their documents; nothing is broadcast but the weights. The held-out
bigrams enter EM as a table of cells (bucket and the two ratios to the uniform estimate in steps of a sixteenth of
a factor of two), whose size doesn't depend on the corpus.

Words are told apart by 64 bits of hash and bigrams by 48: of n distinct words one in 2^64 / n shares its hash with
another, of n distinct bigrams one in 2^48 / n (one in 300 of 10^12), whose counts are then added up.

Defined results: a null text is an empty one, whose only token is the end; null ids count as training documents of
the empty id's remainder; repeated rows are counted and scored each; without training documents the uniform
estimate is all there is (score and base score 0 for each token: one type, the unknown); an empty table gives no
rows; other columns of the input are not read.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_texts, release, remainder, stored, text_slices

BLOCK = 2 << 20  # bytes of text in a block
SHARD = 4 << 20  # bytes of text that a shard's n-grams come from
LEAST_SHARDS = 64
WORD_BYTES, PAIR_BYTES, COUNT_BYTES = 8, 6, 6
STEPS = 16  # of a factor of two, for the ratios in EM
FOLDS, TEST, DELETED = 10, 0, 1


def _planes(x: np.ndarray, k: int, top: bool) -> bytes:
    """k bytes of each value, all first bytes before all second ones: sorted and small values then compress."""
    b = np.ascontiguousarray(x.astype(">u8")).view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray((b[:, :k] if top else b[:, 8 - k :]).T).tobytes()


def _values(data: bytes, k: int, top: bool) -> np.ndarray:
    b = np.frombuffer(data, np.uint8).reshape(k, -1)
    out = np.zeros((b.shape[1], 8), np.uint8)
    out[:, slice(0, k) if top else slice(8 - k, 8)] = b.T
    return out.view(">u8").ravel().astype(np.uint64)


class _Block:
    """Tokens and distinct n-grams of a block; word 0 is the end, which is also the context of a first word."""

    def __init__(self, texts: list[bytes], train: np.ndarray):
        ids: defaultdict = defaultdict()
        ids.default_factory = ids.__len__
        assert ids[b""] == 0
        flat = array("q")
        ends: list[int] = []
        for text in texts:
            flat.extend(map(ids.__getitem__, text.lower().split()))
            flat.append(0)
            ends.append(len(flat))
        self.flat = np.frombuffer(flat, np.int64)
        self.ends = np.array(ends, np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.context = np.concatenate([[0], self.flat[:-1]])
        digest = xxhash.xxh64_intdigest
        words = np.fromiter((digest(w, 1) for w in ids), np.uint64, len(ids))
        pairs, self.pair = np.unique(self.context * len(ids) + self.flat, return_inverse=True)
        with np.errstate(over="ignore"):
            x = words[pairs // len(ids)] * np.uint64(0x9E3779B97F4A7C15) + words[pairs % len(ids)]
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
        pair_hashes = (x ^ (x >> np.uint64(32))) >> np.uint64(16) << np.uint64(16)
        counted = np.repeat(train, np.diff(np.append(self.starts, len(self.flat))))
        self.hashes, self.order, self.counts = [], [], []
        for hashes, index in ((words, self.flat), (pair_hashes, self.pair)):
            order = np.argsort(hashes, kind="stable")
            self.order.append(order)
            self.hashes.append(hashes[order])
            self.counts.append(np.bincount(index, counted, len(hashes))[order].astype(np.uint64))

    def cuts(self, kind: int, bits: int) -> np.ndarray:
        shard = self.hashes[kind] >> np.uint64(64 - bits)
        return np.searchsorted(shard, np.arange((1 << bits) + 1).astype(np.uint64))

    def answered(self, kind: int, parts: list[bytes]) -> np.ndarray:
        """Answers of all shards, in order, brought back to the block's own numbering."""
        values = np.concatenate([_values(p, COUNT_BYTES, False) for p in parts]).astype(np.float64)
        out = np.empty(len(values))
        out[self.order[kind]] = values
        return out


def _texts(row: dict) -> list[bytes]:
    raw = pa.decompress(row["data"], decompressed_size=row["bytes"], codec="zstd", asbytes=True) if row["bytes"] else b""
    ends = np.cumsum(row["sizes"]).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


_BLOCKS = "block long, bytes long, data binary, sizes array<int>, doc_id array<long>, fold array<int>"


def blocks(df: DataFrame) -> DataFrame:
    """A row for each block of documents. df: doc_id, text, fold. Odd blocks hold the deleted documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 24
        open_: list[list] = [[], []]
        size = [0, 0]

        def flush(k: int) -> pa.RecordBatch:
            nonlocal first
            ids, texts, folds = zip(*open_[k], strict=True)
            raw = b"".join(texts)
            row = [first * 2 + k, len(raw), pa.compress(raw, codec="zstd", asbytes=True) if raw else b"", list(map(len, texts)), list(ids), list(folds)]
            first += 1
            open_[k], size[k] = [], 0
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=["block", "bytes", "data", "sizes", "doc_id", "fold"])

        for batch in text_slices(batches):
            for doc_id, text, fold in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                k = int(fold == DELETED)
                raw = (text or "").encode()
                if open_[k] and (size[k] + len(raw) > BLOCK or len(open_[k]) >= 50_000):
                    yield flush(k)
                open_[k].append((doc_id, raw, fold))
                size[k] += len(raw)
        for k in (0, 1):
            if open_[k]:
                yield flush(k)

    return df.select("doc_id", "text", "fold").mapInArrow(work, _BLOCKS)


def _asked(bits: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                release()
                b = _Block(_texts(row), np.array(row["fold"]) != TEST)
                cuts = [b.cuts(0, bits), b.cuts(1, bits)]
                out: list[list] = [[], [], [], []]
                shards = []
                for s in range(1 << bits):
                    if cuts[0][s] == cuts[0][s + 1] and cuts[1][s] == cuts[1][s + 1]:
                        continue
                    shards.append(s)
                    for kind, k in ((0, WORD_BYTES), (1, PAIR_BYTES)):
                        at = slice(cuts[kind][s], cuts[kind][s + 1])
                        out[2 * kind].append(_planes(b.hashes[kind][at], k, True))
                        out[2 * kind + 1].append(_planes(b.counts[kind][at], 4, False))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shards, pa.int32()), pa.array([row["block"]] * len(shards), pa.int64()), *(pa.array(x, pa.binary()) for x in out)],
                    names=["shard", "block", "words", "word_n", "pairs", "pair_n"],
                )

    return work


def _answer(table: pa.Table) -> pa.Table:
    """A shard: adds the blocks' counts up; each block's answer, all training documents and the deleted ones."""
    release()
    block = table["block"].to_numpy()
    out = {"shard": table["shard"], "block": table["block"]}
    stats = {}
    for kind, k in (("word", WORD_BYTES), ("pair", PAIR_BYTES)):
        hashes = [_values(x, k, True) for x in table[f"{kind}s"].to_pylist()]
        counts = [_values(x, 4, False) for x in table[f"{kind}_n"].to_pylist()]
        sizes = np.array([len(h) for h in hashes])
        found, index = np.unique(np.concatenate(hashes), return_inverse=True)
        n = np.concatenate(counts).astype(np.float64)
        every = np.bincount(index, n, len(found))
        held = np.bincount(index, n * np.repeat(block % 2 == 1, sizes), len(found))
        ends = np.cumsum(sizes)
        for name, sums in (("all", every), ("held", held)):
            answer = sums.astype(np.uint64)[index]
            out[f"{kind}_{name}"] = pa.array([_planes(answer[e - s : e], COUNT_BYTES, False) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)], pa.binary())
        if kind == "word":
            stats = {"types": int((every > 0).sum()), "tokens": int(every.sum()), "held_tokens": int(held.sum())}
    for name, v in stats.items():  # once for each shard
        out[name] = pa.array([v] + [0] * (len(block) - 1), pa.int64())
    return pa.table(out)


_ANSWERS = "shard int, block long, word_all binary, word_held binary, pair_all binary, pair_held binary, types long, tokens long, held_tokens long"


def _bucket(n: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else 1 + floor(log2 n)."""
    return np.frexp(n)[1]


def _known(left: pa.Table, right: pa.Table, wanted: tuple[str, ...]) -> tuple[dict, _Block, list[np.ndarray]]:
    release()
    row = left.to_pylist()[0]
    b = _Block(_texts(row), np.array(row["fold"]) != TEST)
    right = right.sort_by("shard")
    return row, b, [b.answered(0 if name.startswith("word") else 1, right[name].to_pylist()) for name in wanted]


def _cells(tokens: int, held_tokens: int, types: int):
    """Held-out bigrams of a deleted block by bucket and quantised ratios; 0 stands for an estimate of zero."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({k: pa.array([], pa.int64()) for k in ("cell", "n")})
        if not left.num_rows:
            return none
        _, b, (w_all, w_held, p_all, p_held) = _known(left, right, ("word_all", "word_held", "pair_all", "pair_held"))
        word, pair = w_all - w_held, p_all - p_held
        seen = word[b.context]
        with np.errstate(divide="ignore", invalid="ignore"):
            ratios = [np.where(seen > 0, pair[b.pair] / seen, 0) * (types + 1), word[b.flat] / max(1, tokens - held_tokens) * (types + 1)]
            q = [np.where(r > 0, np.clip(np.rint(np.log2(r) * STEPS) + 1024, 1, 2047), 0).astype(np.int64) for r in ratios]
        cells, n = np.unique((_bucket(seen).astype(np.int64) << 22) | (q[0] << 11) | q[1], return_counts=True)
        return pa.table({"cell": cells, "n": n.astype(np.int64)})

    return work


def fit(cells: np.ndarray, n: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Weights (bigram, unigram, uniform) of each of 64 buckets, by expectation-maximisation.

    Buckets without held-out bigrams take the weights of the nearest below that has some; each starts and is
    steadied by one bigram's worth of even weights, so no weight but an unseen context's bigram is ever zero."""
    bucket, q2, q1 = cells >> 22, (cells >> 11) & 2047, cells & 2047
    p = np.stack([np.where(q > 0, np.exp2((q - 1024) / STEPS), 0) for q in (q2, q1)] + [np.ones(len(cells))], 1)
    out = np.full((64, 3), np.nan)
    out[0] = 0, 0.5, 0.5
    for b in range(64):
        here = bucket == b
        even = np.array([0, 0.5, 0.5]) if b == 0 else np.full(3, 1 / 3)
        if not here.any():
            out[b] = out[b - 1] if b > 1 else even
            continue
        w, ph, nh = even, p[here], n[here].astype(float)
        for _ in range(rounds):
            share = ph * w
            share /= share.sum(1, keepdims=True)
            new = (nh @ share + even) / (nh.sum() + 1)
            moved = np.abs(new - w).max()
            w = new
            if moved < 1e-9:
                break
        out[b] = w
    return out


def _scored(weights: np.ndarray, tokens: int, types: int):
    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
        if not left.num_rows:
            return pa.table({k: pa.array([], t) for k, t in kinds.items()})
        row, b, (word, pair) = _known(left, right, ("word_all", "pair_all"))
        base = np.log10((word + 0.1) / (tokens + 0.1 * (types + 1)))[b.flat]
        seen = word[b.context]
        w = weights[_bucket(seen)]
        mixed = w[:, 0] * pair[b.pair] / np.maximum(seen, 1) + w[:, 1] * word[b.flat] / max(1, tokens) + w[:, 2] / (types + 1)
        if not tokens:
            mixed = np.ones(len(b.flat))
        sums = [np.add.reduceat(x, b.starts) for x in ((word[b.flat] > 0).astype(np.int64), base, np.log10(mixed))]
        values = [row["doc_id"], [f == TEST for f in row["fold"]], b.ends - b.starts, *sums]
        return pa.table({k: pa.array(v, t) for (k, t), v in zip(kinds.items(), values, strict=True)})

    return work


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each row of df."""
    docs = keyed_texts(df, id_col, text_col)
    docs = stored(blocks(docs.withColumn("fold", remainder(F.col("doc_id"), FOLDS).cast("int"))), "blocks")
    size = docs.agg(F.sum("bytes")).first()[0] or 0
    bits = max(LEAST_SHARDS, -(-size // SHARD) * 2 - 1).bit_length() - 1
    asked = docs.mapInArrow(_asked(bits), "shard int, block long, words binary, word_n binary, pairs binary, pair_n binary")
    answers = stored(asked.groupBy("shard").applyInArrow(_answer, _ANSWERS), "counts")
    types, tokens, held = (n or 0 for n in answers.agg(*(F.sum(c) for c in ("types", "tokens", "held_tokens"))).first())
    deleted = F.col("block") % 2 == 1
    cells = docs.where(deleted).groupBy("block").cogroup(answers.where(deleted).groupBy("block")).applyInArrow(_cells(tokens, held, types), "cell long, n long")
    table = cells.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # a bounded number of cells
    weights = fit(table["cell"].to_numpy(np.int64), table["n"].to_numpy(np.int64))
    whole = answers.select("shard", "block", "word_all", "pair_all")  # a cogroup gets all columns of its sides, and holds them
    out = docs.groupBy("block").cogroup(whole.groupBy("block")).applyInArrow(_scored(weights, tokens, types), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
