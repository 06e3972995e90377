"""SimHash near-duplicates with meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in at most three bits differ in at most one bit in one of their 32-bit
halves. Every distinct fingerprint therefore emits, for each half, all variants within half the radius (one
bit), the shuffle brings equal variants together, and colliding pairs are verified over all 64 bits. Of two
halves that differ in one bit, one has even and one odd parity: only the odd one has to walk to the other, so an
even half emits itself and an odd half emits itself and its 32 neighbours (17 rows on average). Whole-word balls
would need 65 variants of the fingerprints of even and 2,081 of those of odd parity, since one side has to walk two
bits: 1,073 on average where this needs 34.

Where so many fingerprints share a half that their key would be large (``CROWD``), the same is done once more within
the key: the other half differs in three bits at most, so one of its 16-bit quarters differs in one at most, and the
quarters' balls split the key. Two fingerprints of a split key share 48 bits but for two, so its parts are bounded by
2^16 fingerprints whatever the number of documents.

A key's fingerprints meet in one sorted run; a task links them with a union-find and emits a spanning forest,
never the pairs. Equal fingerprints are one node from the start. Components follow by alternating large-star and
small-star rounds, each a written table, until nothing changes.

Defined results: a null or empty text has fingerprint zero and is linked like any other; a null id has a
fingerprint, may share a component, and never names one unless all of it is null; repeated rows are kept; an
empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_texts, stored, text_slices

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_LANES = np.arange(8, dtype=np.int64) * 256


def simhash(text: str | None, width: int = 3, seed: int = 42) -> int:
    """64 bits, each set if it is set in over half of the shingles' hashes, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, seed) for s in shingles], np.uint64)
    lanes = hashes.astype(">u8").view(np.uint8).reshape(-1, 8) + _LANES
    votes = np.einsum("lb,bk->lk", np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256), _BITS).ravel()
    return int.from_bytes(np.packbits(votes * 2 > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            fp = np.array([simhash(t, width) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return keyed_texts(df, id_col, text_col).mapInArrow(work, "doc_id long, fp long")


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(half, key, far, fp): far is 1 where the key is a neighbour of the fingerprint's half."""
    flips = np.concatenate([[0], 1 << np.arange(32, dtype=np.int64)])
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        for half in (0, 1):
            v = (fp >> (32 * half)) & 0xFFFFFFFF
            odd = np.bitwise_count(v) & 1 == 1
            for part, mask, steps in ((0, ~odd, flips[:1]), (1, odd, flips)):
                own = fp[mask]
                if not len(own):
                    continue
                keys = (v[mask][:, None] ^ steps[None, :]).ravel()
                far = np.tile((steps != 0).astype(np.int8), len(own))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), half, np.int8)), pa.array(keys), pa.array(far), pa.array(np.repeat(own, len(steps)))],
                    names=["half", "key", "far", "fp"],
                )


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


#: rows that are compared with so many others at a time; fingerprints of one half from which its keys are split
_BLOCK, CROWD = 1024, 256


def link(home: np.ndarray, far: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links that a key shows: home-home and home-far pairs within the radius, of each block the nearest first."""
    every = np.concatenate([home, far])
    forest, out = _Forest(len(every)), []

    def take(i: np.ndarray, j: np.ndarray) -> None:
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            if forest.join(a, b):
                out.append((int(every[a]), int(every[b])))

    unsigned = every.view(np.uint64)  # bits of a signed number would be those of its absolute value
    for a in range(0, len(home), _BLOCK):
        for b in range(a, len(every), _BLOCK):
            differ = np.bitwise_count(unsigned[a : min(a + _BLOCK, len(home)), None] ^ unsigned[None, b : b + _BLOCK])
            near = differ <= radius
            if b == a:
                near &= ~np.tri(*near.shape, dtype=bool)
            i, j = np.nonzero(near)
            order = np.argsort(differ[i, j], kind="stable")
            take(i[order] + a, j[order] + b)
    return out


def _links(radius: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Input sorted by (half, key, far, fp); a key may go over several batches."""
        held: list[np.ndarray] = []

        def groups(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            cut = np.flatnonzero((rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])) + 1
            starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [rows.shape[1]]])
            out = []
            for s, e in zip(*(x[ends - starts > 1].tolist() for x in (starts, ends)), strict=True):
                n = int(np.searchsorted(rows[2, s:e], 1))
                if n:
                    out += link(rows[3, s : s + n], rows[3, s + n : e], radius)
            if out:
                a, b = np.array(out, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            same = (rows[0] == rows[0, -1]) & (rows[1] == rows[1, -1])
            last = int(np.argmax(same))  # the batch's last key starts here and may go on
            if last == 0 and (not held or (held[-1][:2, -1] == rows[:2, 0]).all()):
                held.append(rows)
                continue
            yield from groups(np.concatenate([*held, rows[:, :last]], axis=1) if held or last else rows[:, :0])
            held = [rows[:, last:]]
        if held:
            yield from groups(np.concatenate(held, axis=1))

    return work


def _quarters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of keys that are split: for each quarter of the other half its ball, within the key. Halves 2 and 3 stand for these."""
    flips = np.concatenate([[0], 1 << np.arange(16, dtype=np.int64)])
    for batch in batches:
        half, key, _, fp = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)
        other = (fp >> (32 * (1 - half))) & 0xFFFFFFFF
        for quarter in (0, 1):
            v = (other >> (16 * quarter)) & 0xFFFF
            odd = np.bitwise_count(v) & 1 == 1
            for mask, steps in ((~odd, flips[:1]), (odd, flips)):
                if mask.any():
                    walked = (v[mask][:, None] ^ steps[None, :]).ravel()
                    keys = np.repeat(key[mask], len(steps)) | (walked << 32) | (quarter << 48)
                    far = np.tile((steps != 0).astype(np.int8), int(mask.sum()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(half[mask] + 2, len(steps)).astype(np.int8)), pa.array(keys), pa.array(far), pa.array(np.repeat(fp[mask], len(steps)))], names=["half", "key", "far", "fp"]
                    )


def _crowded(nodes: DataFrame, crowd: int) -> DataFrame:
    """(half, key) of keys to split: those with so many fingerprints of their own, and those that such fingerprints walk to."""
    halves = nodes.select(F.explode(F.array(*(F.struct(F.lit(h).cast("byte").alias("half"), F.shiftright("fp", 32 * h).bitwiseAND(F.lit(0xFFFFFFFF)).alias("key")) for h in (0, 1)))).alias("x"))
    many = halves.groupBy("x.half", "x.key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("half", "key")
    steps = F.array(*(F.lit(1 << b).cast("long") for b in range(32)))
    walked = F.when(F.bit_count("key") % 2 == 1, F.concat(F.array(F.lit(0).cast("long")), steps)).otherwise(F.array(F.lit(0).cast("long")))
    return many.select("half", "key", F.explode(walked).alias("step")).select("half", F.col("key").bitwiseXOR(F.col("step")).alias("key")).distinct()


def links(nodes: DataFrame, radius: int = 3, crowd: int = CROWD, reach: int | None = None) -> DataFrame:
    """(a, b), a < b: links between distinct fingerprints that connect all within the radius. nodes: one column fp. With
    reach, fingerprints that meet in a ball link up to so many bits; those beyond the radius don't all meet."""
    if not 0 <= radius <= 3:
        raise ValueError("a half may differ in one bit: three bits at most")
    kind = "half byte, key long, far byte, fp long"
    keyed = nodes.select("fp").mapInArrow(_variants, kind)
    split = stored(_crowded(nodes, crowd), "crowded")
    if not split.isEmpty():
        inside = keyed.join(split, ["half", "key"], "left_semi").select("half", "key", "far", "fp").mapInArrow(_quarters, kind)
        keyed = keyed.join(split, ["half", "key"], "left_anti").select("half", "key", "far", "fp").unionAll(inside)
    dealt = keyed.repartition("half", "key").sortWithinPartitions("half", "key", "far", "fp")
    return dealt.mapInArrow(_links(radius if reach is None else max(radius, reach)), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for each node with a link; large-star and small-star in turn."""
    edges = stored(edges.select("a", "b"), "links")
    while True:
        # large star: a node's larger neighbours go to its smallest neighbour (itself included)
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = edges.join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        # small star: a node's smaller neighbours and itself go to the smallest of them
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.explode(F.array(F.struct(F.col("a"), "m"), F.struct(F.col("b").alias("a"), "m"))).alias("x"))
        new = stored(small.select(F.col("x.m").alias("a"), F.col("x.a").alias("b")).where("a < b").distinct(), "links")
        stars = new.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() == 0
        roots = stars and new.join(new.select(F.col("b").alias("a")), "a", "left_semi").limit(1).count() == 0
        edges = new
        if roots:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_duplicates(df: DataFrame, width: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id: one row for each row of df."""
    docs = stored(fingerprints(df, width, id_col, text_col), "fingerprints")
    known = _rooted(docs, radius)
    named = known.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = stored(known.join(named, "root").select("fp", "component_id"), "labels")
    return docs.join(labels, "fp", "left").select("doc_id", "fp", "component_id")


def _rooted(docs: DataFrame, radius: int) -> DataFrame:
    """fp, least (the smallest id with it), root: one row for each distinct fingerprint."""
    nodes = stored(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes, radius))
    return nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def deduplicate(df: DataFrame, width: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df without near-duplicates: of each component the row with the smallest id stays, a null one only
    if there is no other, and of several rows with that id the one with the smallest hash of all columns."""
    mark = F.xxhash64(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in df.columns))
    whole = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("s_row"), F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("s_id"), mark.alias("s_mark"), F.col(text_col).cast("string").alias("s_text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text="s_text"):
            fp = np.array([simhash(t, width) for t in batch.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], names=["doc_id", "mark", "fp"])

    docs = stored(whole.select("s_id", "s_mark", "s_text").mapInArrow(work, "doc_id long, mark long, fp long"), "fingerprints")
    of_fp = docs.groupBy("fp").agg(F.min(F.struct("doc_id", "mark")).alias("first"))
    firsts = _rooted(docs, radius).select("fp", "root").join(of_fp, "fp").groupBy("root").agg(F.min("first").alias("first"))
    stay = stored(firsts.select(F.col("first.doc_id").alias("s_id"), F.col("first.mark").alias("s_mark")), "stay")
    kept = whole.select("s_row", "s_id", "s_mark").join(stay, ["s_id", "s_mark"], "left_semi")
    equal = docs.groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    if equal:  # rows that are the same in all columns: only then do whole rows have to meet
        kept = kept.dropDuplicates(["s_id", "s_mark"])
    return kept.select("s_row.*")
