"""Near-duplicates by operator 7 over five-word shingles, completed to all pairs with a Jaccard similarity of 0.8 or more.

Each set has operator 7's SimHash fingerprint, of ``WORDS`` words of 64 bits. By each word, its halves emit their balls,
equal variants meet, and those that differ in ``REACH`` bits of the word at most are candidates, by a spanning forest.
Words three bits apart always meet. Similarity 0.8 means about ten differing bits of each word, of which balls find a
part only; so what they leave is found exactly, by prefixes.

Two sets of n and m shingles reach 0.8 only if they share at least four fifths of the larger, so in any common
order of all shingles they share one among the first n - ceil(0.8 n) + 1 of each (the prefix). Shingles that a
sample of documents shows to be common come last, the others by their hashes; the sample decides only how many
rows meet, never the result. Prefixes are sorted by shingle over all tasks, a shingle's rows over as many as they
fill, and rows that meet are compared in two rounds. The first takes the balls' candidates and pairs linear in the rows:
neighbours in the order, and each row with its shingle's hub, the row with the most shingles left. Copies that were
edited here and there have shingles of their own before those they share, and what they were copied from has none: it is
the hub that joins them.
The second takes what is left between different components, by shingle and by the sizes that the other set may have:
sets outside a shingle's commonest component look for those in it and for each other, so that a large group costs its
size times the sets outside. A pair is left out at a shingle that isn't the first it shares, as far as the first ``HEAD``
of each set tell.

The fingerprints also decide which of all these pairs are worth a comparison: similarity 0.8 means about 39 differing
bits of 256, with a standard deviation of 6. Pairs that differ in more than ``FAR`` bits (seven deviations) share a
passage at most and go; sets too small for a vote of many (``SMALL``) always stay. What is left is verified on whole
sets, the only ones that are shuffled.

Groups are the connected components of these pairs. Words are those of `op7_simhash` (ASCII white space, ASCII
lower case); a text of at most ``WIDTH`` words is one shingle. Shingles and sets are told apart by 64-bit hashes,
shingles of a head by 31 bits.

Defined results: null and empty texts are equal to each other; null ids stay only if there is no other in their
group; an empty table gives no rows; other columns, whatever their names, pass by.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_slices
from .op7_simhash import components, links

WIDTH = 5
#: documents whose shingles are counted, from how many of them on one is common, and how many of these are ranked
SAMPLE, COMMON, MOST_COMMON = 10_000, 5, 100_000
#: shingles of a prefix that tell whether a pair was met before
HEAD = 4
#: sizes of sets are dealt in steps of this factor
STEP = 1.1
#: sets that a worker remembers to have given
MOST_SEEN = 500_000
#: bits of the filter that holds back texts before candidates are joined with theirs
_FILTER = 1 << 22
#: 64-bit words of a fingerprint, the differing bits beyond which a pair isn't compared, and sets that always are
WORDS, FAR, SMALL = 4, 84, 16
#: differing bits of a word up to which sets that meet in a ball are candidates: few others are as near by chance
REACH = 12
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles, as signed longs."""
    words = (text or "").encode().lower().split()
    parts = zip(*(words[i:] for i in range(WIDTH))) if len(words) > WIDTH else [words]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(p)) for p in parts], np.uint64).view(np.int64))


def fingerprint(own: np.ndarray) -> bytes:
    """The SimHash of a set of hashes in WORDS words: each bit is set if it is set in over half of the hashes."""
    x = own.view(np.uint64)[:, None] * _MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    bits = np.unpackbits((x ^ (x >> np.uint64(32))).view(np.uint8), axis=1)
    return np.packbits(2 * bits.sum(0, dtype=np.int32) > len(own)).tobytes()


def prefix(own: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The shingles of which two sets of similarity 0.8 share one. common: sorted, with their places in the order."""
    n = len(own)
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        own = own[np.argsort(np.where(common[at] == own, rank[at] + 1, 0), kind="stable")]
    return own[: n - (4 * n + 4) // 5 + 1]


def _bucket():
    return F.pmod(F.xxhash64("s_id", "s_mark"), F.lit(_FILTER))


def _common(whole: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text="s_text"):
            for t in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t))], names=["key"])

    share = int((1 << 62) * min(1.0, SAMPLE / max(1, whole.count())))
    seen = whole.where(F.shiftrightunsigned(F.xxhash64("s_id", "s_mark"), 2) < share).select("s_text").mapInArrow(work, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    rows = seen.where(F.col("n") >= COMMON).orderBy(F.desc("n"), "key").limit(MOST_COMMON).toPandas()
    keys, counts = rows["key"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
    order = np.argsort(keys)
    return keys[order], counts[order]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input (key, place, node) sorted, place: size and rest in one; once each, rows whose key others have too, or may
    have in another task, with the row before."""
    held = None
    first = True

    def out(rows: np.ndarray, start: bool, end: bool) -> pa.RecordBatch:
        # rows: the one before, those to give, the one after; at the task's ends there is none
        same = rows[0, 1:] == rows[0, :-1]
        before = np.concatenate([[False], same])
        keep = before | np.concatenate([same, [False]])
        keep[0] |= start
        keep[-1] |= end
        size, rest = rows[1] >> 32, rows[1] & 0xFFFFFFFF
        size_before, rest_before = np.roll(size, 1), np.roll(rest, 1)
        near = before & (5 * size_before >= 4 * size) & (9 * (1 + np.minimum(rest, rest_before)) >= 4 * (size + size_before))
        give = slice(0 if start else 1, None if end else -1)
        keep, near, prev = keep[give], near[give], np.roll(rows[2], 1)[give]
        cols = [pa.array(c[give][keep]) for c in (rows[0], size, rows[2], rest)]
        return pa.RecordBatch.from_arrays([*cols, pa.array(prev[keep], mask=~near[keep])], names=["key", "size", "node", "rest", "prev"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        if held is not None:
            rows = np.concatenate([held, rows], axis=1)
        # copies that were seen in several tasks
        rows = rows[:, np.concatenate([[True], (rows[0, 1:] != rows[0, :-1]) | (rows[2, 1:] != rows[2, :-1])])]
        if rows.shape[1] > 2:
            yield out(rows, first, False)
            held, first = rows[:, -2:], False
        else:
            held = rows
    if held is not None:
        yield out(held, first, True)


def _far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Those of (a, b, size, x, y) that are small or whose fingerprints x and y differ in FAR bits at most."""
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(-1, WORDS) for k in (3, 4))
            near = np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= FAR
            near |= batch.column(2).to_numpy(zero_copy_only=False) <= SMALL
            yield batch.select([0, 1]).filter(pa.array(near))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
            ok.append(9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y)))
        yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))


def _verified(pairs: DataFrame, nodes: DataFrame, whole: DataFrame) -> DataFrame:
    """Those of pairs (a, b), a < b, whose sets have a similarity of 0.8."""
    pairs = pairs.where("a < b").distinct()
    of_a, of_b = (nodes.select(F.col("node").alias(n), F.col("size").alias(f"size_{n}"), F.col("print").alias(f"print_{n}")) for n in "ab")
    sized = pairs.join(of_a, "a").join(of_b, "b").where("5 * least(size_a, size_b) >= 4 * greatest(size_a, size_b)")
    near = sized.select("a", "b", F.least("size_a", "size_b").alias("size"), "print_a", "print_b").mapInArrow(_far, "a long, b long")
    pairs = stored(near, "pairs")
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", F.col("doc_id").alias("s_id"), F.col("mark").alias("s_mark")), "node"), "wanted")
    bits = np.zeros(_FILTER, bool)
    bits[[r[0] for r in wanted.select(_bucket()).distinct().toLocalIterator()]] = True
    shared = whole.sparkSession.sparkContext.broadcast(np.packbits(bits))  # 512 KB

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value).astype(bool)
        for batch in text_slices(batches, text="s_text"):
            batch = batch.filter(pa.array(bits[batch.column(3).to_numpy(zero_copy_only=False)]))
            sets = pa.array([shingles(t).tobytes() for t in batch.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sets], names=["s_id", "s_mark", "own"])

    sets = whole.select("s_id", "s_mark", "s_text", _bucket().alias("s_bucket")).mapInArrow(work, "s_id long, s_mark long, own binary")
    sets = stored(sets.join(wanted, ["s_id", "s_mark"]).select("node", "own").dropDuplicates(["node"]), "sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("own").alias("y")), "b")
    return stored(both.select("a", "b", "x", "y").mapInArrow(_verify, "a long, b long"), "similar")


def _balls(nodes: DataFrame) -> DataFrame:
    """(a, b), a < b: sets that operator 7's balls bring together, by each word of the fingerprints; equal words by the smallest set."""
    found = []
    for w in range(WORDS):
        word = F.conv(F.hex(F.substring("print", 8 * w + 1, 8)), 16, -10).cast("long").alias("fp")
        firsts = stored(nodes.groupBy(word).agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")), "words")
        x, y = (firsts.select(F.col("fp").alias(n), F.col("first").alias(f"first_{n}")) for n in "ab")
        near = links(firsts.select("fp"), reach=REACH).join(x, "a").join(y, "b").select("first_a", "first_b")
        equal = nodes.select(word, "node").join(firsts.where("n > 1"), "fp").select("first", "node")
        found.append(stored(near.unionAll(equal).toDF("x", "y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b"), "balls"))
    return reduce(DataFrame.unionAll, found)


def _links(whole: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, root) of the nodes that have a similar one."""
    keys = docs.select("node", "size", F.posexplode("prefix").alias("at", "key")).select("key", F.shiftleft("size", 32).bitwiseOR(F.col("size") - F.col("at") - 1).alias("place"), "node")
    dealt = keys.repartitionByRange("key", "place", "node").sortWithinPartitions("key", "place", "node")
    met = stored(dealt.mapInArrow(_neighbours, "key long, size long, node long, rest long, prev long"), "met")
    hub = F.max(F.struct("rest", "size", "node")).alias("hub")
    able = "5 * least(size, hub.size) >= 4 * greatest(size, hub.size) AND 9 * (1 + least(rest, hub.rest)) >= 4 * (size + hub.size)"
    spokes = met.join(met.groupBy("key").agg(hub), "key").where(able).select("node", F.col("hub.node").alias("prev"))
    linear = met.where("prev IS NOT NULL").select("node", "prev").unionAll(spokes)
    linear = linear.select(F.least("prev", "node").alias("a"), F.greatest("prev", "node").alias("b"))
    first = _verified(linear.unionAll(_balls(nodes)), nodes, whole)
    place = (F.col("size") - F.col("rest") - 1).cast("int")  # of the key in the set's order
    rooted = met.select("key", "size", "node", "rest").join(components(first), "node", "left").join(nodes.select("node", "head"), "node")
    rooted = rooted.select("key", "size", "node", "rest", F.coalesce("root", "node").alias("root"), place.alias("place"), F.slice("head", F.lit(1), F.least(F.size("head"), place)).alias("before"))
    rooted = stored(rooted, "rooted")
    # of two sets in different components one at least isn't in the key's commonest: it looks for the other
    parts = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count(F.lit(1)).alias("parts"))
    open_ = rooted.join(parts.where("parts > 1").select("key", "main"), "key").withColumn("other", F.col("root") != F.col("main")).drop("main")
    open_ = stored(open_, "open")
    # what the prefixes share begins here for one of the keys: as many shingles as are left can be shared at most, so
    # 9 (1 + rest) >= 4 (size + other size), and a set with shingles of its own before only meets smaller ones; where it is
    # the first that they share, what stands before in either is in one of them, which a ninth of both together can be
    step = lambda size: F.floor(F.log(size.cast("double")) / math.log(STEP))
    least, most = F.greatest(F.ceil(F.col("size") * 0.8), 9 * F.col("place") - F.col("size")), F.floor((9 * (1 + F.col("rest")) - 4 * F.col("size")) / 4.0)
    x = open_.where("other").withColumn("step", F.explode(F.when(least <= most, F.sequence(step(least), step(most))).otherwise(F.array().cast("array<long>")))).alias("x")
    y = open_.withColumn("step", step(F.col("size"))).alias("y")
    fit = F.expr("x.root != y.root AND (NOT y.other OR x.node < y.node) AND 5 * least(x.size, y.size) >= 4 * greatest(x.size, y.size) AND 9 * (1 + least(x.rest, y.rest)) >= 4 * (x.size + y.size) AND 9 * (x.place + y.place) <= x.size + y.size AND NOT arrays_overlap(x.before, y.before)")
    joined = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.step") == F.col("y.step")) & fit)
    pairs = joined.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    return components(first.unionAll(_verified(pairs, nodes, whole)))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df without near-duplicates: of each group the row with the smallest id stays, a null one only if
    there is no other, and of several rows with that id the one with the smallest hash of all columns."""
    mark = F.xxhash64(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in df.columns))
    whole = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("s_row"), F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("s_id"), mark.alias("s_mark"), F.col(text_col).cast("string").alias("s_text"))
    common = whole.sparkSession.sparkContext.broadcast(_common(whole))  # MOST_COMMON longs, twice

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a task gives the prefix of a set once; started afresh, it only gives some again
        for batch in text_slices(batches, text="s_text"):
            sets = [shingles(t) for t in batch.column(2).to_pylist()]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            prefixes, heads = [], []
            for n, own in zip(node.tolist(), sets, strict=True):
                own = prefix(own, *common.value)
                heads.append((own[:HEAD] & 0x7FFFFFFF).astype(np.int32))
                prefixes.append(None if n in seen else own)
                seen.add(n)
            if len(seen) > MOST_SEEN:
                seen.clear()
            cols = [pa.array(node), pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) for s in sets], pa.binary()), pa.array(heads, pa.list_(pa.int32())), pa.array(prefixes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=["doc_id", "mark", "node", "size", "print", "head", "prefix"])

    docs = stored(whole.select("s_id", "s_mark", "s_text").mapInArrow(work, "doc_id long, mark long, node long, size long, print binary, head array<int>, prefix array<long>"), "shingles")
    nodes = docs.groupBy("node").agg(F.min(F.struct("doc_id", "mark", "size", "print", "head")).alias("x")).select("node", "x.*")
    nodes = stored(nodes, "nodes")
    firsts = nodes.select("node", "doc_id", "mark").join(_links(whole, docs, nodes), "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct("doc_id", "mark")).alias("first"))
    stay = stored(firsts.select(F.col("first.doc_id").alias("s_id"), F.col("first.mark").alias("s_mark")), "stay")
    kept = whole.select("s_row", "s_id", "s_mark").join(stay, ["s_id", "s_mark"], "left_semi")
    equal = docs.groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    if equal:  # rows that are the same in all columns: only then do whole rows have to meet
        kept = kept.dropDuplicates(["s_id", "s_mark"])
    return kept.select("s_row.*")
