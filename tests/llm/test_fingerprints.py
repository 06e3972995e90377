"""Signatures by consistent weighted sampling, recomputed in plain Python."""

import math
import random
import re
import struct
from collections import Counter

import pytest
import xxhash
from conftest import edge_rows

from seqmine.llm import op5_fingerprints as op
from seqmine.llm.queries import QUERIES

WORD = re.compile("[^\x20\x09-\x0d]+")
MASK = (1 << 64) - 1


def chained(*values):
    """Hashes of a long and then ints, each with the hash before as its seed."""
    h = 42
    for k, v in enumerate(values):
        h = xxhash.xxh64_intdigest(struct.pack("<q" if not k else "<i", v), h)
    return h - (1 << 64) if h >> 63 else h


def gamma(bits):
    return -math.log(((bits >> 16) + 0.5) / 65536 * ((bits & 0xFFFF) + 0.5) / 65536)


def signature(text, samples=op.SAMPLES):
    words = Counter(xxhash.xxh64_intdigest(w.encode(), 42) for w in WORD.findall((text or "").lower()))
    out = []
    for place in range(samples if words else 0):
        part, lane = divmod(place, op.LANES)
        ranks = []
        for word, weight in words.items():
            x = chained(chained(word - (1 << 64) if word >> 63 else word, part), lane)
            y = chained(x, lane) & MASK
            x &= MASK
            r, c, b = gamma(x >> 32), gamma(x & 0xFFFFFFFF), ((y >> 32) + 0.5) / 2**32
            t = math.floor(math.log(weight) / r + b)
            ranks.append((c / (math.exp(r * (t - b)) * math.exp(r)), ((y & 0xFFFFFFFF) + t) & 0xFFFFFFFF))
        out.append(min(ranks)[1])
    return out


def jaccard(a, b):
    a, b = Counter(WORD.findall(a)), Counter(WORD.findall(b))
    return sum((a & b).values()) / sum((a | b).values())


def likeness(a, b):
    return 1.0 if not a and not b else sum(x == y for x, y in zip(a, b, strict=False)) / max(len(a), len(b))


def test_edges_by_brute_force(spark, edges):
    docs = [(i, t or "") for i, t, *_ in edge_rows()]
    docs.sort(key=lambda d: (d[0] is not None, d[0] or 0, d[1]), reverse=True)
    want = []
    for (i, t), (_, after) in zip(docs, docs[1:] + docs[:1], strict=True):
        half = len(t) // 2
        own, changed = signature(t), signature(t[: len(t) - half] + after[:half])
        want.append((i, ",".join(map(str, own)), ",".join(map(str, changed)), likeness(own, changed), likeness(own, signature(after))))
    got = [(r["doc_id"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) for r in QUERIES["op5_fingerprints"](spark, edges).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize(("shared", "own"), [(1, 2), (2, 1), (3, 3), (1, 9)])
def test_collision_rate_is_generalised_jaccard(spark, shared, own):
    """20 words of two texts with one weight, 20 of each with another: weights above 1 decide."""
    rows = []
    for n in range(150):
        common, left, right = ([f"{kind}{n}w{i}" for i in range(20)] for kind in "clr")
        rows += [(2 * n + k, " ".join(common * shared + mine * own)) for k, mine in enumerate((left, right))]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r["id"]: r["signature_0"] for r in op.signatures(df, ["id"], ["text"]).collect()}
    exact = jaccard(rows[0][1], rows[1][1])
    near = [likeness(got[2 * n], got[2 * n + 1]) for n in range(150)]
    error = math.sqrt(exact * (1 - exact) / op.SAMPLES)
    assert abs(sum(near) / len(near) - exact) < 0.02
    assert max(abs(x - exact) for x in near) < 4.5 * error


def test_repeated_rows_follow_themselves(spark):
    rnd = random.Random(1)
    rows = [(5, "one two three four"), (5, "one two three four"), (5, "one two three four"), (4, "a b c d e f"), (None, " ".join(str(rnd.random()) for _ in range(50)))]
    got = sorted((str(r["doc_id"]), r["edited_text"], r["near_next"]) for r in op.compare_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [g[1] for g in got if g[0] == "5"] == ["one two ta b c d e", "one two tone two t", "one two tone two t"]
    assert [g[2] for g in got if g[0] == "5"] == [0.0, 1.0, 1.0]


def test_one_document_is_its_own_next(spark):
    (r,) = op.compare_edits(spark.createDataFrame([(1, "abcd efgh")], "doc_id long, text string")).collect()
    assert r["edited_text"] == "abcd abcd" and r["near_next"] == 1.0
