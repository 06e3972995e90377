"""The pipeline's near-duplicate stage: five words, similarity 0.8, against all pairs."""

import random

import corpus_pipeline
import numpy as np
import pytest
from conftest import CLASHING
from pyspark.sql import functions as F

from seqmine.llm import shingles

SMALL, TABLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def parts(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 5 else {tuple(w)}


def stay(rows):
    """Ids of the smallest document of each component; ids are distinct."""
    sets = {i: parts(t) for i, t in rows}
    root = {i: i for i in sets}
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if 9 * both >= 4 * (len(sets[a]) + len(sets[b])):
                x, y = sorted((root[a], root[b]))
                root = {i: x if r == y else r for i, r in root.items()}
    return sorted(set(root.values()))


@pytest.mark.parametrize("data", [SMALL, TABLE])
def test_stage_finds_all_pairs_of_the_tables(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    want = stay([(r["doc_id"], r["text"]) for r in docs.collect()])
    out = corpus_pipeline.near_dedup(spark, docs, data)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.select("doc_id").collect()) == want


@pytest.mark.parametrize("sample", [10_000, 40])
def test_stage_finds_all_pairs_around_the_limit(spark, monkeypatch, sample):
    monkeypatch.setattr(shingles, "SAMPLE", sample)
    rnd = random.Random(7)
    word = lambda: f"w{rnd.randrange(5000)}"
    line = " ".join(word() for _ in range(30))
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rnd.choice((3, 5, 6, 12, 40, 90, 200)))]
        for _ in range(8):
            own = list(base)
            for _ in range(rnd.choice((0, 1, 2, 3, 5, 8))):
                own[rnd.randrange(len(own))] = word()
            texts.append(" ".join(own[: max(1, len(own) - rnd.randrange(8))]) + (f" {line}" if rnd.random() < 0.3 else ""))
    rows = list(enumerate([*texts, "", " "]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in CLASHING})
    out = corpus_pipeline.near_dedup(spark, docs, "")
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == stay(rows)


def test_stage_links_by_balls(spark, monkeypatch):
    """With no prefix that meets another, operator 7's balls still bring near copies together; what only they find is verified."""

    def nothing(batches):
        for _ in batches:
            yield from ()

    rnd = random.Random(3)
    word = lambda: f"w{rnd.randrange(5000)}"
    prints = lambda t: np.frombuffer(shingles.fingerprint(shingles.shingles(t)), np.uint64)
    texts, near, far = [], 0, 0
    while near < 20 or not far:
        base = [word() for _ in range(120)]
        own = list(base)
        for k in rnd.sample(range(0, 120, 5), rnd.choice((1, 6))):
            own[k] = word()
        a, b = " ".join(base), " ".join(own)
        if np.bitwise_count(prints(a) ^ prints(b)).min() > 3:
            continue
        similar = 9 * len(parts(a) & parts(b)) >= 4 * (len(parts(a)) + len(parts(b)))
        near, far = near + similar, far + (not similar)
        if not similar or near <= 20:
            texts += [a, b]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(shingles, "_neighbours", nothing)
    out = corpus_pipeline.near_dedup(spark, docs, "")
    assert len(stay(rows)) == len(rows) - 20 and sorted(r["doc_id"] for r in out.collect()) == stay(rows)
