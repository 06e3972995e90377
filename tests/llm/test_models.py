"""Language and toxicity models recomputed in plain Python, and what they do without much to learn from."""

import math
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from seqmine.llm import op6_langid, op9_toxicity
from seqmine.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
U32 = (1 << 32) - 1


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def grams(text):
    c = [ord(x.lower()[0]) if unicodedata.category(x)[0] in "LM" else 32 for x in text]
    c = [x for k, x in enumerate(c) if x != 32 or k == 0 or c[k - 1] != 32] + [0, 0, 0, 0]
    a, b, d = 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D
    out = Counter()
    for k in range(len(c) - 2):
        one = c[k] * a & U32
        two = one ^ (c[k + 1] * b + 77 & U32)
        three = (two * d & U32) ^ (c[k + 2] * a + 1777 & U32)
        for x in (one, two, three):
            out[((x ^ x >> 15) * b & U32) >> 17] += 1
    return out


def test_language_by_brute_force(spark, texts):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    counts, prior = defaultdict(Counter), Counter()
    for i, t in texts:
        if not held_out(i) and langs[i] is not None:
            counts[langs[i]].update(grams(t or ""))
            prior[langs[i]] += 1
    names, buckets = sorted(counts), op6_langid.BUCKETS
    total = {x: sum(counts[x].values()) + 0.5 * buckets for x in names}
    got = {r["doc_id"]: r for r in QUERIES["op6_langid"](spark, DATA).collect()}
    assert len(got) == len(texts)
    for i, t in texts:
        if not any(unicodedata.category(x)[0] == "L" for x in t or ""):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        own = grams(t)
        n = sum(own.values())
        like = [sum(k * math.log((counts[x][g] + 0.5) / total[x]) for g, k in own.items()) * min(1, 30 / n) + math.log(prior[x] / sum(prior.values())) for x in names]
        best = max(like)
        assert got[i]["lang_pred"] == names[like.index(best)]
        assert got[i]["score"] == pytest.approx(1 / sum(math.exp(x - best) for x in like), abs=1e-4)


def test_language_does_not_depend_on_neighbours():
    alone = [op6_langid.ngrams([t])[0] for t in ("one text", "another")]
    both, starts, _ = op6_langid.ngrams(["one text", "another"])
    for k in range(3):
        assert np.array_equal(np.concatenate([a[k] for a in alone]), both[k])


def test_language_ties_and_one_language(spark):
    rows = [(i, "the same words", lang) for i, lang in enumerate(("de", "en", "de", "en"))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = op6_langid.predict(df, op6_langid.learn(df)).collect()
    assert {r["lang_pred"] for r in out} == {"de"} and all(r["score"] == pytest.approx(0.5) for r in out)
    one = df.where("lang = 'en'")
    assert {(r["lang_pred"], r["score"]) for r in op6_langid.predict(df, op6_langid.learn(one)).collect()} == {("en", 1.0)}


def test_bounded_samples_never_vanish(spark):
    rows = spark.range(3000).selectExpr("id AS doc_id", "'some words' AS text", "'en' AS lang", "CAST(id % 2 AS INT) AS toxic")
    names, matrix = op6_langid.learn(rows, max_docs=50)
    assert names == ["en"] and matrix[0, :-1].max() > matrix[0, :-1].min()
    n = Counter(r["toxic"] for r in op9_toxicity._sample(rows.select("doc_id", "toxic"), 50).collect())
    assert all(20 < n[k] < 90 for k in (0, 1))


def test_toxicity_by_brute_force(spark, texts):
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if r["toxic"] is not None}
    train = [(toxic[i], t) for i, t in texts if not held_out(i) and i in toxic]
    counts, n = [Counter(), Counter()], [0, 0]
    for y, t in train:
        words = op9_toxicity.tokens(t)
        n[y] += len(words)
        seen = Counter(words)
        stems = Counter(seen)
        for w, k in seen.items():
            stems.update({w[:m] + "*": k for m in range(3, min(9, len(w)))})
        counts[y].update({w: len(f"{k:b}") for w, k in stems.items()})
    points, share = {}, op9_toxicity.PRIOR
    for w in counts[1]:
        a = share * (counts[0][w] + counts[1][w])
        a0, a1 = a * n[0] / sum(n), a * n[1] / sum(n)
        k0, k1 = counts[0][w] + a0, counts[1][w] + a1
        odds = math.log(k1 / (n[1] * (1 + share) - k1)) - math.log(k0 / (n[0] * (1 + share) - k0))
        if counts[1][w] > 1 and odds / math.sqrt(1 / k0 + 1 / k1) > 3.5 and odds > math.log(4):
            points[w] = odds
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "toxic")
    model = op9_toxicity.learn(op9_toxicity.train_rows(docs), op9_toxicity.train_rows(labels))
    assert points and model.points.keys() == points.keys()
    assert all(model.points[w] == pytest.approx(p) for w, p in points.items())

    def found(text):
        words = op9_toxicity.tokens(text)
        best = [(k, max((points[x] for x in (w, *(w[:m] + "*" for m in range(3, min(9, len(w))))) if x in points), default=None)) for k, w in enumerate(words)]
        return words, op9_toxicity.segments([h for h in best if h[1] is not None])

    clean = [found(t) for y, t in train if not y]
    number, size = sum(len(f) for _, f in clean), sum(s[2] for _, f in clean for s in f)
    rate = (number + 0.5) / (sum(len(w) for w, _ in clean) + 1)
    mean = size / number if number else sum(points.values()) / len(points)
    # lambda solves E exp(lambda s) = 1
    assert rate * math.exp(model.decay * mean) + (1 - rate) * math.exp(-model.decay * op9_toxicity.DRIFT) == pytest.approx(1, abs=1e-3) or model.decay == 1e-3
    for r in op9_toxicity.score(docs, model).collect():
        words, own = found(dict(texts)[r["doc_id"]])
        x = op9_toxicity.evidence(own, len(words), model)
        assert r["evidence"] == pytest.approx(x)
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-(model.slope * math.log1p(x) + model.bias))))


def test_toxicity_of_one_class(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 0), (2, 0), (3, None)], "doc_id long, toxic int")
    out = op9_toxicity.score(docs, op9_toxicity.learn(docs, labels)).collect()
    assert [r["score"] for r in out] == [0.0, 0.0, 0.0]
