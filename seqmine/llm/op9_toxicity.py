"""Toxicity by maximum-scoring segments.

Terms are words and their beginnings of three to eight characters, so that inflected and compound forms share what
is known of their stems. A term's points are its log-odds between the tokens of toxic and other training documents
with an informative Dirichlet prior (the pooled frequencies); a token has the points of its best significant term,
and costs a fixed drift if it has none. All maximal scoring
segments of a text come from one linear scan over the tokens that score (the drift of what lies between them is
a product). Segments follow the extreme-value law of local scores: one with score S in n tokens has the E-value
K n exp(-lambda S), with lambda and K from the non-toxic training documents. A document's evidence is the least
Poisson tail over its r best segments, and a logistic curve fitted on the training rows turns it into a score.

The fit takes at most about ``max_rows`` labelled rows of each class, chosen by a hash of the id, with their whole
texts and all of their significant terms; scoring covers all rows and whole texts.

Defined results: null and empty texts have no evidence and get the score of none; null labels and ids aren't
learned from; of several labels of one id the largest holds; without training rows of both classes all scores
are 0; repeated rows are scored each; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_texts, remainder, text_slices

_TOKEN = re.compile(r"[^\W_]+")
#: what a token costs that has no points; the Dirichlet prior as a share of all training tokens
DRIFT, PRIOR = 0.5, 0.03
SCHEMA = "doc_id long, evidence double, score double, passages array<struct<start:int,stop:int,points:double,e_value:double>>"


@dataclass
class Model:
    points: dict[str, float] = field(default_factory=dict)
    decay: float = 1.0
    rate: float = 0.1
    slope: float = 0.0
    bias: float = -50.0


def tokens(text: str | None) -> list[str]:
    if not text:
        return []
    low = text.lower()
    return _TOKEN.findall(low) if len(low) == len(text) else [w.lower() for w in _TOKEN.findall(text)]


def terms(words: list[str]) -> Counter:
    """How often each term occurs in a text, as the number of its binary digits (1, 2, 2, 3, ...): repeating a term
    in one document counts ever less, so that no single document decides about it."""
    words_ = Counter(words)
    out = Counter(words_)
    for w, n in words_.items():
        for k in range(3, min(9, len(w))):
            out[w[:k] + "*"] += n
    return Counter({t: n.bit_length() for t, n in out.items()})


class Points(dict):
    """Points by token, None for one without: looked up among the terms once, forgotten when there are too many. Long
    tokens aren't remembered, so that the number of entries bounds the memory."""

    def __init__(self, by_term: dict[str, float]):
        self.by_term = by_term

    def __missing__(self, word: str) -> float | None:
        known = self.by_term
        found = [known[t] for t in (word, *(word[:k] + "*" for k in range(3, min(9, len(word))))) if t in known]
        out = max(found, default=None)
        if len(word) <= 64:
            if len(self) >= 500_000:
                self.clear()
            self[word] = out
        return out


def segments(hits: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score) of a text in which only the hits score.

    The linear algorithm keeps candidates with the running totals before and after them: a new one joins back to
    the nearest candidate that starts lower, unless that one ends at least as high.
    """
    kept: list[tuple[int, int, float, float]] = []
    total, last = 0.0, -1
    for at, points in hits:
        total -= drift * (at - last - 1)
        low, total, first = total, total + points, at
        high, last = total, at
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= low:
                j -= 1
            if j < 0 or kept[j][3] >= high:
                kept.append((first, at, low, high))
                break
            first, low = kept[j][0], kept[j][2]
            del kept[j:]
    return [(a, b, high - low) for a, b, low, high in kept]


def evidence(found: list[tuple[int, int, float]], n: int, model: Model) -> float:
    """-ln of the least chance, over r, that r segments of n tokens of harmless text all score as the r-th best."""
    out = 0.0
    for r, (_, _, points) in enumerate(sorted(found, key=lambda s: -s[2]), 1):
        log_mean = math.log(model.rate * max(n, 1)) - model.decay * points
        if log_mean < 0:
            # the tail's leading term bounds it: mean^r / r!
            out = max(out, math.lgamma(r + 1) - r * log_mean)
    return out


def _scored(texts: list[str | None], model: Model) -> Iterator[tuple[list[str], list]]:
    points = Points(model.points)
    for text in texts:
        words = tokens(text)
        yield words, segments([(i, p) for i, p in enumerate(map(points.__getitem__, words)) if p is not None])


def _sample(labels: DataFrame, max_rows: int) -> DataFrame:
    """(doc_id, toxic): at most about max_rows of each class."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    part = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("toxic")), 2)  # fine enough for any number of rows
    share = [F.lit(min(1 << 62, (max_rows << 62) // max(1, n.get(k, 0)))) for k in (0, 1)]
    return rows.where(part < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))


def learn(df: DataFrame, labels: DataFrame, max_rows: int = 8000, least_z: float = 3.5) -> Model:
    """df and labels: training rows only."""
    docs = keyed_texts(df).join(F.broadcast(_sample(labels, max_rows)), "doc_id").select("toxic", "text")  # 2 max_rows rows of 12 bytes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[Counter] = [Counter(), Counter()]
        n = [0, 0]

        def rows():
            for k in (0, 1):
                seen[k][""] = n[k]  # all tokens, under the one string that is no term
                found = list(seen[k])
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([k] * len(found), pa.int32()), pa.array([seen[k][w] for w in found], pa.int64())], names=["term", "toxic", "n"])
                seen[k].clear()
                n[k] = 0

        for batch in text_slices(batches):
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = tokens(text)
                n[k] += len(words)
                seen[k].update(terms(words))
            if sum(map(len, seen)) > 400_000:
                yield from rows()
        yield from rows()

    counts = docs.mapInArrow(count, "term string, toxic int, n long").groupBy("term").agg(*(F.sum(F.when(F.col("toxic") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in (0, 1)))
    whole = counts.where("term = ''").collect()
    n0, n1 = (whole[0]["n0"], whole[0]["n1"]) if whole else (0, 0)
    if not n0 or not n1:
        return Model()
    # the prior has the pooled frequencies and is shared by the classes as the tokens are
    prior = PRIOR * (n0 + n1)
    a = F.lit(prior) * (F.col("n0") + F.col("n1")) / (n0 + n1) * F.lit(1.0)
    a1, a0 = a * n1 / (n0 + n1), a * n0 / (n0 + n1)
    odds = F.log((F.col("n1") + a1) / (n1 + prior * n1 / (n0 + n1) - F.col("n1") - a1)) - F.log((F.col("n0") + a0) / (n0 + prior * n0 / (n0 + n1) - F.col("n0") - a0))
    spread = F.sqrt(1 / (F.col("n1") + a1) + 1 / (F.col("n0") + a0))
    found = counts.where("term != '' and n1 > 1").select("term", odds.alias("odds"), (odds / spread).alias("z"))
    top = found.where((F.col("z") > least_z) & (F.col("odds") > math.log(4))).collect()  # of 2 max_rows texts
    model = Model({r["term"]: float(r["odds"]) for r in top})

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            out = []
            for toxic, (words, found) in zip(batch.column(0).to_pylist(), _scored(batch.column(1).to_pylist(), model), strict=True):
                out.append((toxic, len(words), len(found), math.fsum(s[2] for s in found)))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.float64()))], names=["toxic", "n", "segments", "points"])

    clean = docs.mapInArrow(show, "toxic int, n long, segments long, points double").where("toxic = 0").collect()  # max_rows rows at most
    n_tokens = sum(r["n"] for r in clean) + 1
    # lambda: E exp(lambda s) = 1 over the tokens of harmless documents, half a hit added to those seen
    n_segments = sum(r["segments"] for r in clean)
    mean = float(np.mean(list(model.points.values()))) if model.points else 1.0
    share = (n_segments + 0.5) / n_tokens
    size = math.fsum(r["points"] for r in clean) / n_segments if n_segments else mean
    low, high = 1e-6, 50.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if share * math.exp(mid * size) + (1 - share) * math.exp(-mid * DRIFT) < 1 else (low, mid)
    model.decay = max(low, 1e-3)
    model.rate = min(1.0, max(1e-6, share * math.exp(model.decay * size)))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            x = [evidence(found, len(words), model) for words, found in _scored(batch.column(1).to_pylist(), model)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.float64())], names=["toxic", "x"])

    shown = docs.mapInArrow(weigh, "toxic int, x double").collect()  # 2 max_rows rows at most
    x = np.array([r["x"] for r in shown])
    y = np.array([r["toxic"] for r in shown], float)
    model.slope, model.bias = _logistic(np.log1p(x), y)
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and bias by Newton's method with a small ridge; the slope isn't negative. Classes weigh by their rows."""
    w = np.zeros(2)
    z = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (y - p) - 0.01 * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.01 * np.eye(2), grad)
        w += np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return max(0.0, float(w[0])), float(w[1])


def score(df: DataFrame, model: Model, most_e: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, evidence, score and the significant passages: code points, E-values up to most_e."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # the significant terms of 2 max_rows texts

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in text_slices(batches):
            texts = batch.column(1).to_pylist()
            rows = []
            for text, (words, found) in zip(texts, _scored(texts, model), strict=True):
                x = evidence(found, len(words), model)
                passages = []
                if found:
                    e = [model.rate * len(words) * math.exp(-model.decay * s[2]) for s in found]
                    if min(e) <= most_e:
                        at = [m.span() for m in _TOKEN.finditer(text)]
                        passages = [{"start": at[a][0], "stop": at[b][1], "points": s, "e_value": v} for (a, b, s), v in zip(found, e, strict=True) if v <= most_e]
                rows.append((x, 1 / (1 + math.exp(-max(-700.0, min(700.0, model.slope * math.log1p(x) + model.bias)))) if model.points else 0.0, passages))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("points", pa.float64()), ("e_value", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], kind)],
                names=["doc_id", "evidence", "score", "passages"],
            )

    return keyed_texts(df, id_col, text_col).mapInArrow(work, SCHEMA)


def train_rows(df: DataFrame, folds: int = 5) -> DataFrame:
    return df.where(remainder(F.col("doc_id"), folds) != 0)
