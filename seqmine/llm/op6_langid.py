"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, everything else becomes one space, and n-grams of one to three characters are hashed
into 2^15 buckets. Training counts are summed by Spark; the matrix of log-probabilities (languages x buckets) is
broadcast, and a batch of documents is scored in numpy by gathering the matrix at the batch's bucket indices and
summing by document.

The fit takes whole texts of at most ``max_docs`` labelled documents for each language, chosen by a hash of the
id; prediction covers all rows. The score is the posterior of the predicted language with the evidence of a text
counted as that of ``evidence`` n-grams, so that long texts don't all score 1. The fit compares the best language
with a background where all buckets are equally likely: nats an n-gram, over the share of its model that isn't
smoothing. Unlike the score it doesn't depend on how many languages there are.

Defined results: null texts and texts without a letter give `und` and score 0, and so does everything if nothing
was learned; a null language or id isn't learned from; ties go to the language first in order; repeated rows are
predicted each; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_slices

BUCKETS = 1 << 15
#: bytes of text whose n-grams a worker holds at once: its arrays take some 60 times as much
SLICE = 1 << 20
_MUL = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point: 32 for what is no letter or mark, else its lower case; letters have bit 24 set."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x33480):
        if (kind := unicodedata.category(chr(c))[0]) in "LM":
            out[c] = ord(chr(c).lower()[0]) | (1 << 24 if kind == "L" else 0)
    return out


@np.errstate(over="ignore")
def ngrams(texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each order 1 to 3 the buckets of all texts' n-grams and where each text's begin; whether each has a letter."""
    sizes = np.array([len(t) + 2 if t else 2 for t in texts])
    ends = np.cumsum(sizes)
    codes = np.frombuffer("  ".join([*(t or "" for t in texts), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    c = _letters()[codes]
    lettered = np.add.reduceat(c >> 24, ends - sizes) > 0
    c &= 0xFFFFFF
    c[ends - 1] = c[ends - 2] = 0  # two marks end a text: no n-gram of three joins two texts' letters
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    starts = np.concatenate([[0], np.cumsum(np.add.reduceat(keep.astype(np.int64), ends - sizes))])[:-1]
    c = np.concatenate([c[keep], np.zeros(2, np.uint32)])
    n = len(c) - 2
    shift = np.uint32(32 - 15)
    one = c[:n] * _MUL[0]
    two = one ^ (c[1 : n + 1] * _MUL[1] + np.uint32(77))
    three = two * _MUL[2] ^ (c[2 : n + 2] * _MUL[0] + np.uint32(1777))
    # n-grams that begin at a text's marks don't look at the next text
    last = np.append(starts[1:], n) - 1
    two[last] = np.uint32(77)
    three[last] = three[last - 1] = np.uint32(77) * _MUL[2] ^ np.uint32(1777)
    mixed = [(x ^ (x >> np.uint32(15))) * _MUL[1] >> shift for x in (one, two, three)]
    return mixed, [starts] * 3, lettered


def learn(df: DataFrame, max_docs: int = 5000, lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages, and their log-probabilities by bucket with the log prior in the last column. df: training rows."""
    rows = df.where(F.col(lang_col).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(lang_col).alias("lang"), "text")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return [], np.zeros((0, BUCKETS + 1), np.float32)
    part = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("langid")), 2)  # fine enough for any number of documents
    share: Column = F.lit(1 << 62)
    for lang in langs:
        if counts[lang] > max_docs:
            share = F.when(F.col("lang") == lang, F.lit((max_docs << 62) // counts[lang])).otherwise(share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in text_slices(batches, SLICE):
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in set(langs):
                grams, _, _ = ngrams([t for x, t in zip(langs, texts, strict=True) if x == lang])
                total = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for g in grams:
                    total += np.bincount(g, minlength=BUCKETS)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(total[at])], names=["lang", "bucket", "n"])

    grams = rows.where(part < share).select("lang", "text").mapInArrow(count, "lang string, bucket long, n long")
    table = grams.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    matrix = np.zeros((len(langs), BUCKETS))
    matrix[[langs.index(x) for x in table["lang"]], table["bucket"].to_numpy(np.int64)] = table["n"]
    prior = np.array([counts[x] for x in langs], float)
    log_p = np.log((matrix + 0.5) / (matrix.sum(1, keepdims=True) + 0.5 * BUCKETS))
    return langs, np.concatenate([log_p, np.log(prior / prior.sum())[:, None]], 1).astype(np.float32)


def predict(df: DataFrame, model: tuple[list[str], np.ndarray], evidence: int = 30) -> DataFrame:
    """df with lang_pred, score and fit added; reads the column text. The other columns pass by."""
    langs, matrix = model
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(matrix)  # languages x 2^15 floats
    names = [f.name for f in df.schema.fields]
    at = names.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_p = shared.value
        # the least probable bucket has what smoothing gives to each
        learned = np.maximum(1e-6, 1 - BUCKETS * np.exp(log_p[:, :-1].min(1, keepdims=True).astype(float))) if langs else None
        for batch in text_slices(batches, SLICE):
            texts = batch.column(at).to_pylist()
            grams, starts, lettered = ngrams(texts)
            if langs:
                like = np.stack([sum(np.add.reduceat(p[g], s, dtype=np.float64) for g, s in zip(grams, starts, strict=True)) for p in log_p])
                n = 3.0 * np.diff(np.append(starts[0], len(grams[0])))
                fit = np.where(lettered, ((like / n + np.log(BUCKETS)) / learned).max(0), 0.0)
                like = like * np.minimum(1, evidence / n) + log_p[:, -1:]
                best = like.argmax(0)
                score = np.where(lettered, 1 / np.exp(like - like.max(0)).sum(0), 0.0)
                said = [langs[k] if ok else "und" for k, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
            else:
                score, fit, said = np.zeros(len(texts)), np.zeros(len(texts)), ["und"] * len(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said), pa.array(score), pa.array(fit)], names=[*names, "lang_pred", "score", "fit"])

    schema = T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("fit", T.DoubleType())])
    return df.mapInArrow(work, schema)
