"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op6_langid as _langid
from . import op3_interpolation as _interpolation
from . import op4_quality as _quality
from . import op9_toxicity as _toxicity
from .common import documents, remainder
from .op1_packing import pack
from .op10_pii import protect
from .op2_secrets import scan
from .op5_fingerprints import compare_edits
from .op7_simhash import near_duplicates
from .op8_bpe import decode, encode
from .oracles import ORACLE_SQL

#: of the pseudonyms here; a real run passes a secret one
KEY = "a key for synthetic tables"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir)).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.sha2(joined(F.filter("spans", lambda s: s["strong"])), 256).alias("base_sha256")
    return scan(documents(spark, sf_dir)).select("doc_id", *map(number, ("assign", "access", "hex")), base, joined(F.col("spans")).alias("spans"))


def op3_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _interpolation.score(documents(spark, sf_dir))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality.assess(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    def said(sig: str):
        return F.array_join(F.col(sig).cast("array<string>"), ",")

    return compare_edits(documents(spark, sf_dir), of_edited=lambda text: {"edited_sha256": F.sha2(text.cast("binary"), 256)}).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        said("signature").alias("fingerprint"),
        said("edited_signature").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", remainder(F.col("doc_id"), 5) == 0)
    model = _langid.learn(docs.where(~F.col("held_out")))
    return _langid.predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode(encode(documents(spark, sf_dir))).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = _toxicity.learn(_toxicity.train_rows(docs), _toxicity.train_rows(labels))
    scored = _toxicity.score(docs, model)
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protect(documents(spark, sf_dir).select("doc_id", "text"), KEY)


__all__ = ["KEY", "ORACLE_SQL", "QUERIES"]

QUERIES = {
    "op1_packing": op1_packing,
    "op2_secrets": op2_secrets,
    "op3_interpolation": op3_interpolation,
    "op4_quality": op4_quality,
    "op5_fingerprints": op5_fingerprints,
    "op6_langid": op6_langid,
    "op7_simhash": op7_simhash,
    "op8_bpe": op8_bpe,
    "op9_toxicity": op9_toxicity,
    "op10_pii": op10_pii,
}
