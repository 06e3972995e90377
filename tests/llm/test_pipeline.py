"""The corpus pipeline: each stage on its own input, and the whole."""

import corpus_pipeline
import pytest
from conftest import CLASHING, DATA
from pyspark.sql import functions as F

from seqmine.llm import op1_packing, op6_langid, shingles, stages
from seqmine.llm.common import BATCH_BYTES, small_batches, text_slices
from seqmine.llm.op4_quality import assess
from seqmine.llm.op6_langid import learn, predict
from seqmine.llm.op7_simhash import near_duplicates, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def test_stages_are_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "near_dedup", "pii", "packing"]


def test_each_stage_on_its_input(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = stages.quality(docs)
    assert kept.columns == COLUMNS
    assert rows(kept) == rows(docs.join(assess(docs).where("kept").select("doc_id"), "doc_id").select(COLUMNS))
    kept = kept.cache()
    said = stages.language(kept)
    want = predict(kept.select(COLUMNS), learn(kept)).where(f"lang_pred != 'und' AND score >= {stages.LEAST_SCORE}").select(COLUMNS)
    assert said.columns == COLUMNS and rows(said) == rows(want) and said.count() > 0.95 * kept.count()
    said = said.cache()
    left = stages.near_dedup(said)
    least = near_duplicates(said).select("component_id").distinct().withColumnRenamed("component_id", "doc_id")
    assert left.columns == COLUMNS and rows(left) == rows(said.join(least, "doc_id").select(COLUMNS)) and left.count() < said.count()
    left = left.cache()
    private = stages.pseudonyms(left, "key")
    assert private.columns == COLUMNS and private.count() == left.count()
    assert private.where("n_chars != length(text)").count() == 0
    changed = private.join(left.select("doc_id", F.col("text").alias("before")), "doc_id").where("text != before")
    # digits and letters are replaced at their places; only octets and dates without leading zeros change their lengths
    kept = r"regexp_replace({}, '[0-9A-Za-z]+', 'x')"
    assert 0 < changed.count() < left.count() and changed.where(f"{kept.format('text')} != {kept.format('before')}").count() == 0
    pieces = stages.packing(private).collect()
    total = {r["doc_id"]: r["doc_tokens"] for r in pieces}
    assert len(total) == left.count() and sum(r["length"] for r in pieces) == sum(total.values())
    assert all(len(r["ids"]) == 4 * r["length"] for r in pieces)


def test_near_copies_go_and_others_stay(spark):
    base = " ".join(f"word{i * i % 997}" for i in range(400))
    near = next(t for i in range(400) if (simhash(t := base.replace(f"word{i * i % 997} ", "other ", 1)) ^ simhash(base)).bit_count() <= 3 and t != base)
    other = " ".join(f"word{i * 31 % 991}" for i in range(400))
    docs = spark.createDataFrame([(3, near), (1, base), (2, base), (9, other), (9, other), (None, other)], "doc_id long, text string").withColumns({c: F.lit("x") for c in CLASHING})
    out = stages.near_dedup(docs)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 9]


@pytest.mark.parametrize("kind", ["edges", "empty"])
def test_run(spark, kind, request):
    out = corpus_pipeline.run(spark, request.getfixturevalue(kind))
    n = out.count()
    assert (n == 0) == (kind == "empty") and "sequence_id" in out.columns


def test_run_is_its_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
    want = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    sums = [df.groupBy("doc_id").agg(F.sum("length"), F.max("doc_tokens")) for df in (want, corpus_pipeline.run(spark, DATA))]
    assert rows(sums[0]) == rows(sums[1])


def test_workers_get_small_batches(spark, monkeypatch):
    def watched(batches, *a, **b):
        def small():
            for batch in batches:
                assert batch.nbytes < 1.25 * BATCH_BYTES, batch.nbytes
                yield batch

        yield from text_slices(small(), *a, **b)

    for module in (op1_packing, op6_langid, shingles):
        monkeypatch.setattr(module, "text_slices", watched)
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.concat(F.lit("some words of "), "id", F.lit(" ")), 400)).alias("text"), F.lit("en").alias("lang"))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        for stage in (stages.language, stages.similar_dedup, stages.packing):
            spark.conf.set(name, "64m")
            assert stage(docs).select("doc_id").distinct().count() == 3000
        spark.conf.set(name, "1m")
        small_batches(spark)
        assert spark.conf.get(name) == "1m"  # a lower limit stays
    finally:
        spark.conf.set(name, before)


def test_language_keeps_rows_as_they_are(spark):
    docs = spark.createDataFrame([(1, "en", "some words of a text"), (2, None, "other words of a text"), (3, "en", "123"), (4, "en", None)], "fit long, lang string, text string")
    docs = docs.select("fit", "text", "lang", F.col("fit").alias("doc_id"), F.lit(1).alias("rest_of_row"))
    for kind in ("string", "binary"):
        given = docs.withColumn("text", F.col("text").cast(kind))
        out = stages.language(given)
        assert out.schema.simpleString() == given.schema.simpleString()
        assert rows(out) == rows(given.where("doc_id < 3"))
