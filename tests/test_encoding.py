"""Dictionaries and encoding at a size where only the most frequent items are broadcast."""

import importlib

import duckdb
import pytest
from pyspark.sql import functions as F

from seqmine import operators as op
from seqmine.functions import sequences as fn
from seqmine.plans.oracles import ORACLES
from seqmine.plans.queries import QUERIES
from seqmine.sources import from_text_column

DATA = "/root/testdata/sf0.001"
ENCODE = importlib.import_module("seqmine.operators.encode")  # the package has the function by this name


@pytest.mark.parametrize("limits", [(100, 8 << 20), (100, 10)])
@pytest.mark.parametrize("name", ["encode_documents", "translate_roundtrip", "split_at_gap_segments", "gap_lengths"])
def test_rare_items_too(spark, monkeypatch, name, limits):
    """By the head and the rest, and with no head at all."""
    monkeypatch.setattr(ENCODE, "HEAD", limits[0])
    monkeypatch.setattr(ENCODE, "HEAD_BYTES", limits[1])
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = con.sql(ORACLES[name]).select(*columns)
    assert sorted(tuple(r) for r in df.select(*columns).collect()) == sorted(want.fetchall())


def test_a_dictionary_may_lack_ids(spark, monkeypatch):
    """Frequent items only: fewer than HEAD, some of them beyond it."""
    monkeypatch.setattr(ENCODE, "HEAD", 3)
    d = spark.createDataFrame([("a", 1), ("z", 90)], "item string, id long")
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "x"), (1, 2, "z")], "sid long, pos long, item string")
    coded = op.encode(rows, d)
    assert sorted(map(tuple, coded.collect())) == [(1, 0, 1), (1, 2, 90)]
    assert sorted(map(tuple, op.names(coded, d).collect())) == [(1, 0, "a"), (1, 2, "z")]


def _dealt(spark, run) -> int:
    """Rows that exchanges get while run() runs."""
    store = spark._jsparkSession.sharedState().statusStore()
    before, total = store.executionsList().size(), {}
    run()
    runs = store.executionsList()
    for k in range(before, runs.size()):
        metrics, values = runs.apply(k).metrics(), store.executionMetrics(runs.apply(k).executionId())
        for m in map(metrics.apply, range(metrics.size())):
            if m.name() == "shuffle records written" and values.contains(m.accumulatorId()):
                total[m.accumulatorId()] = int(values.apply(m.accumulatorId()).replace(",", ""))
    return sum(total.values())


def test_only_sums_are_dealt(spark):
    """A frequent item isn't dealt once for each sequence, nor a token of one."""
    rows = spark.range(3000).select(F.col("id").alias("sid"), F.split(F.lit("a b c a b d"), " ").alias("items")).repartition(3)
    rows = op.table(rows, "rows")
    counts = op.item_counts(rows)
    assert {tuple(r) for r in counts.collect()} == {("a", 6000, 3000), ("b", 6000, 3000), ("c", 3000, 3000), ("d", 3000, 3000)}
    assert 0 < _dealt(spark, lambda: op.item_counts(rows, unique=True).collect()) <= 100
    d = op.table(op.dictionary(rows), "dictionary")
    assert _dealt(spark, lambda: op.encode(op.positions(rows), d).collect()) <= 20


def test_first_sentences_deal_lines(spark):
    """The task that writes the file gets a row for each line, not one for each word."""
    lines = spark.read.parquet(f"{DATA}/conversations.parquet").count()
    assert lines // 2 < _dealt(spark, lambda: QUERIES["read_first_sentences"](spark, DATA).collect()) <= lines + 20


def test_counts_of_repeated_and_missing_ids(spark):
    rows = spark.createDataFrame([(1, ["a", "b"]), (1, ["a"]), (2, ["a"]), (None, ["a", "c"])], "sid long, items array<string>")
    assert {tuple(r) for r in op.item_counts(rows).collect()} == {("a", 4, 2), ("b", 1, 1), ("c", 1, 0)}


def test_words_and_tokens(spark):
    texts = ["a b", " a  b ", "\t\n", "", None, "\x0ba\x0c\r", "a b c"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "sid long, s string")
    tokens = [r[0] for r in df.select(fn.tokenize("s")).collect()]
    assert tokens == [["a", "b"], ["", "a", "b"], [], [], [], ["", "a"], ["a b", "c"]]
    assert {r["sid"]: r["items"] for r in from_text_column(df, "s", F.col("sid")).collect()} == {0: ["a", "b"], 1: ["a", "b"], 5: ["a"], 6: ["a b", "c"]}
