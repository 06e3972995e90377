"""The engine's queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import operators as op
from ..functions.sequences import pattern_text
from ..params import CLOSED, MAXIMAL, PIVOT, MiningParams
from ..sources.timed import timed_positions
from . import databases as db
from . import roundtrips

#: name: (database, sigma, gamma, lam, type)
MINING = {
    "mine_all_events": (db.events, 10, 1, 3, "all"),
    "mine_all_events_gap0": (db.events, 10, 0, 3, "all"),
    "mine_all_events_len4": (db.events, 20, 2, 4, "all"),
    "mine_maximal_events": (db.events, 10, 1, 3, MAXIMAL),
    "mine_closed_events": (db.events, 10, 1, 3, CLOSED),
    "mine_all_orders": (db.orders, 10, 0, 3, "all"),
    "mine_closed_orders": (db.orders, 10, 0, 3, CLOSED),
    "mine_all_brands": (db.brands, 10, 0, 3, "all"),
    "mine_maximal_brands": (db.brands, 10, 0, 3, MAXIMAL),
    "mine_ngrams_documents": (db.documents, 20, 0, 3, "all"),
    "mine_phrases_conversations": (db.turns, 10, 1, 3, "all"),
}
Q = Callable[[SparkSession, str], DataFrame]


def _mining(name: str) -> Q:
    source, sigma, gamma, lam, kind = MINING[name]
    source = db.WHOLE.get(source, source)
    return lambda spark, sf_dir: op.as_text(op.mine(source(spark, sf_dir), MiningParams(sigma, gamma, lam, kind)))


def mine_pivot_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same patterns as mine_all_events, by pivot partitions."""
    return op.as_text(op.mine(db.events(spark, sf_dir), MiningParams(10, 1, 3, strategy=PIVOT, partition_size=200)))


def mine_timed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with gaps in hours, 24 at most."""
    rows = db.read(spark, sf_dir, "events")
    timed = timed_positions(rows, "user_id", F.unix_timestamp("ts") / 3600, "event_type", ["event_id"])
    return op.as_text(op.mine(timed, MiningParams(10, 24, 3)))


def mine_weighted_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal sequences packed into one with a weight: the same patterns as mine_all_orders."""
    packed = op.pack_duplicates(op.collect(db.orders(spark, sf_dir))).withColumn("sid", F.xxhash64("items"))
    return op.as_text(op.mine(op.table(packed, "packed"), MiningParams(10, 0, 3)))


def dictionary_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.dictionary(db.document_sequences(spark, sf_dir))


def word_count_minsup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.word_count(db.document_sequences(spark, sf_dir), 50)


def flist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.frequent_items(dictionary_documents(spark, sf_dir), 20)


def encode_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.encode(db.documents(spark, sf_dir), dictionary_documents(spark, sf_dir))


def translate_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents encoded, decoded and joined to text again."""
    dictionary = dictionary_documents(spark, sf_dir)
    back = op.names(op.encode(db.documents(spark, sf_dir), dictionary), dictionary)
    return op.collect(back).select("sid", F.md5(pattern_text("items").cast("binary")).alias("text_md5"))


def pivot_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.pack_items(flist(spark, sf_dir), 1, 1000)


def _events_pivot(spark: SparkSession, sf_dir: str):
    events = db.events(spark, sf_dir)
    dictionary = op.dictionary(op.collect(events), unique=True)
    return op.encode(events, dictionary), op.pack_items(dictionary, 10, 200)


def pivot_rewrite_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded, parts = _events_pivot(spark, sf_dir)
    return op.rewrite(encoded, parts, MiningParams(10, 0, 2)).select("part", "sid", "pos", "item", F.col("is_pivot").cast("int").alias("is_pivot"))


def pivot_offsets_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.pivot_offsets(*_events_pivot(spark, sf_dir))


def pivot_intervals_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded, parts = _events_pivot(spark, sf_dir)
    return op.pivot_intervals(encoded, parts, MiningParams(10, 0, 3))


def weighted_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = op.pack_duplicates(op.collect(db.orders(spark, sf_dir)))
    return packed.select(pattern_text("items").alias("sequence"), "weight")


def total_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.total_support(op.collect(db.orders(spark, sf_dir)))


def stats_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.length_histogram(db.document_sequences(spark, sf_dir)).select(F.col("length").cast("long").alias("length"), "n")


def stats_distinct_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.distinct_items_histogram(db.document_sequences(spark, sf_dir)).select(F.col("distinct_items").cast("long").alias("distinct_items"), "n")


def max_pattern_by_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.max_support_by_left(op.mine_levels(db.events(spark, sf_dir), MiningParams(10, 1, 2)))


def split_at_gap_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of frequent words of documents with at most one word between neighbours."""
    frequent = op.encode(db.documents(spark, sf_dir), flist(spark, sf_dir))
    return op.segments(frequent.select("sid", "pos"), 1)


def posting_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The postings of 2-sequences of priorities, a row for each place where one begins."""
    lists = op.two_sequence_postings(db.orders(spark, sf_dir), MiningParams(10, 0, 2))
    return lists.select(pattern_text("seq").alias("pattern"), "support", "sid", F.explode("starts").alias("start")).select("pattern", "support", "sid", F.col("start").cast("long").alias("start"))


QUERIES: dict[str, Q] = {name: _mining(name) for name in MINING} | {
    f.__name__: f
    for f in (
        mine_pivot_events, mine_timed_events, mine_weighted_orders, dictionary_documents, word_count_minsup, flist, encode_documents,
        translate_roundtrip, pivot_partitions, pivot_rewrite_events, pivot_offsets_events, pivot_intervals_events, weighted_dedup,
        total_support, stats_length, stats_distinct_items, max_pattern_by_item, split_at_gap_segments, posting_list,
    )
} | roundtrips.QUERIES
