"""Queries over what the engine's sources and sinks have written and read: tables to files in shared storage and back.

Each writes a table in one of the formats, reads it with the engine's reader and returns what came out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import operators as op
from ..functions import sequences as fn
from ..operators.tables import own_dir, table
from ..params import MiningParams
from ..sources import (
    load_dictionary,
    load_encoded,
    read_encoded_text,
    read_int_sequences,
    read_length_prefixed,
    read_sentences,
    read_sequences,
    read_timed,
)
from ..sources.text import numeric_ids
from . import databases as db
from .job import encode_text, mine_encoded, run

GAPS = MiningParams(10, 1, 3)


def _place(spark: SparkSession, name: str) -> str:
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _lines(df: DataFrame, *columns) -> DataFrame:
    return df.select(F.concat_ws(" ", *columns).alias("value"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.collect(db.events(spark, sf_dir))


def _event_lines(spark: SparkSession, sf_dir: str, path: str) -> str:
    """Lines `user event event ...` in two folders, with a file that is no text beside them."""
    rows = _events(spark, sf_dir)
    for k in (0, 1):
        part = rows.where(F.col("sid") % 2 == k)
        # dealt to one task as lines: coalesce would have it sort and gather all events as well
        _lines(part, F.col("sid").cast("string"), "items").repartition(1).write.text(f"{path}/users{k}")
    rows.select(F.col("sid").cast("string").alias("value")).write.option("header", True).csv(f"{path}/other")
    return path


def _shown(rows: DataFrame, seq_id: str = "seq_id") -> DataFrame:
    return rows.select(F.col(seq_id), fn.pattern_text(F.col("items").cast("array<string>")).alias("sequence"))


def read_text_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only *.txt of a folder with folders in it."""
    return _shown(read_sequences(spark, _event_lines(spark, sf_dir, _place(spark, "text")), pattern="*.txt"))


def read_numeric_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(numeric_ids(read_sequences(spark, _event_lines(spark, sf_dir, _place(spark, "text")), pattern="*.txt")))


def read_separated_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with blanks in them, separated by tabs; compressed."""
    path = _place(spark, "tabs")
    rows = op.collect(db.orders(spark, sf_dir))
    rows.select(F.concat_ws("\t", F.col("sid").cast("string"), "items").alias("value")).write.option("compression", "gzip").text(path)
    return _shown(read_sequences(spark, path, sep="\t"))


def read_sentence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "sentences")
    _lines(db.turn_sequences(spark, sf_dir), "items").write.text(path)
    return read_sentences(spark, path).groupBy(fn.pattern_text("items").alias("sequence")).agg(F.count(F.lit(1)).alias("n"))


def read_first_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten lines of each file, of which there is one."""
    path = _place(spark, "sentences")
    lines = db.turn_sequences(spark, sf_dir).select("sid", F.concat_ws(" ", "items").alias("value"))
    lines.orderBy("sid").select("value").coalesce(1).write.text(path)
    return read_sentences(spark, path, max_docs=10).select(fn.pattern_text("items").alias("sequence"))


def read_length_prefixed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "lengths")
    _lines(_events(spark, sf_dir), F.col("sid").cast("string"), F.size("items").cast("string"), "items").write.text(path)
    return _shown(read_length_prefixed(spark, path))


def mine_timed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same patterns as mine_timed_events, by way of lines `user hour event hour event ...`."""
    rows = db.read(spark, sf_dir, "events").where("event_type IS NOT NULL")
    hour = F.floor(F.unix_timestamp("ts") / 3600)
    lines = rows.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(hour.alias("t"), "event_id", "event_type"))).alias("x"))
    words = F.flatten(F.transform("x", lambda e: F.array(e["t"].cast("string"), e["event_type"])))
    path = _place(spark, "timed")
    _lines(lines, F.col("user_id").cast("string"), words).write.text(path)
    return op.as_text(op.mine(read_timed(spark, path, strict=True), MiningParams(10, 24, 3)))


def read_integers_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each item stands at each position; a gap of event_id mod 3 stands before each event."""
    rows = db.read(spark, sf_dir, "events").where("event_type IS NOT NULL")
    lines = rows.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("x"))
    gap = lambda e: F.when(e["event_id"] % 3 > 0, F.array((-(e["event_id"] % 3)).cast("string"))).otherwise(F.array().cast("array<string>"))
    words = F.flatten(F.transform("x", lambda e: F.concat(gap(e), F.array(F.ascii(e["event_type"]).cast("string")))))
    path = _place(spark, "integers")
    lines.select(F.concat_ws("\t", words).alias("value")).write.text(path)
    return read_int_sequences(spark, path).groupBy("pos", "item").agg(F.count(F.lit(1)).alias("n"))


def read_encoded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids as text; written twice, since a sink replaces what is there."""
    events = db.events(spark, sf_dir)
    path = _place(spark, "encoded-text")
    encoded = op.collect(op.encode(events, op.dictionary(op.collect(events), unique=True)))
    op.write_encoded_text(encoded.limit(1), path)
    op.write_encoded_text(encoded, path)
    return _shown(read_encoded_text(spark, path))


def dictionary_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The f-list written and read again, its frequent rows and three of its columns."""
    path = _place(spark, "dictionary")
    op.write_dictionary(op.dictionary(db.document_sequences(spark, sf_dir)), path)
    return load_dictionary(spark, path, min_df=5, min_cf=10, columns=["item", "df", "id"])


def dictionary_sorted_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item of the f-list's single file with the one on the line before."""
    events = _events(spark, sf_dir)
    path = _place(spark, "dictionary")
    op.write_dictionary(op.dictionary(events, unique=True), path, single_file=True)
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    items = lines.select(F.split("value", "\t")[0].alias("item"), (F.col("line")).alias("line"))
    before = items.select(F.col("item").alias("before"), (F.col("line") + 1).alias("line"))
    return items.join(before, "line").select("item", "before")


def dictionary_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(op.dictionary(_events(spark, sf_dir), unique=True), "dictionary")
    return op.lookup(d, id=1).unionByName(op.lookup(d, item="click")).distinct()


def encoded_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded positions and dictionary, saved compressed and loaded, decoded."""
    events = db.events(spark, sf_dir)
    d = op.dictionary(op.collect(events), unique=True)
    path = _place(spark, "kept")
    op.save_encoded(op.encode(events, d), d, path, codec="gzip")
    positions, loaded = load_encoded(spark, path)
    return positions.join(loaded.select(F.col("id").alias("item"), F.col("item").alias("name")), "item").select("sid", F.col("pos").cast("long").alias("pos"), "name")


def pattern_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns as lines of text."""
    path = _place(spark, "patterns")
    op.write_patterns(op.mine(db.events(spark, sf_dir), GAPS), path, files=2)
    part = F.split("value", "\t")
    return spark.read.text(path).select(part[0].alias("pattern"), part[1].cast("long").alias("support"))


def pattern_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded patterns written, read and decoded."""
    events = db.events(spark, sf_dir)
    d = table(op.dictionary(op.collect(events), unique=True), "dictionary")
    path = _place(spark, "patterns")
    op.write_encoded_patterns(op.mine(op.encode(events, d), GAPS), path)
    return op.as_text(op.decode(spark.read.parquet(path), d))


def resumed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run prints that resumes with other parameters from what the first has kept."""
    source, kept, out = (_place(spark, n) for n in ("text", "kept", "out"))
    _lines(_events(spark, sf_dir), F.col("sid").cast("string"), "items").write.text(source)
    run(spark, MiningParams(1000, 0, 2), out, input=source, keep_files=kept)
    run(spark, MiningParams(10, 1, 3, "closed"), out, resume=kept)
    part = F.split("value", "\t")
    return spark.read.text(out).select(part[0].alias("pattern"), part[1].cast("long").alias("support"))


def mine_each_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files mined by themselves over one dictionary."""
    source = _event_lines(spark, sf_dir, _place(spark, "text"))
    found = mine_encoded(encode_text(spark, source, pattern="*.txt"), MiningParams(5, 1, 3, "maximal", per_file=True))
    return found.select(F.regexp_extract("file", "/(users[01])/", 1).alias("users"), fn.pattern_text("seq").alias("pattern"), "support")


def pivot_sequences_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a partition gets, from short to long; dealt by partition."""
    from .queries import _events_pivot

    encoded, parts = _events_pivot(spark, sf_dir)
    rows = op.by_partition(op.rewrite(encoded, parts, MiningParams(10, 0, 2)), n=4)
    return rows.select("part", "sid", fn.pattern_text(F.col("items").cast("array<string>")).alias("sequence"))


def pivot_one_partition_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .queries import _events_pivot

    encoded, parts = _events_pivot(spark, sf_dir)
    rows = op.by_partition(op.rewrite(encoded, parts, MiningParams(10, 0, 2)), only=0)
    return rows.select("part", "sid", fn.pattern_text(F.col("items").cast("array<string>")).alias("sequence"))


def _encoded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = db.events(spark, sf_dir)
    return op.collect(op.encode(events, op.dictionary(op.collect(events), unique=True)))


def array_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions over arrays, of each user's ids and those of the user after."""
    rows = table(_encoded_events(spark, sf_dir), "encoded")
    both = rows.join(rows.select((F.col("sid") - 1).alias("sid"), F.col("items").alias("other")), "sid")
    a, b = F.col("items"), F.col("other")
    key = fn.pair_key(F.size(a), F.size(b))
    ends = F.concat(F.slice(a, 1, 2), F.slice(a, 1, 2))
    return both.select(
        "sid", fn.common_prefix_length(a, b).cast("long").alias("prefix"), fn.array_text(a).alias("said"), fn.array_text(fn.delta_encode(a)).alias("deltas"),
        (fn.delta_decode(fn.delta_encode(a)) == a).alias("decoded"), fn.pivot(a).alias("pivot"), fn.has_pivot(a, 3, 4).alias("rare"),
        key.alias("pair"), (fn.pair_left(key) + fn.pair_right(key)).cast("long").alias("pair_sum"), (fn.by_length_then_items(a) < fn.by_length_then_items(b)).alias("before_other"),
        F.size(fn.drop_equal_neighbours(F.array(a, a, b))).cast("long").alias("segments"), (F.xxhash64(a) == F.xxhash64(b)).alias("same_hash"), F.size(ends).cast("long").alias("n_ends"),
    )


def array_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of users in the orders of their arrays, within those that begin alike, and what arrays are dealt by."""
    rows = _encoded_events(spark, sf_dir)
    a = F.col("items")
    alike = W.partitionBy(fn.partition_key(a, "first"))
    places = [F.row_number().over(alike.orderBy(*fn.ordering(a, kind), "sid")).cast("long").alias(kind) for kind in ("descending", "ascending", "by_length")]
    return rows.select("sid", *places, *(fn.array_text(fn.partition_key(a, kind)).alias(kind) for kind in ("first_two", "all_but_last", "complete")))


def gap_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often how many positions lie between frequent words of documents that follow one another."""
    frequent = op.frequent_items(op.dictionary(db.document_sequences(spark, sf_dir)), 20)
    rows = op.encode(db.documents(spark, sf_dir), frequent).select("sid", "pos")
    before = F.lag("pos").over(W.partitionBy("sid").orderBy("pos"))
    gaps = rows.withColumn("gap", fn.gap_between(before, F.col("pos"))).where("gap IS NOT NULL")
    return gaps.groupBy("gap").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        read_text_sequences, read_numeric_ids, read_separated_sequences, read_sentence_lines, read_first_sentences, read_length_prefixed_sequences, mine_timed_text,
        read_integers_with_gaps, read_encoded_lines, dictionary_file, dictionary_sorted_file, dictionary_lookup, encoded_file, pattern_lines, pattern_file, resumed_run,
        mine_each_file, pivot_sequences_events, pivot_one_partition_events, array_functions, array_orders, gap_lengths,
    )
}
