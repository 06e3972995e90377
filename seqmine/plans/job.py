"""The whole run: sequences, dictionary, encoding, mining, translation, output."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import operators as op
from ..functions.sequences import WHITE
from ..operators.condense import condense
from ..operators.tables import own_dir, table
from ..params import ALL, MiningParams
from ..sources.encoded import load_encoded
from ..sources.text import read_sequences


@dataclass(frozen=True)
class Encoded:
    """Encoded positions (sid, pos, item as id[, file]) and their dictionary."""

    positions: DataFrame
    dictionary: DataFrame

    def save(self, path: str) -> None:
        op.save_encoded(self.positions, self.dictionary, path)


def encode_text(spark: SparkSession, path: str, sep: str = WHITE, pattern: str | None = None) -> Encoded:
    """Text lines to ids. The lines are read twice, once to count and once to encode, and never held."""
    sequences = read_sequences(spark, path, sep, pattern, with_file=True)
    dictionary = op.dictionary(sequences.select("sid", "items"), unique=True)
    return Encoded(op.encode(op.positions(sequences, "file"), dictionary), dictionary)


def mine_encoded(encoded: Encoded, params: MiningParams) -> DataFrame:
    """(seq of names, length, support), and file if each file is mined by itself."""
    group = ["file"] if params.per_file else []
    if params.per_file:
        every = op.mine_levels(encoded.positions.select("file", "sid", "pos", "item"), params, ["file", "sid"])
        found = every.where("length >= 2") if params.type == ALL else condense(table(every, "patterns"), params.type, group)
    else:
        found = op.mine(encoded.positions.select("sid", "pos", "item"), params)
    return op.decode(table(found, "found"), encoded.dictionary).select(*group, "seq", "length", "support")


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.option("recursiveFileLookup", True).text(path)  # looks the path up and reads nothing
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def run(
    spark: SparkSession,
    params: MiningParams,
    output: str,
    input: str | None = None,
    resume: str | None = None,
    keep_files: str | None = None,
    temp_dir: str | None = None,
    sep: str = WHITE,
    pattern: str | None = None,
) -> DataFrame:
    """Mines input (text) or resume (a folder that an earlier run kept) and writes `items<TAB>support` to output.

    Everything is validated before anything is written or overwritten. Returns the patterns."""
    if (input is None) == (resume is None):
        raise ValueError("give an input or a folder to resume from, and not both")
    if keep_files and resume:
        raise ValueError("what is resumed from is kept already")
    source = input or resume
    if not _exists(spark, source):
        raise FileNotFoundError(source)
    if output.rstrip("/") in {p.rstrip("/") for p in (source, keep_files or "", temp_dir or "") if p}:
        raise ValueError("the output would replace another folder of the run")
    if temp_dir and temp_dir != "temp":
        spark.conf.set("spark.checkpoint.dir", temp_dir)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    if params.num_reducers:
        spark.conf.set("spark.sql.shuffle.partitions", params.num_reducers)
    if resume:
        encoded = Encoded(*load_encoded(spark, resume))
    else:
        encoded = encode_text(spark, input, sep, pattern)
        # encoded once, whether the caller keeps it or not: mining reads it again at each level
        place = keep_files or f"{own_dir(spark)}/encoded"
        encoded.save(place)
        encoded = Encoded(*load_encoded(spark, place))
    patterns = mine_encoded(encoded, params)
    op.write_patterns(patterns.orderBy(F.desc("support"), F.concat_ws(" ", "seq")), output)
    spark.conf.set("spark.sql.shuffle.partitions", before)
    return patterns
