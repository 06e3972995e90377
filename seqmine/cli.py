"""Command line: python -m seqmine.cli -i IN -o OUT -s 3 -g 2 -l 3 -t a"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from . import operators as op
from .params import LEVELWISE, PIVOT, MiningParams, pattern_type
from .plans.job import run
from .sources import read_sentences, read_sequences


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="seqmine", description="Frequent sequences under support, gap and length constraints")
    p.add_argument("command", nargs="?", default="mine", choices=["mine", "wordcount", "stats", "sentences"])
    p.add_argument("-i", "--input")
    p.add_argument("-o", "--output")
    p.add_argument("-s", "--support", type=int, default=1)
    p.add_argument("-g", "--gamma", type=int, default=0)
    p.add_argument("-l", "--lambda", dest="lam", type=int, default=5)
    p.add_argument("-m", "--execMode", default="s", type=str.lower, choices=["s", "d"], help="d: by pivot partitions; the result is the same")
    p.add_argument("-t", "--type", default="a", help="(a)ll, (m)aximal, (c)losed")
    p.add_argument("-k", "--keepFiles")
    p.add_argument("-r", "--resume")
    p.add_argument("--tempDir", "-tempDir")
    p.add_argument("-N", "--numReducers", type=int)
    p.add_argument("-p", "--partitionSize", type=int, default=10_000)
    p.add_argument("-id", "--indexing", default="none", choices=["none", "minmax", "full"], help="accepted; changes nothing")
    p.add_argument("-sp", "--split", action="store_true", help="accepted; changes nothing")
    p.add_argument("--perFile", action="store_true", help="mine each file by itself")
    p.add_argument("--sep", default=None, help="separator of items, a regular expression; white space by default")
    p.add_argument("--pattern", default=None, help="only files of this name, as *.txt")
    p.add_argument("--maxDocs", type=int, default=0, help="sentences: lines of each file at most")
    return p


def main(argv: Sequence[str] | None = None) -> int:
    p = parser()
    a = p.parse_args(argv)
    if not a.output:
        p.error("an output is needed")
    try:
        params = MiningParams(a.support, a.gamma, a.lam, pattern_type(a.type), PIVOT if a.execMode == "d" else LEVELWISE, a.partitionSize, a.numReducers, a.perFile, a.indexing, a.split)
    except ValueError as e:
        p.error(str(e))
    spark = SparkSession.builder.appName("seqmine").getOrCreate()
    sep = {"sep": a.sep} if a.sep else {}
    if a.command == "mine":
        run(spark, params, a.output, a.input, a.resume, a.keepFiles, a.tempDir, **sep, pattern=a.pattern)
        op.drop_tables(spark)
        return 0
    if not a.input:
        p.error("an input is needed")
    if a.command == "sentences":
        sentences = read_sentences(spark, a.input, a.maxDocs, **sep)
        dictionary = op.dictionary(sentences)
        op.save_encoded(op.encode(op.positions(sentences), dictionary), dictionary, a.output)
        return 0
    sequences = read_sequences(spark, a.input, **sep, pattern=a.pattern)
    if a.command == "wordcount":
        op.word_count(sequences, a.support).write.mode("overwrite").csv(a.output, sep="\t", quote="", escape="")
    else:
        op.length_histogram(sequences).write.mode("overwrite").csv(f"{a.output}/length", sep="\t")
        op.distinct_items_histogram(sequences).write.mode("overwrite").csv(f"{a.output}/distinct", sep="\t")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
