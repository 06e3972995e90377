"""Mining sequence by sequence: what it stores, long sequences, blocks that are taken in pieces."""

import importlib
import random

import numpy as np
from pyspark.sql import functions as F
from test_mining import brute, db, found

from seqmine.operators import chains, mine
from seqmine.params import MiningParams

LEVELS = importlib.import_module("seqmine.operators.mine")  # the package has the function by this name


def lines_of(rnd, n, longest, letters="aabbcdefg"):
    return [" ".join(rnd.choice(letters) for _ in range(rnd.randint(1, longest))) for _ in range(n)]


def test_no_table_has_a_row_for_each_occurrence(spark, monkeypatch):
    """Tables of occurrences are small as files and large once broadcast."""
    sizes, table = {}, LEVELS.table

    def noted(df, name):
        out = table(df, name)
        sizes[name] = sizes.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(LEVELS, "table", noted)
    lines = lines_of(random.Random(1), 30, 200, "abcde")
    got = found(mine(db(spark, lines), MiningParams(10, 0, 3)))
    assert got == brute(lines, 10, 0, 3)
    assert sum(sizes.values()) <= len(lines) + len(got) + 5


def test_long_sequences_are_several_rows(spark, monkeypatch):
    monkeypatch.setattr(LEVELS, "UNIT", 16)
    rnd = random.Random(5)
    lines = lines_of(rnd, 30, 12) + lines_of(rnd, 10, 90)
    for gamma, lam, kind in ((0, 3, "all"), (1, 3, "closed")):
        p = MiningParams(8, gamma, lam, kind)
        assert found(mine(db(spark, lines), p)) == brute(lines, 8, gamma, lam, kind)
    units = LEVELS._units(db(spark, lines), MiningParams(8, 1, 3), ["sid"])
    assert units.select(F.max(F.size("items"))).first()[0] <= 20 and units.where("seq IS NULL").count() >= 30


def test_rows_that_are_sequences(spark):
    """Weights, and ids that repeat and so belong to one sequence."""
    rows = [(1, ["a", "b"], 2), (2, ["a", "b", "c"], 3), (None, ["a", "b"], 9)]
    df = spark.createDataFrame(rows, "sid long, items array<string>, weight long")
    assert found(mine(df, MiningParams(2, 0, 2))) == {"a b": 5, "b c": 3}
    again = spark.createDataFrame([(1, ["a", "b"]), (1, ["a", "b"]), (2, ["a", "b"])], "sid long, items array<string>")
    assert found(mine(again, MiningParams(1, 0, 2)))["a b"] == 2


def test_hashes_are_those_of_spark(spark):
    rnd = random.Random(2)
    pairs = [(rnd.randrange(-(2**63), 2**63), rnd.randrange(-(2**63), 2**63)) for _ in range(50)] + [(0, 0), (-1, 1)]
    want = [r[0] for r in spark.createDataFrame(pairs, "a long, b long").coalesce(1).select(F.xxhash64("a", "b")).collect()]
    a, b = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
    assert chains.chain_hash(a, b).tolist() == want


def test_pieces_of_a_block(monkeypatch):
    """The same chains whether a block is extended at once or in pieces."""
    rnd = np.random.default_rng(3)
    n = 400
    at = np.concatenate([np.arange(k) for k in (150, 1, 249)])
    pos, code = np.cumsum(rnd.integers(1, 4, n)), rnd.integers(0, 9, n)
    every = np.full(2, ~np.uint64(0))
    for k in (2, 3, 4):
        masks = [chains.Mask(every)] * (k - 1)
        want = {*zip(*(x.tolist() for x in chains.block_chains(at, pos, code, k, 2, masks)), strict=True)}
        with monkeypatch.context() as m:
            m.setattr(chains, "PIECE", 7)
            got = [*zip(*(x.tolist() for x in chains.block_chains(at, pos, code, k, 2, masks)), strict=True)]
        assert len(got) == len({*got}) and {*got} == want and want
