import random
from itertools import product

import pytest

from seqmine.operators import condense, mine, mine_levels, positions
from seqmine.params import MiningParams


def db(spark, lines):
    rows = [(i, line.split()) for i, line in enumerate(lines)]
    return positions(spark.createDataFrame(rows, "sid long, items array<string>"))


def found(df):
    return {" ".join(r["seq"]): r["support"] for r in df.collect()}


def brute(lines, sigma, gamma, lam, kind="all"):
    """By the definition: every word sequence, every transaction, every match."""

    def ends(seq, t):
        at = {i for i, x in enumerate(t) if x == seq[0]}
        for s in seq[1:]:
            at = {j for i in at for j in range(i + 1, min(len(t), i + gamma + 2)) if t[j] == s}
        return at

    data = [line.split() for line in lines]
    level = [(x,) for x in sorted({x for t in data for x in t})]
    every = {}
    for k in range(1, lam + 1):
        counts = {s: sum(bool(ends(s, t)) for t in data) for s in level}
        kept = {s: n for s, n in counts.items() if n >= sigma}
        every |= kept
        items = {s[0] for s in every if len(s) == 1}
        level = [s + (x,) for s, x in product(kept, sorted(items))]
    if kind == "all":
        return {" ".join(s): n for s, n in every.items() if len(s) > 1}
    gone = set()
    for s, n in every.items():
        for part in (s[:-1], s[1:]):
            if part and (kind == "maximal" or every[part] == n):
                gone.add(part)
    return {" ".join(s): n for s, n in every.items() if s not in gone}


SENTENCES = [
    "Central Park is the best place to be on a sunny day in New York",
    "Monday was a sunny day in New York",
    "It was a sunny and beautiful New York City afternoon",
]


def test_golden(spark):
    want = dict.fromkeys(("sunny New York", "a sunny New", "New York", "sunny New", "a sunny"), 3)
    assert found(mine(db(spark, SENTENCES), MiningParams(3, 2, 3))) == want
    for kind in ("maximal", "closed"):
        assert found(mine(db(spark, SENTENCES), MiningParams(3, 2, 3, kind))) == dict.fromkeys(("sunny New York", "a sunny New"), 3)


@pytest.mark.parametrize(
    ("lines", "params", "want"),
    [
        (["a x b", "a y b"], MiningParams(2, 0, 3), {}),
        (["a x b", "a y b"], MiningParams(2, 1, 3), {"a b": 2}),
        (["a x y b", "a v w b"], MiningParams(2, 1, 3), {}),  # pruned items keep their positions
        (["a a", "a a"], MiningParams(2, 0, 3), {"a a": 2}),
        (["a b a b", "a b"], MiningParams(2, 0, 2), {"a b": 2}),  # once in each sequence
        (["a b c", "a b c"], MiningParams(2, 1, 3, "maximal"), {"a b c": 2, "a c": 2}),
        (["a b c d", "a b c d"], MiningParams(2, 0, 3, "maximal"), {"a b c": 2, "b c d": 2}),
        (["a b c", "a b c", "a b"], MiningParams(2, 0, 3, "closed"), {"a b": 3, "a b c": 2}),
        (["a b c", "a b c", "a b"], MiningParams(2, 0, 3, "maximal"), {"a b c": 2}),
        (["a b", "c d"], MiningParams(9, 0, 3), {}),
    ],
)
def test_edges(spark, lines, params, want):
    assert found(mine(db(spark, lines), params)) == want


def test_random_against_definition(spark):
    rnd = random.Random(7)
    for kind, strategy, gamma, lam in (("all", "levelwise", 1, 4), ("closed", "levelwise", 0, 3), ("maximal", "pivot", 1, 3), ("all", "pivot", 2, 3)):
        lines = [" ".join(rnd.choice("aabbcdefg") for _ in range(rnd.randint(1, 9))) for _ in range(40)]
        got = found(mine(db(spark, lines), MiningParams(5, gamma, lam, kind, strategy, partition_size=rnd.choice([1, 30, 10_000]))))
        assert got == brute(lines, 5, gamma, lam, kind), (kind, strategy, gamma, lam)


def test_properties(spark):
    rnd = random.Random(3)
    base = db(spark, [" ".join(rnd.choice("abcd") for _ in range(8)) for _ in range(30)])
    every = mine_levels(base, MiningParams(6, 1, 3)).cache()
    supports = {tuple(r["seq"]): r["support"] for r in every.collect()}
    assert all(supports[s[:-1]] >= n and supports[s[1:]] >= n for s, n in supports.items() if len(s) > 1)
    maximal, closed = (set(found(condense(every, k))) for k in ("maximal", "closed"))
    assert maximal <= closed <= {" ".join(s) for s in supports}
    assert found(mine(base, MiningParams(6, 1, 2))) == {" ".join(s): n for s, n in supports.items() if len(s) == 2}


def test_weights(spark):
    lines = ["a b", "a b", "b c"]
    packed = spark.createDataFrame([(1, ["a", "b"], 2), (2, ["b", "c"], 1)], "sid long, items array<string>, weight long")
    assert found(mine(positions(packed, "weight"), MiningParams(2, 0, 2))) == found(mine(db(spark, lines), MiningParams(2, 0, 2))) == {"a b": 2}


def test_empty(spark):
    out = mine(positions(spark.createDataFrame([], "sid long, items array<string>")), MiningParams(1, 0, 3))
    assert out.columns == ["seq", "length", "support"] and out.count() == 0


@pytest.mark.parametrize("bad", [{"sigma": 0}, {"gamma": -1}, {"lam": 1}, {"partition_size": 0}, {"type": "most"}, {"strategy": "other"}, {"num_reducers": 0}, {"sigma": True}])
def test_parameters(bad):
    with pytest.raises(ValueError):
        MiningParams(**bad)
