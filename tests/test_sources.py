import pytest
from pyspark.sql import functions as F

from seqmine import operators as op
from seqmine.cli import main
from seqmine.functions import sequences as fn
from seqmine.params import MiningParams
from seqmine.plans.job import encode_text, mine_encoded, run
from seqmine.sources import load_dictionary, read_encoded_text, read_int_sequences, read_length_prefixed, read_sentences, read_sequences, read_timed


def write(path, *lines):
    path.write_text("".join(f"{x}\n" for x in lines))
    return str(path)


def test_sequences(spark, tmp_path):
    write(tmp_path / "a.txt", "s1 a b", "", "s1 a b", "only", "s3\tc  d ")
    got = sorted((r["seq_id"], r["items"]) for r in read_sequences(spark, str(tmp_path)).collect())
    assert got == [("s1", ["a", "b"]), ("s1", ["a", "b"]), ("s3", ["c", "d"])]
    assert read_sequences(spark, str(tmp_path)).select("sid").distinct().count() == 3
    tabs = write(tmp_path / "b.tsv", "id\tone two\tthree")
    assert read_sequences(spark, tabs, sep="\t").first()["items"] == ["one two", "three"]
    assert read_sequences(spark, str(tmp_path), pattern="*.tsv").count() == 1


def test_other_text_sources(spark, tmp_path):
    s = write(tmp_path / "s", "a b", "c", "d e")
    assert sorted(r["items"] for r in read_sentences(spark, s).collect()) == [["a", "b"], ["c"], ["d", "e"]]
    assert read_sentences(spark, s, max_docs=2).count() == 2
    p = write(tmp_path / "p", "7 2 x y", "x 9 z")
    assert sorted((r["seq_id"] or 0, r["items"]) for r in read_length_prefixed(spark, p).collect()) == [(0, ["z"]), (7, ["x", "y"])]
    i = write(tmp_path / "i", "5\t-2\t6\t7", "8")
    assert sorted((r["pos"], r["item"]) for r in read_int_sequences(spark, i).collect()) == [(0, 5), (0, 8), (3, 6), (4, 7)]
    e = write(tmp_path / "e", "1\t[4, 5]", "2\t[6]")
    assert sorted((r["seq_id"], r["items"]) for r in read_encoded_text(spark, e).collect()) == [("1", [4, 5]), ("2", [6])]


def test_timed(spark, tmp_path):
    def at(*lines, **kw):
        rows = read_timed(spark, write(tmp_path / "t", *lines), **kw).collect()
        return sorted((r["pos"], r["item"]) for r in rows)

    assert at("1 5 a 5 b 6 c") == [(0, "a"), (1, "b"), (2, "c")]
    assert at("1 0 a 4 b") == [(0, "a"), (4, "b")]
    assert at("1 4 b 0 a") == [(0, "a"), (4, "b")]
    assert at("1 0 a 4 b", time_scale=2) == [(0, "a"), (8, "b")]
    with pytest.raises(Exception, match="decreases"):
        at("1 4 b 0 a", strict=True)


def test_dictionary_round_trip(spark, tmp_path):
    path = write(tmp_path / "a.txt", "s b a a", "s b", 's " c')
    d = encode_text(spark, path).dictionary
    got = {r["item"]: (r["cf"], r["df"], r["id"]) for r in d.collect()}
    assert got == {"a": (2, 1, 1), "b": (2, 2, 2), '"': (1, 1, 3), "c": (1, 1, 4)}
    op.write_dictionary(d, str(tmp_path / "d"), single_file=True)
    assert {r["item"]: (r["cf"], r["df"], r["id"]) for r in load_dictionary(spark, str(tmp_path / "d")).collect()} == got
    assert [r["item"] for r in load_dictionary(spark, str(tmp_path / "d"), min_df=2, columns=["item"]).collect()] == ["b"]
    assert op.lookup(d, item="b").first()["id"] == 2 and op.lookup(d, id=1).first()["item"] == "a"


def test_job_keep_resume_and_cli(spark, tmp_path):
    write(tmp_path / "a.txt", "1 a b c", "2 a b")
    write(tmp_path / "b.txt", "3 a b", "4 x y")
    (tmp_path / "in").mkdir()
    for n in "ab":
        (tmp_path / f"{n}.txt").rename(tmp_path / "in" / f"{n}.txt")
    source, kept = str(tmp_path / "in"), str(tmp_path / "kept")

    def lines(name):
        return sorted(x for f in (tmp_path / name).glob("part-*") for x in f.read_text().splitlines())

    run(spark, MiningParams(2, 0, 3), str(tmp_path / "out"), input=source, keep_files=kept)
    assert lines("out") == ["a b\t3"]
    run(spark, MiningParams(1, 0, 3), str(tmp_path / "out2"), resume=kept)
    assert lines("out2") == ["a b\t3", "a b c\t1", "b c\t1", "x y\t1"]
    assert main(["-i", source, "-o", str(tmp_path / "out3"), "-s", "2", "-g", "1", "-l", "3", "-m", "D", "-t", "maximal"]) == 0
    assert lines("out3") == ["a b\t3"]
    assert main(["wordcount", "-i", source, "-o", str(tmp_path / "wc"), "-s", "3"]) == 0
    assert lines("wc") == ["a\t3", "b\t3"]
    own = mine_encoded(encode_text(spark, source), MiningParams(2, 0, 2, per_file=True)).collect()
    assert [(r["file"][-5:], r["seq"], r["support"]) for r in own] == [("a.txt", ["a", "b"], 2)]


def test_job_validates_first(spark, tmp_path):
    source = write(tmp_path / "a.txt", "1 a b")
    p = MiningParams(1)
    for kw, error in (({}, ValueError), ({"input": source, "resume": source}, ValueError), ({"resume": source, "keep_files": "x"}, ValueError), ({"input": "/no/such"}, FileNotFoundError)):
        with pytest.raises(error):
            run(spark, p, str(tmp_path / "out"), **kw)
    with pytest.raises(ValueError):
        run(spark, p, source, input=source)
    assert (tmp_path / "a.txt").read_text() == "1 a b\n"


def test_functions(spark):
    row = spark.createDataFrame([([1, 3, 6], [1, 3, 9, 9], " x  y ")], "a array<long>, b array<long>, s string")
    a, b = F.col("a"), F.col("b")
    got = row.select(
        fn.common_prefix_length(a, b), fn.delta_encode(a), fn.delta_decode(fn.delta_encode(a)), fn.pivot(b), fn.has_pivot(a, 4, 6), fn.array_text(a),
        fn.tokenize("s"), fn.pair_left(fn.pair_key(F.lit(7), F.lit(9))), fn.pair_right(fn.pair_key(F.lit(7), F.lit(9))), fn.gap_between(F.lit(2), F.lit(5)), fn.pattern_text(a.cast("array<string>")),
    ).first()
    assert list(got) == [2, [1, 2, 3], [1, 3, 6], 9, True, "[1, 3, 6]", ["", "x", "y"], 7, 9, 2, "1 3 6"]
    assert spark.range(1).select(fn.common_prefix_length(F.array(F.lit(1)), F.array(F.lit(1), F.lit(2)))).first()[0] == 1


def test_rewrite_keeps_pivot_patterns(spark):
    """The demo vectors: what pivots can form is the same before and after the rewrite."""
    for text, gamma in (("1 3 6 100 1 3 4 7", 0), ("1 3 6 100 100 1 3 4 7", 1), ("1 3 6 100 100 2 4 6", 1), ("1 7 6 100 2 7 6", 0), ("100 100 1 3 6 100 2 3 6 100 4 3 6 100 100", 0)):
        items = [int(x) for x in text.split()]
        raw = spark.createDataFrame([(1, i, x) for i, x in enumerate(items)], "sid long, pos long, item int")
        parts = spark.createDataFrame([(0, 6, 8)], "part int, begin_item int, end_item int")
        p = MiningParams(1, gamma, 3)

        def pivots(rows, p=p):
            return {tuple(r["seq"]) for r in op.mine_levels(rows, p).where("length > 1").collect() if 6 <= max(r["seq"]) <= 8}

        assert pivots(op.rewrite(raw, parts, p).select("sid", "pos", "item")) == pivots(raw.where("item <= 8"))


def test_rows_without_a_sequence_are_dropped(spark):
    from seqmine.sources import from_table, timed_positions

    rows = spark.createDataFrame([(1, 5, "a"), (None, 6, "b"), (1, 7, None), (1, None, "c")], "sid long, t long, item string")
    assert sorted((r["sid"], r["pos"], r["item"]) for r in from_table(rows, "sid", "item", ["t"]).collect()) == [(1, 0, "c"), (1, 1, "a")]
    assert [tuple(r) for r in timed_positions(rows, "sid", F.col("t"), "item", []).collect()] == [(1, 0, "a")]


def test_dictionary_orders_ties_over_many_tasks(spark):
    words = [f"w{i % 700:03d}" for i in range(2000)]
    rows = spark.createDataFrame([(i, [w, w] if i < 300 else [w]) for i, w in enumerate(words)], "sid long, items array<string>").repartition(5)
    got = [(r["item"], r["id"]) for r in op.dictionary(rows).orderBy("id").collect()]
    counts = {}
    for i, w in enumerate(words):
        counts[w] = counts.get(w, 0) + (2 if i < 300 else 1)
    assert got == [(w, k) for k, w in enumerate(sorted(counts, key=lambda w: (-counts[w], w)), 1)]


def test_posting_rows(spark):
    rows = spark.createDataFrame([(1, "a b a b".split()), (2, "a x b".split()), (3, ["b"])], "sid long, items array<string>")
    got = {(tuple(r["seq"]), r["support"], r["sid"], tuple(r["starts"])) for r in op.two_sequence_postings(op.positions(rows), MiningParams(2, 1, 2)).collect()}
    assert got == {(("a", "b"), 2, 1, (0, 2)), (("a", "b"), 2, 2, (0,))}


def test_own_sink_and_dropped_tables(spark, tmp_path):
    from seqmine.operators.tables import own_dir

    rows = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b"])], "sid long, items array<string>")
    place = str(tmp_path)

    def write(items, support):
        with open(f"{place}/{'-'.join(items)}", "w") as f:
            f.write(str(support))

    op.each_pattern(op.mine(op.positions(rows), MiningParams(2, 0, 2)), write)
    assert (tmp_path / "a-b").read_text() == "2"
    kept = op.table(rows, "kept")
    assert kept.count() == 2 and own_dir(spark) in kept.inputFiles()[0]


def test_large_gaps_are_two_rows(spark):
    """Times in seconds with a gap of a day: the plan has no row for each second."""
    rows = spark.createDataFrame([(s, s * 7 + k * 80_000, x) for s in range(4) for k, x in enumerate("abc")], "sid long, pos long, item string")
    got = {" ".join(r["seq"]): r["support"] for r in op.mine(rows, MiningParams(4, 86_399, 3)).collect()}
    assert got == {"a b": 4, "b c": 4, "a b c": 4}
