import duckdb
import pytest

from seqmine.plans import roundtrips
from seqmine.plans.oracles import ORACLES
from seqmine.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
FAST = ["mine_all_events", "mine_closed_orders", "mine_timed_events", "dictionary_documents", "pivot_partitions", "pivot_rewrite_events", "split_at_gap_segments", "posting_list", "weighted_dedup", *roundtrips.QUERIES]


@pytest.mark.parametrize("name", FAST)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "orders", "documents", "lineitem", "part", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = con.sql(ORACLES[name])
    assert columns == sorted(want.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    assert got == sorted(repr(r) for r in want.select(*columns).fetchall()) and got


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
