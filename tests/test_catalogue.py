import duckdb
import pytest

import __spark_entry__ as entry
from keyloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_against_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    found = duck.execute(catalogue.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr(r) for r in found.fetchall())
    assert sorted(repr(tuple(r[n] for n in names)) for r in df.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_whole_tables(spark, duck):
    """Every event and every order is in the results, whatever its remainder."""
    one = lambda sql: duck.execute(sql).fetchone()[0]
    run = lambda name: catalogue.QUERIES[name](spark, SF)
    pairs = one("SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM events)")
    assert sum(r.n for r in run("scard_all").collect()) == pairs == run("sadd_result_all").count()
    assert run("get_or_add_all").count() == one("SELECT count(*) FROM orders")
    counts = run("try_add_counts_all").first()
    assert counts.n_added + counts.n_existing == one("SELECT count(*) FROM orders")
    assert run("set_value_changed_all").count() == one("SELECT count(DISTINCT o_custkey) FROM orders")
    assert not [n for n in catalogue.ORACLES if n.endswith("_all") and "% 3" in catalogue.ORACLES[n]]
