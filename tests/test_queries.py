"""Every ledger query against its SQL twin."""

import decimal
import os

import duckdb
import pytest

from ledgerloom.plans.oracles import ORACLES
from ledgerloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain(v):
    return f"{float(v):.9g}" if isinstance(v, float | decimal.Decimal) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_twin(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    out = duck.execute(ORACLES[name])
    names = [c[0] for c in out.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in out.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_twin_runs(spark, name):
    assert QUERIES[name](spark, SF).columns


def test_entry_imports_without_the_training_data_folder(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLES) <= set(__spark_entry__.oracle_sql())
