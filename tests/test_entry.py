"""Every registered query runs and gives what its SQL gives, on the smallest tables."""

import os

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
OWN = [n for n in __spark_entry__.QUERIES if n in __spark_entry__.ORACLES]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", OWN)
def test_equals_sql(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, SF)
    want = duck.execute(__spark_entry__.oracle_sql()[name])
    columns = sorted(d[0] for d in want.description)
    assert sorted(got.columns) == columns
    order = [d[0] for d in want.description]
    rows = [tuple(r[order.index(c)] for c in columns) for r in want.fetchall()]
    plain = lambda rs: sorted(repr(tuple(float(v) if isinstance(v, float) else v for v in r)) for r in rs)
    assert plain(tuple(r) for r in got.select(*columns).collect()) == plain(rows)


def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() > 0
