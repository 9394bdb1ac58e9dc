"""Every query with an oracle returns the oracle's rows; every other query returns rows."""

import pytest

import __spark_entry__ as entry
import check

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(folder):
    return check.connect(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, folder, name):
    df = QUERIES[name](spark, folder)
    assert len(set(df.columns)) == len(df.columns)
    rows = [tuple(r) for r in df.collect()]
    if name in ORACLES:
        res = duck.execute(ORACLES[name])
        cols = [d[0] for d in res.description]
        assert not check.compare(rows, df.columns, res.fetchall(), cols)
    else:
        assert rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
