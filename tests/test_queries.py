"""Every query with SQL gives the SQL's rows on the smallest data."""

import oracle
import pytest

from millrace.plans import auctions, flows, generated, records, relational, tpch

CASES = [(s, n) for s in (records, auctions, tpch, relational, flows, generated) for n in s.SQL]


@pytest.fixture(scope="module")
def con():
    return oracle.duck()


@pytest.mark.parametrize("suite,name", CASES, ids=[n for _, n in CASES])
def test_same_rows(spark, con, suite, name):
    got, want = oracle.both(spark, con, suite.QUERIES[name], suite.SQL[name])
    assert got == want


def test_every_query_has_sql():
    for suite in (records, auctions, tpch, relational, flows, generated):
        assert set(suite.QUERIES) == set(suite.SQL)
