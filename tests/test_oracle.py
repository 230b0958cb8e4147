"""Every registered query on the smallest data: against DuckDB where it has SQL, else that it runs."""

import pytest

import check
from tidemark.plans import ORACLES, QUERIES

PATH = "/root/testdata/sf0.001"
# Its folders per hour take long to write; the full check covers it.
SLOW = {"dump_requests"}


@pytest.fixture(scope="module")
def oracle():
    return check.oracle_connection(PATH)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, oracle, name):
    df = QUERIES[name](spark, PATH)
    if name in ORACLES:
        assert check.compare(df, oracle.sql(ORACLES[name])) is None
    else:
        assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
