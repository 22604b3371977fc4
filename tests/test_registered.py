"""Every registered query against its SQL, on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, duck, sf_dir, name):
    got, want = compare(spark, duck, sf_dir, queries()[name], oracle_sql()[name])
    assert got == want


def test_entry(spark):
    assert entry(spark).columns == ["signer", "value"]
