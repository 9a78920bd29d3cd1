"""Every registered query runs, and equals its SQL where there is one."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from scripts.check_queries import compare, connect


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, data, name):
    verdict, _ = compare(spark, con, data, name)
    assert verdict.startswith(("ok", "rows only")), verdict


def test_every_check_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).columns[0] == "domain"
