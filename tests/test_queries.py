"""Every registered core query against its SQL on the smallest tables."""

import pytest
from oracle import compare, rows_of

from strandweb.plans import general, reference

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = general.QUERIES | reference.QUERIES, general.SQL | reference.SQL
SLOW = {"crawl_bfs_cached", "crawl_bfs_nocache"}  # run by tests/oracle.py; the mini-site covers the loop


@pytest.mark.parametrize("name", sorted(set(SQL) - SLOW))
def test_same_as_sql(spark, name):
    assert compare(spark, QUERIES[name], SQL[name], DATA) == ""


def test_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert rows_of(["b", "a"], [(1.00000001, 2)]) == {(2, 1.0): 1}
