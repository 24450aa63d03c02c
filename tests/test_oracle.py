"""Every registered query against its SQL on the smallest given tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from epilimnia.catalog import REGISTRY

from .oracle import compare

FOLDER = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(REGISTRY) <= set(queries()) and set(REGISTRY) <= set(oracle_sql())


def test_entry(spark):
    assert entry(spark).columns == ["year", "length", "start", "end", "site_id"]


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query_matches_sql(spark, name):
    assert compare(queries()[name](spark, FOLDER), oracle_sql()[name], FOLDER) == []
