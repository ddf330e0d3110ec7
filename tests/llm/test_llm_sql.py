"""Queries that SQL can express, against their SQL."""

import pytest
from compare import agree, connect

from annalist.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf_dir, name):
    assert agree(spark, connect(sf_dir), sf_dir, QUERIES[name], SQL[name]) > 0
