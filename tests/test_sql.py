"""Every registered query against its SQL."""

import pytest
from compare import agree, connect

from annalist.plans import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf_dir, name):
    agree(spark, connect(sf_dir), sf_dir, QUERIES[name], SQL[name])


def test_file_manifest(spark, sf_dir):
    rows = QUERIES["p1_file_manifest"](spark, sf_dir).collect()
    assert len(rows) >= 14 and {r.kind for r in rows} == {"parquet"}
