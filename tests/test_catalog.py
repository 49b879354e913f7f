"""Every registered query against its SQL, on the smallest tables."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from turnstone.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    message, _ = compare(spark, con, name, SF, entry.queries()[name], entry.oracle_sql().get(name))
    assert message is None, message


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "rank", "chunk_id", "similarity", "text_rank", "rrf_score"]
    assert df.count() > 0
