import pytest

import __spark_entry__ as entry
from vicinage.plans import queries

from .oracle import assert_same, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_agrees_with_its_sql(spark, sf_dir, con, name):
    assert_same(queries.QUERIES[name](spark, sf_dir), queries.ORACLES[name], con)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLES])
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0


def test_flagship(spark):
    assert entry.entry(spark).count() == 8 * spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
    assert set(queries.QUERIES) <= set(entry.queries())
