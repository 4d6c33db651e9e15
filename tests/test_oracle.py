"""Every registered query that has SQL, against DuckDB on whole tables."""

import pytest

from assay.plans.catalog import ORACLE, QUERIES
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, sf_dir, name):
    compare(spark, con, sf_dir, QUERIES[name], ORACLE[name])


def test_every_query_has_sql():
    assert set(ORACLE) <= set(QUERIES)
