"""Every query of the catalog against its SQL, on the smallest tables."""

import pytest

from tests.oracle import expect_equal
from tidebook.plans import catalog

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, name):
    expect_equal(catalog.QUERIES[name](spark, SMALL), catalog.SQL[name], SMALL)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0


def test_flagship(spark):
    assert catalog.flagship(spark, SMALL).count() > 0
