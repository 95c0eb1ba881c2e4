"""Each query against its SQL in DuckDB, and a few against rows worked out by hand."""

import pytest

from loomspan import catalog
from tests.conftest import SF, assert_same

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    assert_same(QUERIES[name](spark, SF), duck.execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
