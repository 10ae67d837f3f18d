"""Every query with an oracle against DuckDB; every other query for rows."""

import pytest
from compare import connect, difference

from clickgrain.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


#: 144 fits take minutes: ``python tests/compare.py 0.01 rc11`` has them; test_full_search.py runs smaller grids.
LONG = {"rc11_grid_search"}


@pytest.mark.parametrize("name", sorted(set(ORACLES) - LONG))
def test_equals_oracle(spark, sf_dir, con, name):
    assert difference(QUERIES[name](spark, sf_dir), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_has_the_feature_columns(spark):
    import __spark_entry__ as entry
    from clickgrain.plans.features import FEATURE_COLUMNS

    assert entry.entry(spark).columns == FEATURE_COLUMNS
    assert set(entry.oracle_sql()) <= set(entry.queries())
