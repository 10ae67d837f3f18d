"""Every operator as a query over the test tables, with the SQL it is checked against."""

from clickgrain.catalog.base import ORACLES, QUERIES
from clickgrain.catalog import (  # noqa: F401
    checks,
    cleaning,
    features,
    learning,
    sources,
    store,
    visits,
)
from clickgrain.catalog import spread  # noqa: F401,I001  after those whose SQL it takes

__all__ = ["ORACLES", "QUERIES"]
