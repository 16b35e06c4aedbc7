"""The plans over the given star-schema tables, with equivalent SQL."""

from stopwise.driver import feeds, governed, ingest, live, transit  # noqa: F401  (they register their queries)
from stopwise.driver.catalog import QUERIES

__all__ = ["QUERIES"]
