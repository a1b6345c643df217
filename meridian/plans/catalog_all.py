"""All parts of the catalogue."""

from meridian.plans import catalog_fits, catalog_ops, catalog_services  # noqa: F401
from meridian.plans.catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
