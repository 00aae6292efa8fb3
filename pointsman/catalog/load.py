"""Import of every query module, so that the registry is filled."""

from pointsman.catalog import inferring, learning, quality, semantic, tabular  # noqa: F401
from pointsman.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
