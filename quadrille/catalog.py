"""Registry of named queries and the SQL that must give the same rows."""

from .plans import kernel_queries  # noqa: F401  registers its queries
from .plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
