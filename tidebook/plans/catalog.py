"""All registered queries and their SQL, by name."""

from tidebook.plans import books, comparing, selection, splitting, statistics, streams, trades  # noqa: F401
from tidebook.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
