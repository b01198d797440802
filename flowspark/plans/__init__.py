"""Ready queries over the test tables, with their SQL."""

from flowspark.plans import dims, facts, more, motion  # noqa: F401
from flowspark.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
