"""Named queries and the SQL they must agree with."""

from threadloom.plans import archive, posts, runs, threads  # noqa: F401
from threadloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
