"""Named queries over the driver tables, and SQL that gives the same rows."""

from hirameki.plans import round_trips  # noqa: F401 - registers its queries
from hirameki.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
