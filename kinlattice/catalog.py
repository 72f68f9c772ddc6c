"""Every registered query with the SQL that states its result."""

from __future__ import annotations

from .plans import evidence, files, records, relational, streams  # noqa: F401 - modules register their queries
from .plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark, sf_dir):
    """The ten nations with most customers that ordered."""
    return relational.top_groups_distinct(spark, sf_dir)
