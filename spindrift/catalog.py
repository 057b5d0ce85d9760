"""Every query of the library by name, with its SQL twin where there is one."""

from __future__ import annotations

from .plans import auditing, axis_queries, catalogs, comparison, experiment_queries, lint_queries, nested_queries, outcome_queries, paired_tests, record_queries, recorded, searches, searching, simulation, statistics, streamed  # noqa: F401
from .plans.registry import ORACLE_SQL, QUERIES

FLAGSHIP = "df2_server_diff"
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
