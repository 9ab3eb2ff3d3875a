"""All registered queries of the library's own operators, and their DuckDB SQL."""

from __future__ import annotations

from tallyframe.plans import q_checks, q_grouping, q_profile, q_reconcile, q_relate, q_text  # noqa: F401
from tallyframe.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
