"""All registered queries: name -> function of (spark, sf_dir), and name -> SQL."""

from __future__ import annotations

from repselect.plans import queries_alignment, queries_levels, queries_precision, queries_study, queries_tables  # noqa: F401  register their queries
from repselect.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]

FLAGSHIP = "g1_summarize_profiles"
