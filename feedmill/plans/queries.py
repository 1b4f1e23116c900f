"""All queries of the library and their SQL."""

from __future__ import annotations

from feedmill.plans import analytics, answers, collect, curation, desk, filings, guard, identity, intake, leads, listings, prospectus, stories, wording  # noqa: F401  they register their queries
from feedmill.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
