"""All queries of the library's own operators, by name, with the SQL that checks them."""

from __future__ import annotations

from folioscope.plans import checks, details, extracts, flows, graphs, keeping, listings, ranking, reading, routes, stores, structuring, working  # noqa: F401  (each module registers its queries)
from folioscope.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
FLAGSHIP = "hybrid_fusion"
