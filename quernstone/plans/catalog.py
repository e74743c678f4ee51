"""Every query of the core with its SQL where SQL can say it."""

from __future__ import annotations

from quernstone.plans import increments, pages, queries, talk  # noqa: F401  pages and talk add their queries to those of ``queries``

QUERIES = {**queries.QUERIES, "p3_found": increments.found}
ORACLES = {**queries.ORACLES, "p3_found": increments.FOUND_SQL}
FLAGSHIP = "hybrid_search"
