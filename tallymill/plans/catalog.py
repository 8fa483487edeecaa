"""All named queries of the library."""

from tallymill.plans import boards, exact, figures, gates, packs, pages, records, reports, tournament  # noqa: F401  (they register their queries)
from tallymill.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
