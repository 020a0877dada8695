"""All queries by name, and their SQL."""

from lectern.plans import batches, feeds, pages  # noqa: F401  (they add to the same tables)
from lectern.plans.queries import QUERIES, SQL  # noqa: F401
