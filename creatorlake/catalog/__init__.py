"""Named queries over the supplied tables, each with the SQL it must agree with."""

from creatorlake.catalog import captures, cleaning, collection, continued, metrics, relations, scalars, silver, standard, streams, summaries, whole_plans  # noqa: F401
from creatorlake.catalog.registry import ORACLES, QUERIES  # noqa: F401
