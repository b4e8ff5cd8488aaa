"""All registered queries of the library itself."""

from . import catalog, catalog_data, catalog_exits, catalog_hand, catalog_more, catalog_passes, catalog_review, catalog_rollout, catalog_rules, catalog_screen, catalog_shape, catalog_stats, catalog_stream, catalog_trajectory  # noqa: F401  (each adds its queries)

QUERIES = catalog.QUERIES
ORACLES = catalog.ORACLES
