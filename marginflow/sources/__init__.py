"""Reading, checking, adapting and publishing measure tables."""

from marginflow.sources.readers import (
    distinct_stores,
    load_once,
    one_store,
    publish,
    publish_by_month,
    publish_view,
    published_stores,
    read_footers,
    read_jdbc,
    read_measures,
    reload,
    scan_store,
    scan_store_projected,
    shared_folder,
)
from marginflow.sources.schema import (
    MEASURES,
    MEASURES_BY_CAMPAIGN,
    REQUIRED,
    REQUIRED_STRICT,
    STATEMENT_COLUMNS,
    adapt_columns,
    adapt_levels,
    has_levels,
    require_columns,
)

__all__ = [
    "MEASURES",
    "MEASURES_BY_CAMPAIGN",
    "REQUIRED",
    "REQUIRED_STRICT",
    "STATEMENT_COLUMNS",
    "adapt_columns",
    "adapt_levels",
    "distinct_stores",
    "has_levels",
    "load_once",
    "one_store",
    "publish",
    "publish_by_month",
    "publish_view",
    "published_stores",
    "read_footers",
    "read_jdbc",
    "read_measures",
    "reload",
    "require_columns",
    "scan_store",
    "scan_store_projected",
    "shared_folder",
]
