"""Multi-level contribution-margin statements as Spark DataFrame operators."""

from marginflow import catalog
from marginflow.functions import (
    coerce_or_zero,
    coerce_value,
    decimal_round,
    format_eur,
    level_code,
    normalize_measure,
    simple_norm,
)
from marginflow.plans.report import store_report
from marginflow.sources import (
    adapt_columns,
    adapt_levels,
    distinct_stores,
    load_once,
    publish,
    read_measures,
    require_columns,
    scan_store,
)

__all__ = [
    "adapt_columns",
    "adapt_levels",
    "catalog",
    "coerce_or_zero",
    "coerce_value",
    "decimal_round",
    "distinct_stores",
    "format_eur",
    "level_code",
    "load_once",
    "normalize_measure",
    "publish",
    "read_measures",
    "require_columns",
    "scan_store",
    "simple_norm",
    "store_report",
]
