"""Column functions; every one is a built-in Spark expression."""

from marginflow.functions.dates import as_month, period_title, quarter_label, year_of
from marginflow.functions.money import (
    AMOUNT,
    MONEY,
    coerce_or_zero,
    coerce_value,
    decimal_round,
    format_eur,
    is_refused,
    profit_status,
)
from marginflow.functions.text import (
    family_of,
    fill_axis,
    level_code,
    level_number,
    normalize_measure,
    plain_norm,
    quoted,
    row_label,
    row_slot,
    simple_norm,
    strip_space,
)

__all__ = [
    "AMOUNT",
    "MONEY",
    "as_month",
    "coerce_or_zero",
    "coerce_value",
    "decimal_round",
    "family_of",
    "fill_axis",
    "format_eur",
    "is_refused",
    "level_code",
    "level_number",
    "normalize_measure",
    "period_title",
    "plain_norm",
    "profit_status",
    "quarter_label",
    "quoted",
    "row_label",
    "row_slot",
    "simple_norm",
    "strip_space",
    "year_of",
]
