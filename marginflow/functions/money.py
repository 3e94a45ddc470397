"""Amounts and money text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginflow import catalog

AMOUNT = "decimal(18,4)"  # one source value
MONEY = "decimal(28,4)"  # any sum of source values
LIMIT = 0.999e14  # an amount has 14 digits before the point


def is_refused(value: Column) -> Column:
    """Whether the value reads as a number that is too large for an amount: 1e14 and more."""
    number = value.try_cast("double")
    large = number.isNotNull() & ~F.isnan(number) & (F.abs(number) >= LIMIT)
    return large & value.try_cast(AMOUNT).isNull()


def coerce_value(value: Column) -> Column:
    """Value as exact decimal; text that is no number becomes NULL.

    A number too large for an amount (1e14 and more) fails the query: as NULL or 0 it would
    leave a sum wrong without a word. `set_aside` takes such rows out beforehand and lists them.
    """
    number = value.try_cast("double")
    too_large = number.isNotNull() & ~F.isnan(number) & (F.abs(number) >= LIMIT)
    message = F.concat(F.lit("amount out of range: "), value.cast("string"))
    # Asked only of what is no amount, so ordinary values are read once.
    return F.coalesce(
        value.try_cast(AMOUNT), F.when(too_large, F.raise_error(message).cast(AMOUNT))
    )


def coerce_or_zero(value: Column) -> Column:
    """As `coerce_value`, with 0 instead of NULL."""
    return F.coalesce(coerce_value(value), F.lit(0).cast(AMOUNT))


def decimal_round(value: Column) -> Column:
    """Two decimals, half away from zero."""
    return value.cast("decimal(18,2)")


def format_eur(value: Column, zero_as_dash: bool = False) -> Column:
    """German money text, '-' for a missing value."""
    missing = value.isNull() | F.isnan(value.cast("double"))
    if zero_as_dash:
        missing = missing | (value == 0)
    text = F.translate(F.format_number(value, 2), ",.", ".,")
    return F.when(missing, "-").otherwise(F.concat(text, F.lit(" €")))


def profit_status(e3_total: Column) -> Column:
    """Profitable only above zero; no value at all is not profitable."""
    return F.when(e3_total > 0, catalog.PROFITABLE).otherwise(catalog.NOT_PROFITABLE)
