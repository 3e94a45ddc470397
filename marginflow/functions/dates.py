"""Month, quarter and year."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_month(month: Column, strict: bool = True) -> Column:
    """Month as DATE. Bad text raises, or becomes NULL if not strict."""
    return F.to_date(month) if strict else F.try_to_date(month.cast("string"))


def year_of(month: Column) -> Column:
    return F.year(month)


def quarter_label(month: Column) -> Column:
    return F.concat(F.lit("Q"), F.quarter(month).cast("string"))


def period_title(year: Column, quarter: Column, month: Column) -> Column:
    """Title of a period: the month, else the quarter, else the whole year."""
    return (
        F.when(month.isNotNull(), month.cast("string"))
        .when(quarter.isNotNull(), F.concat_ws(" ", quarter, year.cast("string")))
        .otherwise(F.concat_ws(" ", F.lit("Gesamtjahr"), year.cast("string")))
    )
