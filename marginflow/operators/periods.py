"""Periods: year, quarter and month of a measure row."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from marginflow.functions import as_month, period_title, quarter_label, year_of
from marginflow.plans.joins import join_small


def add_time_columns(df: DataFrame, strict: bool = True) -> DataFrame:
    """Month as DATE, plus year and quarter label; a missing month has neither."""
    if not isinstance(df.schema["month"].dataType, DateType):
        df = df.withColumn("month", as_month(F.col("month"), strict))
    return df.withColumns(
        {"year": year_of(F.col("month")), "quarter": quarter_label(F.col("month"))}
    )


def with_scope(df: DataFrame, scope: Sequence[str]) -> DataFrame:
    """`df` with the period columns the scope asks for."""
    return df if set(scope) <= set(df.columns) else add_time_columns(df)


def filter_period(
    df: DataFrame,
    year: int | None = None,
    quarter: str | None = None,
    month: dt.date | None = None,
) -> DataFrame:
    """Rows of one year, quarter or month; None keeps all.

    A year is asked for as a date range, which the file scan can use; `year(month) = y`
    could not skip files.
    """
    column = F.col("month")
    if year is not None:
        first, last = 1, 12
        if quarter is not None:
            first = 3 * int(quarter.removeprefix("Q")) - 2
            last = first + 2
        start = dt.date(year, first, 1)
        end = dt.date(year + last // 12, last % 12 + 1, 1)
        df = df.filter((column >= F.lit(start)) & (column < F.lit(end)))
    elif quarter is not None:
        df = df.filter(quarter_label(column) == quarter)
    if month is not None:
        df = df.filter(column == F.lit(month))
    return df


def period_options(df: DataFrame) -> DataFrame:
    """The periods each store has: newest year first, months in date order.

    The windows run over distinct months of a store, not over its rows.
    """
    months = add_time_columns(df.select("store", "month").distinct())
    by_store = Window.partitionBy("store")
    return months.withColumns(
        {
            "year_rank": F.dense_rank().over(by_store.orderBy(F.desc_nulls_last("year"))),
            "month_rank": F.dense_rank().over(by_store.orderBy(F.asc_nulls_last("month"))),
        }
    )


def latest_year(df: DataFrame) -> DataFrame:
    """Newest year of each store, the period shown first."""
    newest = df.select("store", "month").groupBy("store").agg(F.max("month").alias("month"))
    return newest.select("store", year_of(as_month(F.col("month"))).alias("year"))


def at_latest_year(df: DataFrame) -> DataFrame:
    """Rows of each store's newest year."""
    timed = df if "year" in df.columns else add_time_columns(df)
    # One year per store, so the stores alone tell how many rows there are.
    return join_small(
        timed, latest_year(df), ["store", "year"], "left_semi", keys=df.select("store")
    )


def period_titles(df: DataFrame) -> DataFrame:
    """Every year, quarter and month of a store as a period with its grain and title."""
    months = add_time_columns(df.select("store", "month").distinct())
    no_text, no_date = F.lit(None).cast("string"), F.lit(None).cast("date")
    grains = F.array(
        F.struct(F.lit("year").alias("grain"), no_text.alias("quarter"), no_date.alias("month")),
        F.struct(F.lit("quarter").alias("grain"), F.col("quarter"), no_date.alias("month")),
        F.struct(F.lit("month").alias("grain"), F.col("quarter"), F.col("month")),
    )
    return (
        months.filter(F.col("month").isNotNull())
        .select("store", "year", F.inline(grains))
        .distinct()
        .withColumn(
            "title",
            period_title(
                F.col("year"),
                F.when(F.col("grain") != "year", F.col("quarter")),
                F.when(F.col("grain") == "month", F.col("month")),
            ),
        )
    )
