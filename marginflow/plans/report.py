"""The whole report of one store and period, as the dashboard shows it."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginflow import catalog
from marginflow.functions import format_eur
from marginflow.operators.access import stores_for
from marginflow.operators.cascade import kpi_overview, margin_cascade, missing_measures
from marginflow.operators.cells import SCOPE
from marginflow.operators.periods import filter_period
from marginflow.operators.quality import measure_legend
from marginflow.operators.refused import set_aside
from marginflow.operators.statement import margin_statement
from marginflow.operators.totals import measures_with_totals
from marginflow.sources.readers import one_store, scan_store_projected
from marginflow.sources.schema import has_levels, require_columns


@dataclass(frozen=True)
class Report:
    """Lazy parts of a report; `statement` is None where the table has no levels.

    `refused` has the rows left out of all other parts, None where such a row fails the report.
    """

    figures: DataFrame
    cascade: DataFrame
    missing: DataFrame
    legend: DataFrame
    statement: DataFrame | None
    refused: DataFrame | None = None


def format_statement(statement: DataFrame, zero_as_dash: bool = False) -> DataFrame:
    """The statement with its values as German money text."""
    return statement.withColumn("value", format_eur(F.col("value"), zero_as_dash))


def store_with_totals(df: DataFrame, store: str) -> DataFrame:
    """One store's rows with the totals of their months, sorted.

    The store is picked first, so neither the totals nor the count of their keys read others.
    """
    mine = one_store(df, store)
    return scan_store_projected(measures_with_totals(mine), store)


def entitled_overview(
    df: DataFrame, entitlements: DataFrame, profile: str = "current"
) -> DataFrame:
    """Head figures of all reports each user level may see, at the finest grain it may ask for."""
    parts = []
    for level, grains in catalog.LEVEL_GRAINS.items():
        scope = [*SCOPE, *[g for g in grains if g not in SCOPE]]
        figures = kpi_overview(stores_for(df, entitlements, level), scope, profile)
        parts.append(figures.withColumn("user_level", F.lit(level)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def store_report(
    df: DataFrame,
    store: str | None = None,
    year: int | None = None,
    quarter: str | None = None,
    month: dt.date | None = None,
    profile: str = "current",
    user_level: int | None = None,
    entitlements: DataFrame | None = None,
    refused: str = "fail",
) -> Report:
    """All parts of the report of a store and period.

    Without a store the parts hold the reports of all stores. The grain is the finest one
    asked for: year, quarter or month. For a `user_level` with its `entitlements` they hold the
    stores it may see only, and a grain finer than its own is refused.

    An amount out of range fails the parts that sum it, or with `refused` "aside" its row is left
    out of them and listed in a part of its own.
    """
    if refused not in ("fail", "aside"):
        raise ValueError("refused is fail or aside")
    grain = "month" if month is not None else "quarter" if quarter is not None else "year"
    rows = require_columns(df)
    if user_level is not None:
        if entitlements is None:
            raise ValueError("a user level needs its entitlements")
        level = min(max(user_level, catalog.USER_LEVELS[0]), catalog.USER_LEVELS[-1])
        if grain not in catalog.LEVEL_GRAINS[level]:
            raise PermissionError(f"user level {level} has no reports by {grain}")
        rows = stores_for(rows, entitlements, level)
    if store is not None:
        rows = one_store(rows, store)
    rows = filter_period(rows, year, quarter, month)
    scope = list(SCOPE)
    if quarter is not None or month is not None:
        scope.append("quarter")
    if month is not None:
        scope.append("month")
    levels = has_levels(df)
    listed = None
    if refused == "aside":
        rows, listed = set_aside(rows)
    return Report(
        figures=kpi_overview(rows, scope, profile),
        cascade=margin_cascade(rows, scope, profile),
        missing=missing_measures(rows, scope, profile),
        legend=measure_legend(rows, scope),
        statement=margin_statement(rows, scope, profile) if levels else None,
        refused=listed,
    )
