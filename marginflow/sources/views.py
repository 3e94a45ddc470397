"""Named views over published tables, in the catalog, so that every session reads them by name.

A view is SQL text and keeps no rows: it always shows the table as it is. Both give the rows of
the operators in `operators/totals.py`. With a catalog that outlives the application, such as a
Hive metastore, so do the views.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from marginflow import catalog
from marginflow.functions import AMOUNT, MONEY, quoted
from marginflow.functions.money import LIMIT
from marginflow.sources.schema import MEASURES, MEASURES_BY_CAMPAIGN, TOTAL_COLUMNS

WITH_TOTALS = "measures_with_totals"
PLUS_TOTALS = "measures_plus_totals"
GROUP = ("store", "product_category", "product_line", "campaign")


def _names(columns: Iterable[str], of: str = "") -> str:
    return ", ".join(f"{of}{c}" for c in columns)


def _amount() -> str:
    """`coerce_value` of the column value."""
    number = "try_cast(value AS double)"
    message = "concat('amount out of range: ', value)"
    return (
        f"coalesce(try_cast(value AS {AMOUNT}), CASE WHEN NOT isnan({number}) AND"
        f" abs({number}) >= {LIMIT!r}D THEN CAST(raise_error({message}) AS {AMOUNT}) END)"
    )


def with_totals_sql(table: str) -> str:
    """Each distinct row of a measure table with the totals of its store and month."""
    sums = ", ".join(
        f"CAST(sum(CASE WHEN level = {quoted(level)} THEN amount ELSE 0 END) AS {MONEY}) AS {name}"
        for level, name in zip(catalog.LEVELS, TOTAL_COLUMNS)
    )
    return f"""
WITH base AS (
  SELECT DISTINCT {_names(MEASURES.names)} FROM {table}
  WHERE store IS NOT NULL AND month IS NOT NULL
), per_level AS (
  SELECT store, month, level, sum({_amount()}) AS amount FROM base GROUP BY store, month, level
), totals AS (
  SELECT store, month, {sums}, CAST(sum(amount) AS {MONEY}) AS {TOTAL_COLUMNS[3]}
  FROM per_level GROUP BY store, month
)
SELECT /*+ SHUFFLE_HASH(t) */ {_names(MEASURES.names, "b.")}, {_names(TOTAL_COLUMNS, "t.")}
FROM base b JOIN totals t ON b.store = t.store AND b.month = t.month"""


def plus_totals_sql(table: str) -> str:
    """The known rows of a table by campaign, and the three margins of each group as rows."""
    codes = ", ".join(quoted(code) for code in catalog.LEVEL_CODES)
    name = "lower(trim(CAST(measure AS string)))"
    sums = ", ".join(
        f"CAST(sum(CASE WHEN {name} IN ({', '.join(map(quoted, names))}) THEN amount ELSE 0 END)"
        f" AS {MONEY}) AS {family}"
        for family, names in catalog.CAMPAIGN_FAMILIES.items()
    )
    made = ("store", "product_category", "product_line", "campaign", "db_level", "measure", "value")
    rows = " UNION ALL ".join(
        f"SELECT {_names(GROUP)}, {quoted(code)} AS db_level,"
        f" {quoted(f'{level} {catalog.TOTAL_SUFFIX}')} AS measure,"
        f" CAST(CAST({margin} AS decimal(18,2)) AS string) AS value FROM margins"
        for (code, level), margin in zip(catalog.LEVEL_CODES.items(), ("e1", "e2", "e3"))
    )
    columns = MEASURES_BY_CAMPAIGN.names
    lacking = ", ".join(c if c in made else f"CAST(NULL AS string) AS {c}" for c in columns)
    return f"""
WITH base AS (
  SELECT {_names(columns)} FROM {table} WHERE trim(CAST(db_level AS string)) IN ({codes})
), per_name AS (
  SELECT {_names(GROUP)}, measure, sum({_amount()}) AS amount FROM base
  GROUP BY {_names(GROUP)}, measure
), families AS (
  SELECT {_names(GROUP)}, {sums} FROM per_name GROUP BY {_names(GROUP)}
), margins AS (
  SELECT {_names(GROUP)}, revenue + transfer AS e1, revenue + transfer - db2_cost AS e2,
         revenue + transfer - db2_cost - db3_cost AS e3 FROM families
), totals AS ({rows})
SELECT {_names(columns)} FROM base UNION ALL SELECT {lacking} FROM totals"""


def publish_view_of(spark: SparkSession, name: str, sql: str) -> DataFrame:
    """A catalog view, made or replaced in one step, as any session reads it by name."""
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS {sql}")
    return spark.table(name)


def publish_views(
    spark: SparkSession,
    measures: str | None = None,
    by_campaign: str | None = None,
    with_totals: str = WITH_TOTALS,
    plus_totals: str = PLUS_TOTALS,
) -> None:
    """The views over the catalog tables `measures` and `by_campaign`, each if it is given."""
    if measures:
        publish_view_of(spark, with_totals, with_totals_sql(measures))
    if by_campaign:
        publish_view_of(spark, plus_totals, plus_totals_sql(by_campaign))
