"""What a table holds: measures, legend texts, counts."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginflow import catalog
from marginflow.functions import strip_space
from marginflow.operators.cells import SCOPE, in_report
from marginflow.operators.periods import with_scope


def measure_catalog(df: DataFrame) -> DataFrame:
    """Distinct pairs of level and measure."""
    return df.select("level", "measure").distinct()


def row_count(df: DataFrame) -> DataFrame:
    """Number of rows."""
    return df.agg(F.count("*").alias("rows_total"))


def measure_legend(
    df: DataFrame, scope: Sequence[str] = SCOPE, excluded: Iterable[str] = ()
) -> DataFrame:
    """Measures of a scope with their description, in the order the sorted rows show them.

    Rows sort by month, level, position and measure, as far as the table has these columns.

    Source rows are first reduced to distinct sort positions by hash aggregation. The
    descriptions are a fixed list of ten, matched by expression.
    """
    timed = in_report(with_scope(df, scope), scope).filter(F.col("measure").isNotNull())
    places = [c for c in ("month", "level", "pos", "measure") if c in timed.columns]
    order = [
        F.struct(F.col(c).isNull().alias("missing"), F.col(c).alias("key")).alias(c)
        for c in places
    ]
    positions = timed.select(
        *dict.fromkeys([*scope, *places])
    ).distinct()
    name = strip_space(F.col("measure"))
    first = (
        positions.withColumn("name", name)
        .filter(~F.lower("name").isin(*excluded) if excluded else F.lit(True))
        .groupBy(*scope, "name")
        .agg(F.min(F.struct(*order)).alias("first"))
    )
    text = None
    for measure, description in catalog.DESCRIPTIONS.items():
        test = F.col("name") == measure
        text = F.when(test, description) if text is None else text.when(test, description)
    rank = F.row_number().over(Window.partitionBy(*scope).orderBy("first"))
    return first.select(
        *scope,
        F.col("name").alias("measure"),
        text.otherwise(catalog.NO_DESCRIPTION).alias("description"),
        rank.alias("row_rank"),
    )
