"""Sums per measure and cell, the base of every report.

`measure_sums` is the only pass over source rows. It groups by the raw measure text with
plain hash aggregation, so each task combines its rows before the shuffle, a hot store
arrives at the next stage as distinct cells only, and names are normalized once per cell
and not once per row.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from marginflow import catalog
from marginflow.functions import (
    MONEY,
    coerce_or_zero,
    fill_axis,
    normalize_measure,
    quoted,
    simple_norm,
)
from marginflow.operators.periods import with_scope

SCOPE = ("store", "year")
AXES = ("product_line", "product_category")


def fill_axes(df: DataFrame) -> DataFrame:
    """Rows without line or category get the general one."""
    return df.withColumns({axis: fill_axis(F.col(axis)) for axis in AXES})


def coerce_values(df: DataFrame) -> DataFrame:
    """Value as exact amount, 0 where it is no number."""
    return df.withColumn("value", coerce_or_zero(F.col("value")))


def exclude_measures(df: DataFrame, excluded: Iterable[str] = catalog.EXCLUDED) -> DataFrame:
    """Drop measures that are not money."""
    name = F.coalesce(simple_norm(F.col("measure")), F.lit(""))
    return df.filter(~name.isin(*excluded))


def measures_in(df: DataFrame, names: str | Iterable[str]) -> DataFrame:
    """Rows whose normalized measure is one of `names`, themselves normalized alike."""
    names = [names] if isinstance(names, str) else list(names)
    targets = [normalize_measure(F.lit(n)) for n in names]
    return df.filter(normalize_measure(F.col("measure")).isin(*targets))


def filter_level(df: DataFrame, level: str) -> DataFrame:
    """Rows of one level."""
    return df.filter(F.col("level") == level)


def in_report(df: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Rows whose store and period are known, asked in a form the file scan can use.

    All scope columns are asked for, as a join on them would ask, so that parts of a report
    that are joined and parts that are not have the same scan and can share it.
    """
    columns = list(scope)
    if "month" in df.columns and set(scope) & {"year", "quarter"}:
        columns.append("month")
    for column in dict.fromkeys(columns):
        df = df.filter(F.col(column).isNotNull())
    return df


def sum_where(amount: str, column: str, text: str) -> Column:
    """Sum of the amounts of rows with `column` = `text`.

    A filtered sum leaves the buffers of the sums a row is not part of alone, which for
    wide decimals is several times faster than adding NULL to each.
    """
    return F.expr(f"sum({amount}) FILTER (WHERE {column} = {quoted(text)})")


def money(amount: Column) -> Column:
    """Sum of amounts, 0 if there are none."""
    return F.coalesce(F.sum(amount), F.lit(0)).cast(MONEY)


def measure_sums(
    df: DataFrame,
    scope: Sequence[str] = SCOPE,
    keep: Sequence[str] = (),
    axes: Sequence[str] = AXES,
) -> DataFrame:
    """Amount per scope, kept columns, raw measure text and cell.

    Rows without a store or period are in no report, as a report is of one store and period.
    """
    return (
        in_report(with_scope(df, scope), scope)
        .select(
            *scope,
            *keep,
            "measure",
            *[fill_axis(F.col(axis)).alias(axis) for axis in axes],
            _amount(df).alias("amount"),
        )
        .groupBy(*scope, *keep, "measure", *axes)
        .agg(F.sum("amount").alias("amount"))
    )


def _amount(df: DataFrame) -> Column:
    """Value as exact amount; a decimal column, such as a sum, keeps its precision."""
    value = F.col("value")
    if isinstance(df.schema["value"].dataType, DecimalType):
        return F.coalesce(value, F.lit(0))
    return coerce_or_zero(value)


def summarize(df: DataFrame) -> DataFrame:
    """The measure table with one row per store, month, level, position, measure and cell.

    The result is a measure table again and gives every report that sums values the same
    numbers, so it can be published once and asked many times.
    """
    keys = ["store", "month"]
    sums = measure_sums(df, keys, keep=("level", "pos"))
    return sums.withColumn("value", F.col("amount").cast(MONEY)).drop("amount")


def with_grand_total(
    df: DataFrame, keys: Sequence[str], aggregates: Sequence[Column]
) -> DataFrame:
    """Aggregate per key and cell and, in the same pass, per key over all cells.

    The total over all cells carries the labels of the sum column.
    """
    grouped = df.groupingSets([[*keys, *AXES], [*keys]], *keys, *AXES).agg(
        *aggregates, F.grouping(AXES[0]).alias("_all_cells")
    )
    return label_grand_total(grouped, F.col("_all_cells") == 1).drop("_all_cells")


def label_grand_total(df: DataFrame, is_grand: Column) -> DataFrame:
    """Name the sum column."""
    return df.withColumns(
        {
            "product_line": F.when(is_grand, catalog.SUM_LINE).otherwise(F.col("product_line")),
            "product_category": F.when(is_grand, catalog.SUM_CATEGORY).otherwise(
                F.col("product_category")
            ),
        }
    )


def _by_sign(
    df: DataFrame, sign: Column, scope: Sequence[str], grand_total: bool
) -> DataFrame:
    """Sum of amounts times sign per cell; a NULL sign leaves a measure out.

    Cells without any chosen measure are dropped by their count. A filter on the name would
    move below the first aggregation and normalize the name of every source row.
    """
    name = normalize_measure(F.col("measure"))
    signed = measure_sums(df, scope).withColumn("name", name).withColumn("sign", sign)
    totals = [
        money(F.col("amount") * F.col("sign")).alias("value"),
        F.count("sign").alias("known"),
    ]
    if grand_total:
        cells = with_grand_total(signed, scope, totals)
    else:
        cells = signed.groupBy(*scope, *AXES).agg(*totals)
    return cells.filter("known > 0").drop("known")


def _targets(names: str | Iterable[str]) -> Column:
    names = [names] if isinstance(names, str) else list(names)
    return F.col("name").isin(*[normalize_measure(F.lit(n)) for n in names])


def measure_cells(
    df: DataFrame,
    names: str | Iterable[str],
    scope: Sequence[str] = SCOPE,
    grand_total: bool = False,
) -> DataFrame:
    """Sum of a measure, or of a set of spellings, per cell, if wanted with the sum column."""
    return _by_sign(df, F.when(_targets(names), 1), scope, grand_total)


def cell_label(line: Column, category: Column) -> Column:
    """Name of a cell's column in the wide form.

    A bar inside a name is doubled, so that no two cells share a column.
    """
    return F.concat(
        F.replace(line, F.lit("|"), F.lit("||")),
        F.lit(" | "),
        F.replace(category, F.lit("|"), F.lit("||")),
    )


GRAND_CELL = f"{catalog.SUM_LINE} | {catalog.SUM_CATEGORY}"
OTHER_CELLS = "other cells"


def spread(
    cells: DataFrame,
    rows: Sequence[str],
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Cells as columns, 0 where a row has none, the sum column last.

    Give `columns` to fix the schema; else Spark lists them, up to
    `spark.sql.pivotMaxValues`. With `columns`, the cells that are not listed are added up in
    the column `other cells`, so a row's cells always make up its sum column.
    """
    label = cell_label(*[F.col(a) for a in AXES])
    if columns is not None:
        columns = [*[c for c in columns if c != GRAND_CELL], OTHER_CELLS, GRAND_CELL]
        label = F.when(label.isin(*columns), label).otherwise(OTHER_CELLS)
    named = cells.withColumn("_cell", label)
    wide = named.groupBy(*rows).pivot("_cell", columns).agg(F.sum("value").cast(MONEY))
    names = [c for c in wide.columns if c not in rows]
    names = [c for c in names if c != GRAND_CELL] + [c for c in names if c == GRAND_CELL]
    zero = F.lit(0).cast(MONEY)
    return wide.select(*rows, *[F.coalesce(F.col(f"`{c}`"), zero).alias(c) for c in names])


def measure_pivot(
    df: DataFrame,
    names: str | Iterable[str],
    scope: Sequence[str] = SCOPE,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """One row per scope, one column per cell."""
    return spread(measure_cells(df, names, scope, grand_total=True), scope, columns)


def aligned_sum(
    df: DataFrame,
    plus: Sequence[Iterable[str]],
    minus: Sequence[Iterable[str]] = (),
    scope: Sequence[str] = SCOPE,
) -> DataFrame:
    """Sets of measures added and subtracted cell by cell, a missing cell counting 0.

    One pass: a row's sign follows from the sets its measure is in, so no set is joined to
    another.
    """
    sign = sum((F.when(_targets(s), 1).otherwise(0) for s in plus), F.lit(0))
    sign = sum((F.when(_targets(s), -1).otherwise(0) for s in minus), sign)
    member = _targets([n for s in (*plus, *minus) for n in s])
    return _by_sign(df, F.when(member, sign), scope, grand_total=True)
