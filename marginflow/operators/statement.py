"""The ordered statement: measure rows and total rows of the three levels.

All of it comes from the sums of one pass over the source rows, in two aggregations:

* the *heads*: one row per row of the report, with its label, its place and its sum over
  all cells. There are as many as a report has measures, so the ranking window is small.
* the *cells*: the amounts per cell. Each finds its head by an equi-join.

Both use the same sums; Spark runs that stage once and reads its shuffle output twice.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginflow import catalog
from marginflow.functions import (
    MONEY,
    level_number,
    row_label,
    row_slot,
    simple_norm,
    strip_space,
)
from marginflow.operators.cascade import margin_columns, step_sums, with_step
from marginflow.operators.cells import AXES, SCOPE, in_report, measure_sums, spread, sum_where
from marginflow.operators.periods import with_scope

ROW_KEYS = ("level", "is_total", "name")


def _row_sums(
    df: DataFrame,
    scope: Sequence[str],
    levels: Sequence[str],
    excluded: Iterable[str],
    axes: Sequence[str] = AXES,
    profile: str = "current",
) -> DataFrame:
    """Amount per scope, level, position, measure and cell, with the names matched.

    `shown` is the amount if the statement lists the row, else NULL.
    """
    sums = with_step(measure_sums(df, scope, keep=("level", "pos"), axes=axes), profile)
    listed = F.col("level").isin(*levels) & ~F.col("name").isin(*excluded)
    return sums.withColumns(
        {
            "label": F.coalesce(strip_space(F.col("measure")), F.lit("None")),
            "name": F.coalesce(simple_norm(F.col("measure")), F.lit("none")),
            "pos_num": F.col("pos").try_cast("double"),
        }
    ).withColumn("shown", F.when(listed, F.col("amount")))


def _level_sums(levels: Sequence[str]) -> list[Column]:
    """Raw sum of each level's listed rows; NULL if it has none."""
    return [
        sum_where("shown", "level", level).cast(MONEY).alias(f"raw_{level}") for level in levels
    ]


def _level_flags(levels: Sequence[str]) -> list[Column]:
    return [F.max(F.col("level") == level).alias(f"present_{level}") for level in levels]


def _entry(level: Column, is_total: bool, name: Column, **fields: Column) -> Column:
    return F.struct(
        level.alias("level"),
        F.lit(is_total).alias("is_total"),
        name.alias("name"),
        *[column.alias(key) for key, column in fields.items()],
    )


def _heads(
    sums: DataFrame,
    scope: Sequence[str],
    levels: Sequence[str],
    cascade: bool,
    added_e2: bool = False,
) -> DataFrame:
    """One row per statement row: label, position and sum over all cells.

    With `cascade`, totals are the cascade's where the scope has one; with `added_e2` there is
    an E2 total even where no row is on E2. Without, totals are the raw level sums.
    """
    # Cells are summed up by plain hash aggregation before the smallest label is taken, as
    # a minimum of text would make Spark sort its whole input.
    per_label = sums.groupBy(*scope, "level", "name", "label", "pos_num", "step").agg(
        F.sum("shown").alias("shown"), F.sum("amount").alias("amount")
    )
    row = [*scope, "level", "name"]
    grouped = per_label.groupingSets([row, [*scope]], *row).agg(
        F.sum("shown").cast(MONEY).alias("shown_sum"),
        F.min("label").alias("label"),
        F.min("pos_num").alias("pos_num"),
        *step_sums(),
        *_level_sums(levels),
        *_level_flags(catalog.LEVELS),
        F.grouping("name").alias("_all_rows"),
    )
    known = F.col("known") > 0 if cascade else F.lit(False)
    margins = dict(zip(catalog.LEVELS, margin_columns()))
    measure_row = _entry(
        F.col("level"),
        False,
        F.col("name"),
        label=F.col("label"),
        pos_num=F.col("pos_num"),
        grand=F.col("shown_sum"),
        cascade=F.lit(False),
        all_cells=F.lit(False),
    )
    lone_e2 = F.lit(False)
    if added_e2:
        any_level = F.greatest(*[F.col(f"present_{level}") for level in catalog.LEVELS])
        lone_e2 = known & any_level & ~F.col("present_E2")
    totals = []
    for level in levels:
        raw = F.col(f"raw_{level}")
        wanted = raw.isNotNull() | lone_e2 if level == "E2" else raw.isNotNull()
        entry = _entry(
            F.lit(level),
            True,
            F.lit(""),
            label=F.lit(f"{level} {catalog.TOTAL_SUFFIX}"),
            pos_num=F.lit(None).cast("double"),
            grand=F.when(known, margins[level]).otherwise(raw) if level in margins else raw,
            cascade=known,
            all_cells=lone_e2,
        )
        totals.append(F.when(wanted, entry))
    return grouped.select(
        *scope,
        F.inline(
            F.when(
                F.col("_all_rows") == 0,
                F.when(F.col("shown_sum").isNotNull(), F.array(measure_row)),
            ).otherwise(F.array_compact(F.array(*totals)))
        ),
    )


def _cells(sums: DataFrame, scope: Sequence[str], levels: Sequence[str]) -> DataFrame:
    """Amounts per cell for measure rows and for the total row of each level.

    Total rows come for every cell that any row shows (`listed`) or the cascade has.
    """
    rows = sums.groupBy(*scope, "level", "name", *AXES).agg(
        F.sum("shown").cast(MONEY).alias("raw")
    )
    # The level is never NULL here, but the join on it must not ask that of the source rows:
    # the totals need rows without a level, and all parts are to share one scan.
    measure_rows = rows.filter("raw IS NOT NULL").withColumns(
        {
            "level": F.coalesce(F.col("level"), F.lit("")),
            "is_total": F.lit(False),
            "margin": F.lit(None).cast(MONEY),
            "listed": F.lit(True),
        }
    )
    cells = sums.groupBy(*scope, *AXES).agg(
        *step_sums(), *_level_sums(levels), (F.count("shown") > 0).alias("listed")
    )
    margins = dict(zip(catalog.LEVELS, margin_columns()))
    totals = [
        _entry(
            F.lit(level),
            True,
            F.lit(""),
            raw=F.col(f"raw_{level}"),
            margin=margins.get(level, F.col(f"raw_{level}")),
            listed=F.col("listed"),
        )
        for level in levels
    ]
    total_rows = cells.filter("listed OR known > 0").select(
        *scope, *AXES, F.inline(F.array(*totals))
    )
    return measure_rows.unionByName(total_rows)


def _assemble(
    heads: DataFrame,
    cells: DataFrame,
    scope: Sequence[str],
    order: Sequence[Column],
    ranked_in: Sequence[str],
) -> DataFrame:
    """Rank the heads, give every cell its head, and add the sum column.

    A cell that no row shows is no column of the statement, unless an added E2 total brings
    all cells of the cascade with it.
    """
    rank = F.row_number().over(Window.partitionBy(*ranked_in).orderBy(*order))
    ranked = heads.withColumn("row_rank", rank)
    value = F.when(F.col("cascade"), F.col("margin")).otherwise(F.col("raw"))
    columns = [*scope, "level", "label", "row_label", "row_rank", "is_total"]
    body = (
        cells.join(ranked, [*scope, *ROW_KEYS])
        .filter(F.col("listed") | F.col("all_cells"))
        .select(*columns, *AXES, value.alias("value"))
        .filter("value IS NOT NULL")
    )
    grand = ranked.select(
        *columns,
        F.lit(catalog.SUM_LINE).alias(AXES[0]),
        F.lit(catalog.SUM_CATEGORY).alias(AXES[1]),
        F.col("grand").alias("value"),
    )
    return body.unionByName(grand)


def row_heads(
    df: DataFrame,
    scope: Sequence[str] = ("store",),
    levels: Sequence[str] = catalog.LEVELS,
    excluded: Iterable[str] = catalog.EXCLUDED,
) -> DataFrame:
    """Row heads of each level: one per plain measure name, with its lowest position."""
    sums = _row_sums(df, scope, levels, excluded, axes=())
    return (
        sums.groupBy(*scope, "level", "name")
        .agg(
            F.min("label").alias("label"),
            F.min("pos_num").alias("pos_num"),
            F.count("shown").alias("shown"),
        )
        .filter("shown > 0")
        .drop("shown")
    )


def row_head_order(
    df: DataFrame,
    scope: Sequence[str] = ("store",),
    levels: Sequence[str] = catalog.LEVELS,
    excluded: Iterable[str] = catalog.EXCLUDED,
) -> DataFrame:
    """Row heads with their place: by number of the position, unreadable ones last."""
    by_level = Window.partitionBy(*scope, "level")
    rank = F.row_number().over(by_level.orderBy(F.asc_nulls_last("pos_num"), "label", "name"))
    return row_heads(df, scope, levels, excluded).withColumn("row_rank", rank)


def level_measure_cells(
    df: DataFrame,
    scope: Sequence[str] = SCOPE,
    levels: Sequence[str] = catalog.LEVELS,
    excluded: Iterable[str] = catalog.EXCLUDED,
) -> DataFrame:
    """Sum per level, plain measure name and cell."""
    sums = _row_sums(df, scope, levels, excluded)
    cells = sums.groupBy(*scope, "level", "name", *AXES).agg(
        F.sum("shown").cast(MONEY).alias("value")
    )
    return cells.filter("value IS NOT NULL")


def level_raw_total(
    df: DataFrame,
    scope: Sequence[str] = SCOPE,
    levels: Sequence[str] = catalog.LEVELS,
    excluded: Iterable[str] = catalog.EXCLUDED,
) -> DataFrame:
    """Sum of all listed measures per level and cell, signs as stored."""
    sums = _row_sums(df, scope, levels, excluded)
    cells = sums.groupBy(*scope, "level", *AXES).agg(F.sum("shown").cast(MONEY).alias("value"))
    return cells.filter("value IS NOT NULL")


def level_table(
    df: DataFrame,
    scope: Sequence[str] = SCOPE,
    levels: Sequence[str] = catalog.LEVELS,
    excluded: Iterable[str] = catalog.EXCLUDED,
) -> DataFrame:
    """Each level's own table: measure rows by position, then the raw level total."""
    sums = _row_sums(df, scope, levels, excluded)
    heads = _heads(sums, scope, levels, cascade=False).withColumn("row_label", F.col("label"))
    order = [F.col("is_total"), F.asc_nulls_last("pos_num"), F.col("label"), F.col("name")]
    return _assemble(heads, _cells(sums, scope, levels), scope, order, [*scope, "level"])


def _ordered_heads(
    sums: DataFrame, scope: Sequence[str], profile: str
) -> tuple[DataFrame, list[Column]]:
    """Heads of the statement and the order they stand in.

    The legacy rule adds no E2 total and leaves the rows of a level by position, as in the
    level's own table; the others give known rows their slots.
    """
    label = row_label(F.col("level"), F.col("label"))
    legacy = profile == "legacy"
    heads = _heads(sums, scope, catalog.LEVELS, cascade=True, added_e2=not legacy).withColumn(
        "row_label", label
    )
    heads = heads.withColumns(
        {
            "level_number": level_number(F.col("level")),
            "slot": row_slot(F.col("row_label"), F.col("is_total")),
        }
    )
    if legacy:
        by_position = [F.asc_nulls_last("pos_num"), F.col("label"), F.col("name")]
        return heads, [F.col("level_number"), F.col("is_total"), *by_position]
    return heads, [F.col(c) for c in ("level_number", "slot", "row_label", "name")]


def _excluded(profile: str, excluded: Iterable[str] | None) -> Iterable[str]:
    if excluded is not None:
        return excluded
    return catalog.EXCLUDED_OLD if profile == "legacy" else catalog.EXCLUDED


def margin_statement(
    df: DataFrame,
    scope: Sequence[str] = SCOPE,
    profile: str = "current",
    excluded: Iterable[str] | None = None,
) -> DataFrame:
    """The statement: levels below each other, totals from the cascade, rows ranked.

    Without `excluded`, the measures left out are those of the profile.

    `row_rank` is the place of a row in its scope. Measure rows keep their signs; totals
    run through the levels. Only cells with a value are listed; see `statement_wide`.
    """
    sums = _row_sums(df, scope, catalog.LEVELS, _excluded(profile, excluded), profile=profile)
    heads, order = _ordered_heads(sums, scope, profile)
    return _assemble(heads, _cells(sums, scope, catalog.LEVELS), scope, order, scope)


def statement_order(
    df: DataFrame,
    scope: Sequence[str] = SCOPE,
    profile: str = "current",
    excluded: Iterable[str] | None = None,
) -> DataFrame:
    """The rows of the statement in order, without their cells."""
    sums = _row_sums(df, scope, catalog.LEVELS, _excluded(profile, excluded), profile=profile)
    heads, order = _ordered_heads(sums, scope, profile)
    rank = F.row_number().over(Window.partitionBy(*scope).orderBy(*order))
    return heads.withColumn("row_rank", rank).select(
        *scope, "level_number", "slot", "row_label", "row_rank", "is_total"
    )


def statement_totals(
    df: DataFrame, scope: Sequence[str] = SCOPE, profile: str = "current"
) -> DataFrame:
    """Only the total rows of the statement."""
    return margin_statement(df, scope, profile).filter("is_total")


def statement_wide(
    statement: DataFrame,
    scope: Sequence[str] = SCOPE,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """The statement as shown: cells as columns, 0 where a row has none, sum column last."""
    return spread(statement, [*scope, "row_rank", "row_label", "is_total"], columns)


def present_levels(df: DataFrame, scope: Sequence[str] = ("store",)) -> DataFrame:
    """Which of the levels occur in a scope, in order."""
    rows = in_report(with_scope(df, scope), scope)
    flags = rows.groupBy(*scope).agg(*_level_flags(catalog.LEVELS))
    names = [F.when(F.col(f"present_{level}"), level) for level in catalog.LEVELS]
    return flags.select(*scope, F.concat_ws(", ", *names).alias("levels"))
