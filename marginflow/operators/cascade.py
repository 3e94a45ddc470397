"""The margin cascade: E1, E2 and E3 per cell and over all cells, and the figures on top."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginflow import catalog
from marginflow.functions import (
    MONEY,
    family_of,
    normalize_measure,
    period_title,
    plain_norm,
    profit_status,
    simple_norm,
)
from marginflow.operators.cells import (
    AXES,
    SCOPE,
    measure_sums,
    money,
    sum_where,
    with_grand_total,
)

MARGINS = ("e1_total", "e2_total", "e3_total")
STEPS = ("e1", "e2", "e3")


def step_names(profile: str) -> dict[str, tuple[str, ...]]:
    """Names whose amounts make up E1, and those deducted at E2 and at E3."""
    rule = catalog.PROFILES[profile]
    deducted = {
        step: tuple(n for family in families for n in catalog.FAMILIES[family])
        for step, families in rule.items()
    }
    return {"e1": catalog.REVENUE + catalog.TRANSFER, **deducted}


def with_step(sums: DataFrame, profile: str) -> DataFrame:
    """Measure sums with the step of the cascade they enter at, NULL if at none."""
    name = normalize_measure(F.col("measure"))
    return sums.withColumn("step", family_of(name, step_names(profile)))


def step_sums() -> list[Column]:
    """Amount per step, and the number of rows that are in any."""
    zero = F.lit(0)
    sums = [F.coalesce(sum_where("amount", "step", s), zero).cast(MONEY) for s in STEPS]
    return [*[c.alias(s) for c, s in zip(sums, STEPS)], F.count("step").alias("known")]


def summed_steps() -> list[Column]:
    """Sums of what `step_sums` gave for smaller groups."""
    sums = [F.sum(s).cast(MONEY).alias(s) for s in STEPS]
    return [*sums, F.sum("known").alias("known")]


def margin_columns() -> list[Column]:
    """E1, E2 and E3 from the steps. Transfer prices are stored negative, so E1 adds them."""
    e1 = F.col("e1")
    e2 = e1 - F.col("e2")
    e3 = e2 - F.col("e3")
    return [e.cast(MONEY).alias(n) for n, e in zip(MARGINS, (e1, e2, e3))]


def _step_cells(df: DataFrame, scope: Sequence[str], profile: str) -> DataFrame:
    """The steps of each cell, next to each other."""
    return with_step(measure_sums(df, scope), profile).groupBy(*scope, *AXES).agg(*step_sums())


def margin_cascade(
    df: DataFrame, scope: Sequence[str] = SCOPE, profile: str = "current"
) -> DataFrame:
    """Margins per scope and cell, with the sum column.

    Measures count by name whatever their level. Cells and scopes without any measure the
    rule knows have no rows.
    """
    cells = with_grand_total(_step_cells(df, scope, profile), scope, summed_steps())
    # Asked of the result and not of the rows: a filter on the name would move below the
    # first aggregation and normalize the name of every source row.
    return cells.filter("known > 0").select(*scope, *AXES, *margin_columns())


def totals_as_rows(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str] = MARGINS
) -> DataFrame:
    """Margin columns as rows of a measure and a value."""
    return df.unpivot(list(keys), list(columns), "measure", "value")


def period_rollup(df: DataFrame, profile: str = "current") -> DataFrame:
    """Margins of every store for every year, quarter and month, each with the sum column.

    Source rows are summed once per month. Quarters are summed from the cells of their months
    and years from those of their quarters, so each step starts from fewer rows, and the sum
    columns come with their step.
    """
    periods = ["store", "year", "quarter", "month"]
    cells = _step_cells(df, periods, profile).filter("known > 0")
    parts = []
    for depth, grain in ((4, "month"), (3, "quarter"), (2, "year")):
        keys = periods[:depth]
        if depth < 4:
            cells = cells.groupBy(*keys, *AXES).agg(*summed_steps())
        parts.append(with_grand_total(cells, keys, summed_steps()).withColumn("grain", F.lit(grain)))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    title = period_title(F.col("year"), F.col("quarter"), F.col("month"))
    return rows.select(
        "store",
        "grain",
        title.alias("period"),
        "year",
        "quarter",
        "month",
        *AXES,
        *margin_columns(),
    )


def _revenue_names(profile: str) -> tuple[tuple[str, ...], object]:
    """Names that count as revenue and how they are matched, which older rules did plainly."""
    if profile == "legacy":
        return catalog.KPI_REVENUE_OLD, simple_norm
    return catalog.KPI_REVENUE, normalize_measure


def revenue_figures(profile: str = "current") -> list[Column]:
    """Revenue and the raw names it was found under, as aggregates of measure sums."""
    names, norm = _revenue_names(profile)
    hit = norm(F.col("measure")).isin(*names)
    labels = F.array_sort(F.collect_set(F.when(hit, F.col("measure"))))
    return [
        money(F.when(hit, F.col("amount"))).alias("total_revenue"),
        F.array_join(labels, ", ").alias("revenue_labels"),
        F.count_if(hit).alias("revenue_hits"),
    ]


def total_revenue(
    df: DataFrame, scope: Sequence[str] = SCOPE, profile: str = "current"
) -> DataFrame:
    """Revenue per scope, the raw names found, and whether any was found.

    Names are collected from distinct names per scope, not from rows.
    """
    sums = measure_sums(df, scope, axes=())
    return (
        sums.groupBy(*scope)
        .agg(*revenue_figures(profile))
        .withColumn("revenue_found", F.col("revenue_hits") > 0)
        .drop("revenue_hits")
    )


def expected_of(profile: str) -> dict:
    """Expected names by level; the legacy rule expects families, the others single measures."""
    return catalog.EXPECTED_OLD if profile == "legacy" else catalog.EXPECTED


def missing_of(profile: str = "current") -> Column:
    """Expected measures whose flag column is not set, as (level, measure) pairs."""
    entries = [
        F.struct(
            F.lit(level).alias("level"),
            F.lit(name).alias("measure"),
            F.coalesce(F.col(f"has_{level}_{i}"), F.lit(False)).alias("present"),
        )
        for level, names in expected_of(profile).items()
        for i, name in enumerate(names)
    ]
    return F.filter(F.array(*entries), lambda e: ~e["present"])


def expected_flags(profile: str = "current") -> list[Column]:
    """One aggregate per expected measure: does any row carry its name?

    Single measures are found by their plain name, families by any normalized name in them.
    """

    def found(names, measure: str) -> Column:
        if profile == "legacy":
            family = catalog.FAMILIES[names[measure]]
            return normalize_measure(F.col("measure")).isin(*family)
        return simple_norm(F.col("measure")) == measure.lower()

    return [
        F.max(found(names, measure)).alias(f"has_{level}_{i}")
        for level, names in expected_of(profile).items()
        for i, measure in enumerate(names)
    ]


def _joined(missing: Column, level: str | None = None) -> Column:
    chosen = missing if level is None else F.filter(missing, lambda e: e["level"] == level)
    return F.array_join(F.transform(chosen, lambda e: e["measure"]), ", ")


def missing_measures(
    df: DataFrame, scope: Sequence[str] = SCOPE, profile: str = "current"
) -> DataFrame:
    """Expected measures a scope lacks, one row per level that lacks any.

    The expected names are tested inside one aggregation per scope, so neither a product of
    scopes and names nor a join is needed. The test ignores the level a row is on.
    """
    flags = measure_sums(df, scope, axes=()).groupBy(*scope).agg(*expected_flags(profile))
    missing = flags.select(*scope, missing_of(profile).alias("missing"))
    levels = F.array(
        *[
            F.struct(
                F.lit(level).alias("level"), _joined(F.col("missing"), level).alias("missing")
            )
            for level in expected_of(profile)
        ]
    )
    return missing.select(*scope, F.inline(levels)).filter("missing <> ''")


def kpi_overview(
    df: DataFrame, scope: Sequence[str] = SCOPE, profile: str = "current"
) -> DataFrame:
    """Head figures of a report: revenue, E3 over all cells, status, missing measures.

    Everything is taken from one aggregation of the sums per measure. Without any known
    measure E3 is 0, which is not profitable.
    """
    sums = with_step(measure_sums(df, scope, axes=()), profile)
    figures = sums.groupBy(*scope).agg(
        *step_sums(),
        *revenue_figures(profile),
        *expected_flags(profile),
    )
    e3 = margin_columns()[2]
    return figures.select(
        *scope,
        "total_revenue",
        "revenue_labels",
        (F.col("revenue_hits") > 0).alias("revenue_found"),
        e3,
        _joined(missing_of(profile)).alias("missing"),
    ).withColumn("status", profit_status(F.col("e3_total")))


def scope_status(
    df: DataFrame, scope: Sequence[str] = SCOPE, profile: str = "current"
) -> DataFrame:
    """Whether each scope is profitable, for scopes with a cascade."""
    sums = with_step(measure_sums(df, scope, axes=()), profile)
    totals = sums.groupBy(*scope).agg(*step_sums()).filter("known > 0")
    return totals.select(*scope, margin_columns()[2]).withColumn(
        "status", profit_status(F.col("e3_total"))
    )


def campaign_family(measure: Column) -> Column:
    """Family of a measure in the campaign totals, matched by its plain name."""
    return family_of(plain_norm(measure), catalog.CAMPAIGN_FAMILIES)
