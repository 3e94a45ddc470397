"""One query per operator, each over the whole derived measure table."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginflow import catalog
from marginflow.functions import (
    MONEY,
    coerce_value,
    decimal_round,
    format_eur,
    level_code,
    normalize_measure,
    period_title,
    quarter_label,
    row_label,
    simple_norm,
    year_of,
)
from marginflow.operators import access, cascade, cells, ordering, periods, quality
from marginflow.operators import statement as st
from marginflow.operators import totals
from marginflow.plans.report import entitled_overview, format_statement, store_with_totals
from marginflow.sources import (
    adapt_columns,
    adapt_levels,
    distinct_stores,
    scan_store,
)
from marginflow.sources import derived

STORE = "NATION_12"  # the store the single-store queries ask for
BY_MONTH = ("store", "month")
# Cells of the wide form: every line with every brand and the general category.
LINES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
CATEGORIES = (catalog.GENERAL, *(f"Brand#{n}" for n in range(1, 26)))
CELL_COLUMNS = tuple(f"{line} | {category}" for line in LINES for category in CATEGORIES)
STATEMENT_COLUMNS = (*CELL_COLUMNS, f"{catalog.GENERAL} | {catalog.GENERAL}")


class Tables:
    """The inputs of the queries for one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, measures: DataFrame | None = None):
        self.spark = spark
        self.sf_dir = sf_dir
        if measures is not None:
            self.measures = measures

    @cached_property
    def measures(self) -> DataFrame:
        return derived.derived_measures(self.spark, self.sf_dir)

    @property
    def by_campaign(self) -> DataFrame:
        return derived.by_campaign(self.measures)

    @property
    def without_e2(self) -> DataFrame:
        """Measures with no E2 rows in one store."""
        return self.measures.filter((F.col("level") != "E2") | (F.col("store") != STORE))

    @property
    def entitlements(self) -> DataFrame:
        return derived.store_entitlements(self.measures)

    @property
    def users(self) -> DataFrame:
        return derived.users(self.spark, self.sf_dir)


QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}


def query(name: str):
    def register(function: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = function
        return function

    return register


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries as functions of session and data folder."""

    def bound(function: Callable[[Tables], DataFrame]):
        return lambda spark, sf_dir: function(Tables(spark, sf_dir))

    return {name: bound(function) for name, function in QUERIES.items()}


# --- scans and schema -----------------------------------------------------------------


@query("scan_store")
def scan_store_query(t: Tables) -> DataFrame:
    return scan_store(t.measures, STORE)


@query("scan_store_projected")
def scan_store_projected_query(t: Tables) -> DataFrame:
    return store_with_totals(t.measures, STORE)


@query("distinct_stores")
def distinct_stores_query(t: Tables) -> DataFrame:
    return distinct_stores(t.measures)


@query("adapt_level_schema")
def adapt_level_schema_query(t: Tables) -> DataFrame:
    table = adapt_levels(adapt_columns(t.by_campaign))
    return table.select(
        "store", "level", "pos", "db_level", "position", "measure", "cost_kind", "campaign", "value"
    )


@query("base_levels")
def base_levels_query(t: Tables) -> DataFrame:
    return totals.base_levels(t.by_campaign)


# --- projections, filters, predicates ---------------------------------------------------


@query("time_columns")
def time_columns_query(t: Tables) -> DataFrame:
    timed = periods.add_time_columns(t.measures)
    return timed.select("store", "month", "year", "quarter", "measure", "value")


@query("filter_period")
def filter_period_query(t: Tables) -> DataFrame:
    return periods.filter_period(t.measures, year=1997, quarter="Q2")


@query("period_options")
def period_options_query(t: Tables) -> DataFrame:
    return periods.period_options(t.measures)


@query("latest_year")
def latest_year_query(t: Tables) -> DataFrame:
    return periods.at_latest_year(t.measures).drop("quarter")


@query("period_title")
def period_title_query(t: Tables) -> DataFrame:
    return periods.period_titles(t.measures)


@query("fill_axes")
def fill_axes_query(t: Tables) -> DataFrame:
    return cells.fill_axes(t.measures)


@query("coerce_value")
def coerce_value_query(t: Tables) -> DataFrame:
    table = t.measures.withColumns(
        {"text": F.col("value"), "amount": coerce_value(F.col("value"))}
    )
    return cells.coerce_values(table)


@query("exclude_measures")
def exclude_measures_query(t: Tables) -> DataFrame:
    return cells.exclude_measures(t.measures)


@query("measure_in_set")
def measure_in_set_query(t: Tables) -> DataFrame:
    return cells.measures_in(t.measures, ["Umsatz EUR", "UmsatzEUR"])


@query("filter_level")
def filter_level_query(t: Tables) -> DataFrame:
    return cells.filter_level(t.measures, "E2")


@query("present_levels")
def present_levels_query(t: Tables) -> DataFrame:
    return st.present_levels(t.measures)


@query("row_labels")
def row_labels_query(t: Tables) -> DataFrame:
    heads = st.statement_order(t.measures)
    return heads.select("store", "year", "row_label", "is_total")


@query("profit_status")
def profit_status_query(t: Tables) -> DataFrame:
    return cascade.scope_status(t.measures, BY_MONTH)


@query("clamp_level")
def clamp_level_query(t: Tables) -> DataFrame:
    return access.effective_levels(t.users)


@query("entitled_grains")
def entitled_grains_query(t: Tables) -> DataFrame:
    return access.entitled_grains(t.measures, t.entitlements)


# --- joins ------------------------------------------------------------------------------


@query("measures_with_totals")
def measures_with_totals_query(t: Tables) -> DataFrame:
    return totals.measures_with_totals(t.measures)


@query("aligned_sum")
def aligned_sum_query(t: Tables) -> DataFrame:
    return cells.aligned_sum(
        t.measures,
        plus=[catalog.REVENUE, catalog.TRANSFER],
        minus=[catalog.MATERIAL_DISCOUNT, catalog.CATEGORY_DISCOUNT],
    )


@query("missing_measures")
def missing_measures_query(t: Tables) -> DataFrame:
    return cascade.missing_measures(t.measures, BY_MONTH)


@query("missing_measures_legacy")
def missing_measures_legacy_query(t: Tables) -> DataFrame:
    return cascade.missing_measures(t.measures, BY_MONTH, "legacy")


@query("entitled_overview")
def entitled_overview_query(t: Tables) -> DataFrame:
    return entitled_overview(t.measures, t.entitlements)


@query("entitled_rows")
def entitled_rows_query(t: Tables) -> DataFrame:
    return access.entitled_rows(t.measures, t.entitlements)


@query("measure_legend")
def measure_legend_query(t: Tables) -> DataFrame:
    return quality.measure_legend(t.measures)


# --- aggregations -------------------------------------------------------------------------


@query("distinct_base")
def distinct_base_query(t: Tables) -> DataFrame:
    return totals.distinct_base(t.measures)


@query("level_totals")
def level_totals_query(t: Tables) -> DataFrame:
    return totals.level_totals(t.measures)


@query("family_sums")
def family_sums_query(t: Tables) -> DataFrame:
    return totals.family_sums(t.by_campaign)


@query("family_margins")
def family_margins_query(t: Tables) -> DataFrame:
    return totals.family_margins(t.by_campaign)


@query("measure_cells")
def measure_cells_query(t: Tables) -> DataFrame:
    return cells.measure_cells(t.measures, catalog.REVENUE)


@query("measure_pivot")
def measure_pivot_query(t: Tables) -> DataFrame:
    return cells.measure_pivot(t.measures, catalog.REVENUE, columns=CELL_COLUMNS)


@query("grand_total_cell")
def grand_total_cell_query(t: Tables) -> DataFrame:
    return cells.measure_cells(t.measures, catalog.COMMISSION, BY_MONTH, grand_total=True)


@query("total_revenue")
def total_revenue_query(t: Tables) -> DataFrame:
    return cascade.total_revenue(t.measures)


@query("total_revenue_legacy")
def total_revenue_legacy_query(t: Tables) -> DataFrame:
    return cascade.total_revenue(t.measures, profile="legacy")


@query("margin_cascade")
def margin_cascade_query(t: Tables) -> DataFrame:
    return cascade.margin_cascade(t.measures)


@query("margin_cascade_legacy")
def margin_cascade_legacy_query(t: Tables) -> DataFrame:
    return cascade.margin_cascade(t.measures, profile="legacy")


@query("margin_cascade_handbook")
def margin_cascade_handbook_query(t: Tables) -> DataFrame:
    return cascade.margin_cascade(t.measures, profile="handbook")


@query("level_measure_cells")
def level_measure_cells_query(t: Tables) -> DataFrame:
    return st.level_measure_cells(t.measures)


@query("level_raw_total")
def level_raw_total_query(t: Tables) -> DataFrame:
    return st.level_raw_total(t.measures)


@query("level_table_single")
def level_table_single_query(t: Tables) -> DataFrame:
    return st.level_table(t.measures, levels=("E3",)).drop("label")


@query("level_table")
def level_table_query(t: Tables) -> DataFrame:
    return st.level_table(t.measures).drop("label")


@query("margin_statement")
def margin_statement_query(t: Tables) -> DataFrame:
    return st.margin_statement(t.measures).drop("label")


@query("margin_statement_legacy")
def margin_statement_legacy_query(t: Tables) -> DataFrame:
    return st.margin_statement(t.measures, profile="legacy").drop("label")


@query("statement_wide")
def statement_wide_query(t: Tables) -> DataFrame:
    return st.statement_wide(st.margin_statement(t.measures), columns=STATEMENT_COLUMNS)


@query("kpi_overview")
def kpi_overview_query(t: Tables) -> DataFrame:
    return cascade.kpi_overview(t.measures)


@query("dedup_row_heads")
def dedup_row_heads_query(t: Tables) -> DataFrame:
    return st.row_heads(t.measures)


@query("measure_catalog")
def measure_catalog_query(t: Tables) -> DataFrame:
    return quality.measure_catalog(t.measures)


@query("row_count")
def row_count_query(t: Tables) -> DataFrame:
    return quality.row_count(t.measures)


@query("period_rollup")
def period_rollup_query(t: Tables) -> DataFrame:
    return cascade.period_rollup(t.measures)


# --- sorts and top rows -------------------------------------------------------------------


@query("sorted_scan")
def sorted_scan_query(t: Tables) -> DataFrame:
    return ordering.sorted_scan(t.measures)


@query("row_head_order")
def row_head_order_query(t: Tables) -> DataFrame:
    return st.row_head_order(t.measures)


@query("statement_order")
def statement_order_query(t: Tables) -> DataFrame:
    return st.statement_order(t.measures)


@query("view_order")
def view_order_query(t: Tables) -> DataFrame:
    return ordering.view_order(totals.measures_with_totals(t.measures))


@query("top_200")
def top_200_query(t: Tables) -> DataFrame:
    return ordering.top_rows(totals.measures_plus_totals(t.by_campaign), 200)


# --- set operations -----------------------------------------------------------------------


@query("measures_plus_totals")
def measures_plus_totals_query(t: Tables) -> DataFrame:
    return totals.measures_plus_totals(t.by_campaign)


@query("totals_as_rows")
def totals_as_rows_query(t: Tables) -> DataFrame:
    return cascade.totals_as_rows(
        totals.family_margins(t.by_campaign), totals.CAMPAIGN_KEYS
    )


@query("synthesized_e2")
def synthesized_e2_query(t: Tables) -> DataFrame:
    totals_of = st.statement_totals(t.without_e2).drop("label", "row_rank")
    return totals_of.filter(F.col("level") == "E2")


@query("override_totals")
def override_totals_query(t: Tables) -> DataFrame:
    return st.statement_totals(t.measures, BY_MONTH, "handbook").drop("label", "row_rank")


# --- scalar functions ----------------------------------------------------------------------


@query("normalize_measure")
def normalize_measure_query(t: Tables) -> DataFrame:
    return t.measures.select(
        "store", "month", "measure", normalize_measure(F.col("measure")).alias("measure_norm")
    )


@query("simple_norm")
def simple_norm_query(t: Tables) -> DataFrame:
    return t.measures.select(
        "store", "month", "measure", simple_norm(F.col("measure")).alias("measure_norm")
    )


def _rounded(t: Tables) -> DataFrame:
    return t.measures.select(
        "store", "month", "measure", decimal_round(coerce_value(F.col("value"))).alias("rounded")
    )


@query("format_eur")
def format_eur_query(t: Tables) -> DataFrame:
    rounded = _rounded(t)
    return rounded.withColumn("text", format_eur(F.col("rounded")))


@query("format_eur_dash_zero")
def format_eur_dash_zero_query(t: Tables) -> DataFrame:
    return _rounded(t).withColumn("text", format_eur(F.col("rounded"), zero_as_dash=True))


@query("statement_text")
def statement_text_query(t: Tables) -> DataFrame:
    statement = st.margin_statement(t.measures, BY_MONTH).withColumn(
        "value", F.col("value").cast("decimal(28,2)")
    )
    return format_statement(statement).select(
        *BY_MONTH, "row_label", "product_line", "product_category", F.col("value").alias("text")
    )


@query("year_quarter")
def year_quarter_query(t: Tables) -> DataFrame:
    return t.measures.select(
        "store",
        "month",
        year_of(F.col("month")).alias("year"),
        quarter_label(F.col("month")).alias("quarter"),
        period_title(
            year_of(F.col("month")), quarter_label(F.col("month")), F.lit(None).cast("date")
        ).alias("title"),
    )


@query("level_code_map")
def level_code_map_query(t: Tables) -> DataFrame:
    return t.by_campaign.select(
        "store", "measure", "db_level", level_code(F.col("db_level")).alias("level")
    )


@query("row_label_text")
def row_label_text_query(t: Tables) -> DataFrame:
    return t.measures.select(
        "store", "month", row_label(F.col("level"), F.col("measure")).alias("row_label")
    )


@query("decimal_round")
def decimal_round_query(t: Tables) -> DataFrame:
    return _rounded(t).withColumn("as_money", F.col("rounded").cast(MONEY))
