from collections import defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from marginflow import catalog
from marginflow.operators.cascade import (
    kpi_overview,
    margin_cascade,
    missing_measures,
    period_rollup,
    scope_status,
    total_revenue,
)
from marginflow.operators.cells import (
    GRAND_CELL,
    aligned_sum,
    exclude_measures,
    fill_axes,
    measure_cells,
    measure_pivot,
    measures_in,
    summarize,
)
from marginflow.operators.statement import margin_statement

JAN = "2024-01-01"


def test_null_axes_are_kept(table):
    df = table([("A", JAN, "E1", "1", "UmsatzEUR", None, "L", "1"),
                ("A", JAN, "E1", "1", "UmsatzEUR", "K", None, "2")])
    cells = {(r.product_line, r.product_category): r.value
             for r in measure_cells(df, "Umsatz_EUR").collect()}
    assert cells == {}
    cells = {(r.product_line, r.product_category): r.value
             for r in measure_cells(df, "umsatzeur", grand_total=True).collect()}
    assert cells == {("L", "Allgemein"): 1, ("Allgemein", "K"): 2, ("Summen", "Gesamt"): 3}
    filled = {(r.product_line, r.product_category) for r in fill_axes(df).collect()}
    assert filled == {("L", "Allgemein"), ("Allgemein", "K")}


def test_real_data_named_like_the_sum_column_is_not_mixed_up(table):
    df = table([("A", JAN, "E1", "1", "UmsatzEUR", "Gesamt", "Summen", "1")])
    assert [r.value for r in measure_cells(df, "UmsatzEUR", grand_total=True).collect()] == [1, 1]


def test_measures_in_takes_text_or_collection(table):
    df = table([("A", JAN, "E1", "1", m, "K", "L", "1")
                for m in ("Umsatz_EUR", "Umsatz EUR", "UmsatzEUR", None)])
    assert measures_in(df, "umsatz-eur").count() == 2
    assert measures_in(df, ["Umsatz EUR", "UmsatzEUR"]).count() == 3


def test_excluded_measures(table):
    df = table([("A", JAN, "E1", "1", m, "K", "L", "1")
                for m in (" SalesAmount", "salesprice", "Sales Amount", None)])
    assert {r.measure for r in exclude_measures(df).collect()} == {"Sales Amount", None}
    assert [r.measure for r in exclude_measures(df, catalog.EXCLUDED_OLD).collect()] == [None]


def test_aligned_sum_counts_missing_cells_as_zero(table):
    df = table([("A", JAN, "E1", "1", "a", "K1", "L", "1"),
                ("A", JAN, "E1", "1", "b", "K2", "L", "10"),
                ("A", JAN, "E1", "1", "c", "K1", "L", "100"),
                ("A", JAN, "E1", "1", "d", "K3", "L", "1000")])
    got = {r.product_category: r.value for r in aligned_sum(df, [["a"], ["b"]], [["c"]]).collect()}
    assert got == {"K1": -99, "K2": 10, "Gesamt": -89}


def test_e3_of_zero_is_not_profitable(table):
    df = table([("A", JAN, "E1", "1", "UmsatzEUR", "K", "L", "5"),
                ("A", JAN, "E3", "1", "Commission", "K", "L", "5"),
                ("B", JAN, "E1", "1", "UmsatzEUR", "K", "L", "5")])
    got = {r.store: (r.e3_total, r.status) for r in scope_status(df).collect()}
    assert got == {"A": (0, catalog.NOT_PROFITABLE), "B": (5, catalog.PROFITABLE)}


def test_scope_without_known_measure(table):
    df = table([("A", JAN, "E1", "1", "Sales", "K", "L", "5"),
                ("B", JAN, "E1", "1", "other", "K", "L", "5")])
    assert margin_cascade(df).count() == 0
    got = {r.store: r for r in kpi_overview(df).collect()}
    assert (got["A"].total_revenue, got["A"].revenue_labels, got["A"].e3_total) == (5, "Sales", 0)
    assert got["A"].status == catalog.NOT_PROFITABLE and got["A"].revenue_found
    assert not got["B"].revenue_found and got["B"].total_revenue == 0


def test_revenue_names_of_both_rules(table):
    df = table([("A", JAN, "E1", "1", m, "K", "L", "1")
                for m in ("Umsatz EUR", "Umsatz_EUR", " UmsatzEUR", "Revenue", "x")])
    current, legacy = (total_revenue(df, profile=p).first() for p in ("current", "legacy"))
    assert (current.total_revenue, current.revenue_labels) == (
        4, " UmsatzEUR, Revenue, Umsatz EUR, Umsatz_EUR")
    assert (legacy.total_revenue, legacy.revenue_labels) == (2, " UmsatzEUR, Revenue")


def test_missing_measures_match_plain_names_on_any_level(table):
    df = table([("A", JAN, "E3", "1", " umsatzeur ", "K", "L", "1"),
                ("A", JAN, "E1", "1", "TransferPriceEUR", "K", "L", "1"),
                ("A", JAN, "E1", "1", "Commission in EUR", "K", "L", "1"),
                ("A", JAN, "E1", "1", "Discount_AufMaterialEUR", "K", "L", "1")])
    got = {r.level: r.missing for r in missing_measures(df).collect()}
    assert got == {"E2": ", ".join(catalog.EXPECTED["E2"]), "E3": ", ".join(catalog.EXPECTED["E3"])}


def test_complete_scope_misses_nothing(table):
    df = table([("A", JAN, "E1", "1", m, "K", "L", "1")
                for names in catalog.EXPECTED.values() for m in names])
    assert missing_measures(df).count() == 0
    assert kpi_overview(df).first().missing == ""


def test_rows_without_store_or_month_are_in_no_report(table):
    df = table([(None, JAN, "E1", "1", "UmsatzEUR", "K", "L", "1"),
                ("A", None, "E1", "1", "UmsatzEUR", "K", "L", "1")])
    assert margin_cascade(df).count() == 0 and margin_statement(df).count() == 0


def test_rollup_periods_add_up(measures):
    totals = defaultdict(lambda: [Decimal(0)] * 3)
    for r in period_rollup(measures).collect():
        cell = (r.store, r.year, r.product_line, r.product_category, r.grain)
        totals[cell] = [a + b for a, b in
                        zip(totals[cell], (r.e1_total, r.e2_total, r.e3_total))]
    years = {k[:4]: v for k, v in totals.items() if k[4] == "year"}
    assert years == {k[:4]: v for k, v in totals.items() if k[4] == "quarter"}
    assert years == {k[:4]: v for k, v in totals.items() if k[4] == "month"}
    direct = {(r.store, r.year, r.product_line, r.product_category):
              [r.e1_total, r.e2_total, r.e3_total] for r in margin_cascade(measures).collect()}
    assert direct == years


def test_rules_agree_on_e3_and_differ_on_e2(measures):
    def by_cell(profile):
        return {(r.store, r.year, r.product_line, r.product_category): r
                for r in margin_cascade(measures, profile=profile).collect()}

    current, handbook = by_cell("current"), by_cell("handbook")
    assert {k: r.e3_total for k, r in current.items()} == {
        k: r.e3_total for k, r in handbook.items()}
    assert any(handbook[k].e2_total < r.e2_total for k, r in current.items())


def test_statement_total_is_the_figure(measures):
    statement = margin_statement(measures)
    e3 = {(r.store, r.year): r.value for r in statement.filter(
        (F.col("row_label") == "E3 | E3 Total") & (F.col("product_line") == "Summen")).collect()}
    assert e3 == {(r.store, r.year): r.e3_total for r in kpi_overview(measures).collect()}


def test_summarized_table_gives_the_same_reports(measures):
    small = summarize(measures)
    assert small.count() < measures.count()
    for report in (margin_cascade, margin_statement, kpi_overview, period_rollup):
        assert sorted(map(str, report(small).collect())) == sorted(
            map(str, report(measures).collect()))


def test_sums_beyond_a_single_value_are_kept(table, spark):
    big = "99999999999999.9999"
    df = table([("A", JAN, "E1", "1", "UmsatzEUR", "K", "L", big)] * 3)
    want = Decimal(big) * 3
    for source in (df, summarize(df)):
        assert [r.e1_total for r in margin_cascade(source).collect()] == [want, want]


def test_pivot_has_the_sum_last_and_zeros(table):
    df = table([("A", JAN, "E1", "1", "UmsatzEUR", "K", "Z", "1"),
                ("B", JAN, "E1", "1", "UmsatzEUR", "K", "A", "2")])
    wide = measure_pivot(df, catalog.REVENUE)
    assert wide.columns == ["store", "year", "A | K", "Z | K", GRAND_CELL]
    assert sorted(tuple(r) for r in wide.collect()) == [("A", 2024, 0, 1, 1), ("B", 2024, 2, 0, 2)]
    # cells left out of the columns still count in the sum
    narrow = measure_pivot(df, catalog.REVENUE, columns=["Z | K"])
    assert sorted(tuple(r) for r in narrow.collect()) == [("A", 2024, 1, 0, 1), ("B", 2024, 0, 2, 2)]


def test_text_month_is_parsed_or_raises(table):
    df = table([("A", JAN, "E1", "1", "UmsatzEUR", "K", "L", "1")])
    text = df.withColumn("month", F.col("month").cast("string"))
    assert margin_cascade(text).first().year == 2024
    with pytest.raises(Exception) as error:
        margin_cascade(text.withColumn("month", F.lit("soon"))).collect()
    assert not isinstance(error.value, AnalysisException)
