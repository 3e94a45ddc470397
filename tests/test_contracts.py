"""What the operators promise beyond the derived table: odd names, amounts, levels, access."""

import re

import pytest
from pyspark.sql import functions as F

from marginflow import catalog
from marginflow.operators.access import entitled_rows, stores_for
from marginflow.operators.cascade import kpi_overview, margin_cascade, missing_measures
from marginflow.operators.cells import measure_pivot
from marginflow.operators.periods import at_latest_year
from marginflow.operators.quality import measure_legend
from marginflow.operators.statement import level_table, margin_statement, present_levels
from marginflow.plans.report import store_report, store_with_totals
from marginflow.sources import distinct_stores, publish, read_measures, scan_store


def row(store, level, measure, value, month="2024-01-01", pos="1", category="C", line="A"):
    return (store, month, level, pos, measure, category, line, value)


def test_unlisted_cells_are_in_a_column_of_their_own(table):
    df = table([row("s", "E1", "UmsatzEUR", "10"), row("s", "E1", "UmsatzEUR", "7", line="new")])
    wide = measure_pivot(df, catalog.REVENUE, columns=["A | C"]).first()
    assert (wide["A | C"], wide["other cells"], wide["Summen | Gesamt"]) == (10, 7, 17)
    listed = measure_pivot(df, catalog.REVENUE).first()
    assert (listed["A | C"], listed["new | C"]) == (10, 7) and "other cells" not in listed


def test_bars_in_names_do_not_merge_cells(table):
    df = table(
        [
            row("s", "E1", "UmsatzEUR", "1", line="A | B", category="C"),
            row("s", "E1", "UmsatzEUR", "2", line="A", category="B | C"),
        ]
    )
    wide = measure_pivot(df, catalog.REVENUE).first().asDict()
    assert sorted(v for k, v in wide.items() if "|" in k) == [1, 2, 3]


@pytest.mark.parametrize("text", ["100000000000000", "-1e20", "Infinity"])
def test_amounts_out_of_range_fail_and_are_never_zero(table, text):
    df = table([row("s", "E1", "UmsatzEUR", text), row("s", "E1", "UmsatzEUR", "1")])
    with pytest.raises(Exception, match="amount out of range"):
        margin_cascade(df).collect()


def test_large_amounts_in_range_and_text_that_is_no_number(table):
    rows = [("99999999999999.9999", 0), ("n/a", 0), ("NaN", 0), ("", 0), (None, 0)]
    df = table([row("s", "E1", "UmsatzEUR", v) for v, _ in rows])
    total = margin_cascade(df).filter("product_line = 'A'").first()
    assert str(total.e1_total) == "99999999999999.9999"


def test_stores_are_text_without_blanks(table, spark, tmp_path):
    names = ["001", "1", " B ", " B"]
    df = table([row(n, "E1", "UmsatzEUR", "1") for n in names])
    publish(df, str(tmp_path / "t"))
    df.withColumn("store", F.col("store")).write.option("header", True).csv(str(tmp_path / "c"))
    digits = table([row(n, "E1", "UmsatzEUR", "1") for n in ("001", "1")])
    publish(digits, str(tmp_path / "d"))
    both = read_measures(spark, str(tmp_path / "d"))
    assert [r.store for r in distinct_stores(both).collect()] == ["001", "1"]
    assert scan_store(both, "001").count() == 1
    csv = read_measures(spark, str(tmp_path / "c"), "csv", header="true", inferSchema="true")
    for read in (read_measures(spark, str(tmp_path / "t")), csv):
        assert dict(read.dtypes)["store"] == "string"
        assert [r.store for r in distinct_stores(read).collect()] == ["001", "1", "B"]
        assert scan_store(read, "B").count() == 2 and scan_store(read, "001").count() == 1
        assert store_report(read, " B ", 2024).figures.first().total_revenue == 2
        grants = spark.createDataFrame([(1, "B ")], "user_level int, store string")
        assert entitled_rows(read, grants).count() == 2


def test_reports_obey_the_user_level(table, spark):
    df = table([row(s, "E1", "UmsatzEUR", v) for s, v in (("a", "1"), ("b", "2"), ("c", "4"))])
    grants = spark.createDataFrame(
        [(1, "a"), (2, "a"), (2, "b"), (3, "*"), (9, "c"), (None, "b")],
        "user_level int, store string",
    )

    def seen(level, **period):
        found = store_report(df, None, 2024, user_level=level, entitlements=grants, **period)
        return {r.store for r in found.figures.collect()}

    # A missing level counts as the lowest, one out of range as the highest.
    assert seen(1) == {"a", "b"} == seen(0) and seen(2) == {"a", "b"} and seen(3) == {"a", "b", "c"}
    assert seen(2, quarter="Q1") == {"a", "b"} and seen(7, quarter="Q1") == {"a", "b", "c"}
    for level, period in ((1, {"quarter": "Q1"}), (1, {"month": "x"}), (2, {"month": "x"})):
        with pytest.raises(PermissionError):
            store_report(df, None, 2024, user_level=level, entitlements=grants, **period)
    with pytest.raises(ValueError):
        store_report(df, None, 2024, user_level=1)
    assert stores_for(df, grants, 3).count() == 3


def test_level_table_for_any_levels(table):
    df = table(
        [row("s", "E1", "UmsatzEUR", "5"), row("s", "E3", "Commission", "2"), row("s", "E3", "x", "1")]
    )

    def labels(levels):
        rows = level_table(df, levels=levels).filter("product_line = 'Summen'").collect()
        return sorted((r.label, int(r.value)) for r in rows)

    assert labels(("E1",)) == [("E1 Total", 5), ("UmsatzEUR", 5)]
    three = [("Commission", 2), ("E3 Total", 3), ("x", 1)]
    assert labels(("E3",)) == three
    assert labels(("E1", "E3")) == sorted([("E1 Total", 5), ("UmsatzEUR", 5), *three])
    assert labels(("E7",)) == []


def test_legend_without_levels_and_with_missing_keys(table):
    df = table(
        [
            row("s", "E1", "Monthly Rent", "1", pos="2"),
            row("s", "E1", "UmsatzEUR", "1", pos="1"),
            row(None, "E1", "UmsatzEUR", "1"),
            row("s", "E1", "UmsatzEUR", "1", month=None),
        ]
    )
    got = measure_legend(df).collect()
    assert [(r.store, r.year, r.measure, r.row_rank) for r in sorted(got, key=lambda r: r.row_rank)] == [
        ("s", 2024, "UmsatzEUR", 1),
        ("s", 2024, "Monthly Rent", 2),
    ]
    plain = df.drop("level", "pos")
    got = measure_legend(plain).collect()
    assert {(r.measure, r.row_rank) for r in got} == {("Monthly Rent", 1), ("UmsatzEUR", 2)}
    assert store_report(plain, "s", 2024).statement is None
    assert store_report(plain, "s", 2024).legend.count() == 2


def test_present_levels_by_any_scope(table):
    df = table([row("s", "E1", "a", "1"), row("s", "E3", "b", "1", month="2025-02-01"), row(None, "E2", "c", "1")])
    by_store = {r.store: r.levels for r in present_levels(df).collect()}
    assert by_store == {"s": "E1, E3"}
    by_year = {(r.store, r.year): r.levels for r in present_levels(df, ("store", "year")).collect()}
    assert by_year == {("s", 2024): "E1", ("s", 2025): "E3"}


def test_legacy_rule(table):
    df = table(
        [
            row("s", "E1", "TransferPriceEUR", "-1", pos="1"),
            row("s", "E1", "Umsatz EUR", "5", pos="2"),
            row("s", "E3", "Monthly Rent", "1"),
            row("s", "E3", "Sales Amount", "9"),
        ]
    )
    missing = [(r.level, r.missing) for r in missing_measures(df, profile="legacy").collect()]
    assert missing == [("E2", "Commission/Commission in EUR")]
    assert kpi_overview(df, profile="legacy").first().missing == "Commission/Commission in EUR"
    rows = margin_statement(df, profile="legacy").filter("product_line = 'Summen'")
    order = [r.row_label for r in rows.orderBy("row_rank").collect()]
    assert order == [
        "E1 | TransferPriceEUR", "E1 | Umsatz EUR", "E1 | E1 Total",
        "E3 | Monthly Rent", "E3 | E3 Total",
    ]
    now = margin_statement(df).filter("product_line = 'Summen'").orderBy("row_rank").collect()
    assert "E2 | E2 Total" in [r.row_label for r in now]


def test_one_store_is_picked_before_any_count_of_keys(table, monkeypatch):
    """The probe that sizes the join reads the store asked for alone."""
    from marginflow.plans import joins

    probes = []
    kept = joins.byte_bound

    def noted(keys, extra_fields=0):
        probes.append(keys._jdf.queryExecution().optimizedPlan().toString())
        return kept(keys, extra_fields)

    monkeypatch.setattr(joins, "byte_bound", noted)
    df = table([row(s, "E1", "UmsatzEUR", "1") for s in "ab"])
    assert store_with_totals(df, "b").count() == 1
    assert len(probes) == 1 and re.search(r"store#\d+ = b", probes[0])


def test_probes_read_key_columns_only_and_once(table, spark, monkeypatch):
    from marginflow.plans import joins

    probes = []
    kept = joins.byte_bound

    def noted(keys, extra_fields=0):
        probes.append(keys.columns)
        return kept(keys, extra_fields)

    monkeypatch.setattr(joins, "byte_bound", noted)
    df = table([row(s, "E1", "UmsatzEUR", "1") for s in "ab"])
    at_latest_year(df)
    grants = spark.createDataFrame([(1, "a")], "user_level int, store string")
    entitled_rows(df, grants)
    assert probes == [["store"], ["store"]]


