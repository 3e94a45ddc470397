"""Views in the catalog, and amounts that are set aside."""

import pytest
from pyspark.sql import functions as F

from marginflow import store_report
from marginflow.operators import refused
from marginflow.operators.cascade import margin_cascade
from marginflow.operators.totals import measures_plus_totals, measures_with_totals
from marginflow.sources import derived, publish, publish_by_month, views

JAN = "2024-01-01"


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture
def tables(spark, measures, tmp_path):
    publish(measures, str(tmp_path / "m"), "view_measures")
    campaign = derived.by_campaign(measures)
    campaign.write.option("path", str(tmp_path / "c")).saveAsTable("view_campaign")
    yield campaign
    for kind, name in (("VIEW", "totals_a"), ("VIEW", "totals_b"), ("TABLE", "view_measures"), ("TABLE", "view_campaign")):
        spark.sql(f"DROP {kind} IF EXISTS {name}")


def test_another_session_reads_the_views(spark, measures, tables):
    views.publish_views(spark, "view_measures", "view_campaign", "totals_a", "totals_b")
    other = spark.newSession()
    assert rows(other.table("totals_a")) == rows(measures_with_totals(measures))
    assert rows(other.sql("SELECT * FROM totals_b")) == rows(measures_plus_totals(tables))
    assert other.table("totals_a").dtypes == measures_with_totals(measures).dtypes
    assert other.table("totals_b").dtypes == measures_plus_totals(tables).dtypes


def test_views_show_the_table_as_it_is(spark, table, tables, tmp_path):
    views.publish_views(spark, measures="view_measures", with_totals="totals_a")
    new = table([("A", JAN, "E1", "1", "m", "K", "L", "2"), (None, JAN, "E1", "1", "m", "K", "L", "1")])
    publish(new, str(tmp_path / "m"), "view_measures", "overwrite")
    other = spark.newSession()
    other.catalog.refreshTable("view_measures")
    assert [(r.store, float(r.e1_total)) for r in other.table("totals_a").collect()] == [("A", 2.0)]


def test_views_fail_on_amounts_out_of_range(spark, table, tables, tmp_path):
    views.publish_views(spark, measures="view_measures", with_totals="totals_a")
    publish(table([("A", JAN, "E1", "1", "m", "K", "L", "1e15")]), str(tmp_path / "m"), "view_measures", "overwrite")
    with pytest.raises(Exception, match="amount out of range"):
        spark.table("totals_a").collect()


ODD = ("1", "Infinity", "-1e14", "n/a", None, "NaN", "99899999999999.9999", " 2 ", "1e400")


def test_every_row_is_accepted_or_refused(table):
    df = table([("A", JAN, "E1", "1", "UmsatzEUR", "K", "L", v) for v in ODD])
    accepted, listed = refused.set_aside(df)
    assert [r.value for r in listed.collect()] == ["Infinity", "-1e14", "1e400"]
    assert [r.reason for r in listed.collect()] == ["infinite", "out of range", "infinite"]
    assert sorted(map(str, (r.value for r in accepted.collect()))) == sorted(
        str(v) for v in ODD if v not in ("Infinity", "-1e14", "1e400")
    )


def test_one_infinity_among_many_rows_ends_no_run(spark, table):
    many = spark.range(0, 1_000_000, 1, 4).select(
        F.concat(F.lit("S"), F.col("id") % 50).alias("store"),
        F.to_date(F.lit(JAN)).alias("month"),
        F.lit("E1").alias("level"), F.lit("1").alias("pos"), F.lit("UmsatzEUR").alias("measure"),
        F.lit("K").alias("product_category"), F.lit("L").alias("product_line"),
        F.when(F.col("id") == 123_456, "Infinity").otherwise("2.5").alias("value"),
    )
    with pytest.raises(Exception, match="amount out of range"):
        margin_cascade(many).collect()
    accepted, listed = refused.set_aside(many)
    assert [(r.store, r.value) for r in listed.collect()] == [("S6", "Infinity")]
    got = refused.with_refused(margin_cascade(accepted), many).collect()
    assert {(r.store, r.n_refused) for r in got if r.n_refused} == {("S6", 1)}
    assert {float(r.e1_total) for r in got if r.store != "S6"} == {50_000.0}
    assert {float(r.e1_total) for r in got if r.store == "S6"} == {49_997.5}


def test_report_lists_what_it_leaves_out(table):
    df = table([
        ("A", JAN, "E1", "1", "UmsatzEUR", "K", "L", "5"),
        ("A", JAN, "E1", "2", "TransferPriceEUR", "K", "L", "1e15"),
        ("B", JAN, "E1", "1", "UmsatzEUR", "K", "L", "Infinity"),
    ])
    report = store_report(df, "A", 2024, refused="aside")
    assert [(r.measure, r.reason) for r in report.refused.collect()] == [("TransferPriceEUR", "out of range")]
    assert [float(r.total_revenue) for r in report.figures.collect()] == [5.0]
    assert store_report(df, "A", 2024).refused is None
    with pytest.raises(Exception, match="amount out of range"):
        store_report(df, "A", 2024).cascade.collect()
    with pytest.raises(ValueError):
        store_report(df, "A", refused="drop")


def test_counts_of_refused_rows(table):
    df = table([("A", JAN, "E1", "1", "m", "K", "L", "1e15")] * 2 + [("B", "2023-05-01", "E1", "1", "m", "K", "L", "1")])
    assert [tuple(r) for r in refused.refused_counts(df).collect()] == [("A", 2024, 2)]
    assert refused.refused_counts(df.limit(0)).collect() == []


def test_a_month_that_is_too_large_is_refused(table, tmp_path):
    df = table([("A", JAN, "E1", "1", "m", "K", "L", str(i)) for i in range(5)])
    with pytest.raises(ValueError, match="5 rows"):
        publish_by_month(df, "too_large", 2, str(tmp_path / "x"), most_rows=4)
