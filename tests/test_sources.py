import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from marginflow import catalog, store_report
from marginflow.operators import periods, quality
from marginflow.operators.cascade import margin_cascade
from marginflow.operators.cells import summarize
from marginflow.plans.report import format_statement
from marginflow.sources import (
    MEASURES,
    adapt_columns,
    adapt_levels,
    distinct_stores,
    has_levels,
    load_once,
    publish,
    publish_view,
    read_measures,
    reload,
    require_columns,
    scan_store,
    scan_store_projected,
    shared_folder,
)

JAN = "2024-01-01"
SOURCE = {v: k for k, v in catalog.SOURCE_COLUMNS.items()}


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("format", ["parquet", "orc", "json", "csv"])
def test_reads_file_formats_with_source_column_names(measures, tmp_path, format):
    folder = str(tmp_path / format)
    source = measures.withColumnsRenamed({c: SOURCE[c] for c in MEASURES.names})
    options = {"header": "true"} if format == "csv" else {}
    source.write.format(format).options(**options).save(folder)
    table = read_measures(measures.sparkSession, folder, format, **options)
    assert set(table.columns) == set(MEASURES.names)
    assert rows(margin_cascade(table)) == rows(margin_cascade(measures))


def test_published_table_is_pruned_by_store_and_whole(measures, tmp_path):
    folder = str(tmp_path / "m")
    publish(measures, folder)
    table = read_measures(measures.sparkSession, folder)
    assert rows(table.select(*MEASURES.names)) == rows(measures)
    one = scan_store(table, " NATION_12 ")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*store#\d+[^\]]*= NATION_12", plan)
    assert one.count() == measures.filter("store = 'NATION_12'").count() > 0
    period = periods.filter_period(table, 1997, "Q2").groupBy().count()
    assert "GreaterThanOrEqual(month,1997-04-01), LessThan(month,1997-07-01)" in (
        period._jdf.queryExecution().executedPlan().toString()
    )


def test_publish_trims_stores_and_splits_a_hot_store(spark, tmp_path):
    hot = spark.range(0, 60000, 1, 8).select(
        F.lit(" HOT ").alias("store"),
        F.to_date(F.lit(JAN)).alias("month"),
        *[F.lit("x").alias(c) for c in ("level", "pos", "measure", "product_category", "product_line")],
        F.sha2(F.col("id").cast("string"), 256).alias("value"),
    )
    folder = tmp_path / "hot"
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256KB")
    try:
        publish(hot, str(folder))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = list((folder / "store=HOT").glob("*.parquet"))
    assert len(files) > 2
    assert spark.read.parquet(str(folder)).count() == 60000


def test_publish_needs_a_target(measures):
    with pytest.raises(ValueError):
        publish(measures)


def test_publish_as_table_and_reload(measures, tmp_path):
    spark = measures.sparkSession
    publish(measures.filter("level = 'E1'"), str(tmp_path / "t"), "measures_e1")
    try:
        assert spark.table("measures_e1").count() == 18000
        publish(measures.filter("level = 'E2'"), str(tmp_path / "t"), "measures_e1", "overwrite")
        assert {r.level for r in reload(spark, "measures_e1").select("level").distinct().collect()} == {"E2"}
    finally:
        spark.sql("DROP TABLE measures_e1")


def test_load_once_until_refreshed(measures, tmp_path):
    spark = measures.sparkSession
    made, folder = [], str(tmp_path)

    def make():
        made.append(1)
        return summarize(measures.filter("level = 'E1'" if len(made) == 1 else "level = 'E2'"))

    try:
        first = rows(load_once(spark, "sums", make, folder=folder))
        assert first == rows(load_once(spark, "sums", make, folder=folder)) and len(made) == 1
        fresh = load_once(spark, "sums", make, refresh=True, folder=folder)
        assert len(made) == 2
        assert {r.level for r in fresh.select("level").distinct().collect()} == {"E2"}
    finally:
        spark.sql("DROP TABLE IF EXISTS sums")


def test_broken_load_is_made_again(measures, tmp_path):
    spark, folder = measures.sparkSession, str(tmp_path)
    broken = measures.withColumn("value", F.raise_error(F.lit("lost")).cast("string"))
    try:
        with pytest.raises(Exception, match="lost"):
            load_once(spark, "broken", lambda: broken, folder=folder)
        assert load_once(spark, "broken", lambda: measures, folder=folder).count() == 32478
    finally:
        spark.sql("DROP TABLE IF EXISTS broken")


def test_shared_folder_is_the_one_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert shared_folder(spark) == named.rstrip("/")
    else:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(spark)


def test_publish_view(measures):
    publish_view(measures, "measures_view")
    assert measures.sparkSession.sql("SELECT count(*) AS n FROM measures_view").first().n == 32478


def test_distinct_stores_are_trimmed_once(table):
    df = table([(s, JAN, "E1", "1", "m", "K", "L", "1") for s in ("B ", " B", "A", "", "\t", None)])
    assert [r.store for r in distinct_stores(df).collect()] == ["A", "B"]


def test_required_columns(measures):
    with pytest.raises(ValueError, match="missing columns: month, value; available: store, level"):
        require_columns(measures.drop("month", "value"))
    with pytest.raises(ValueError, match="e1_total, e2_total, e3_total, overall_total"):
        scan_store_projected(measures, "A")
    assert require_columns(measures) is measures
    assert not has_levels(measures.drop("pos")) and has_levels(measures)


def test_level_adapter(spark):
    df = spark.createDataFrame([(" DB1", "7"), ("DB9 ", None), (None, "1")], "DBEbene string, Position string")
    got = adapt_levels(adapt_columns(df)).collect()
    assert [(r.level, r.pos) for r in got] == [("E1", "7"), ("DB9", None), (None, "1")]
    same = spark.createDataFrame([("E2", "DB1")], "Ebene string, DBEbene string")
    assert adapt_levels(adapt_columns(same)).first().level == "E2"


def test_periods(table):
    df = table([("A", m, "E1", "1", "m", "K", "L", "1")
                for m in (JAN, "2024-05-01", "2023-12-01", None)])
    timed = {str(r.month): (r.year, r.quarter) for r in periods.add_time_columns(df).collect()}
    assert timed == {JAN: (2024, "Q1"), "2024-05-01": (2024, "Q2"), "2023-12-01": (2023, "Q4"),
                     "None": (None, None)}
    assert periods.filter_period(df).count() == 4
    assert periods.filter_period(df, 2023, "Q4").count() == 1
    assert periods.filter_period(df, 2024).count() == 2
    assert periods.filter_period(df, 2024, month=dt.date(2024, 5, 1)).count() == 1
    assert periods.filter_period(df, quarter="Q1").count() == 1
    ranks = {str(r.month): (r.year_rank, r.month_rank) for r in periods.period_options(df).collect()}
    assert ranks[JAN] == (1, 2) and ranks["2023-12-01"] == (2, 1)
    assert {str(r.month) for r in periods.at_latest_year(df).collect()} == {JAN, "2024-05-01"}
    titles = {r.title for r in periods.period_titles(df).collect()}
    assert titles == {"Gesamtjahr 2024", "Gesamtjahr 2023", "Q1 2024", "Q2 2024", "Q4 2023",
                      JAN, "2024-05-01", "2023-12-01"}


def test_bad_month_can_become_null(spark):
    df = spark.createDataFrame([("A", "soon"), ("A", "2024-02-01")], "store string, month string")
    got = [(r.month, r.year) for r in periods.add_time_columns(df, strict=False).collect()]
    assert got == [(None, None), (dt.date(2024, 2, 1), 2024)]


def test_legend_is_in_first_seen_order(table):
    df = table([("A", "2024-02-01", "E1", "1", "UmsatzEUR", "K", "L", "1"),
                ("A", JAN, "E2", "1", " Neu ", "K", "L", "1"),
                ("A", JAN, "E1", "2", "Monthly Rent", "K", "L", "1"),
                ("A", JAN, None, "1", "SalesAmount", "K", "L", "1"),
                ("A", JAN, "E3", "1", "Neu", "K", "L", "1"),
                ("A", JAN, "E3", "1", None, "K", "L", "1")])
    got = [(r.row_rank, r.measure, r.description) for r in quality.measure_legend(df).orderBy("row_rank").collect()]
    assert got == [(1, "Monthly Rent", "Monatsmiete."), (2, "Neu", catalog.NO_DESCRIPTION),
                   (3, "SalesAmount", catalog.NO_DESCRIPTION), (4, "UmsatzEUR", "Umsatz in EUR.")]
    names = quality.measure_legend(df, excluded=catalog.EXCLUDED_OLD)
    assert "SalesAmount" not in {r.measure for r in names.collect()}


def test_store_report(measures):
    report = store_report(measures, "NATION_12", 1997, "Q2", dt.date(1997, 4, 1))
    figures = report.figures.collect()
    assert [(f.store, f.year, f.quarter, str(f.month)) for f in figures] == [
        ("NATION_12", 1997, "Q2", "1997-04-01")]
    text = format_statement(report.statement).filter(
        (F.col("row_label") == "E3 | E3 Total") & (F.col("product_line") == "Summen")).first()
    amount = f"{figures[0].e3_total:,.2f}".replace(",", "_").replace(".", ",").replace("_", ".")
    assert text.value == amount + " €"
    assert report.cascade.count() > 0 and report.legend.count() > 0
    missing = [(r.level, r.missing) for r in report.missing.collect()]
    assert missing == [("E3", "Additional Procurement Costs, Marketing Campaign")]
    empty = store_report(measures, "NOWHERE", 1997)
    assert empty.statement.count() == 0 and empty.figures.count() == 0
    flat = store_report(measures.drop("level"), year=1997)
    assert flat.statement is None and flat.figures.count() == 10
