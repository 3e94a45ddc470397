"""What the plans of the registered queries must and must not contain."""

import re

import pytest

from pyspark.sql import functions as F

from conftest import SMALL
from marginflow.operators import statement as st
from marginflow.operators.cascade import kpi_overview, margin_cascade, period_rollup
from marginflow.operators.ordering import view_order
from marginflow.operators.totals import measures_with_totals
from marginflow.plans.settings import cluster_settings
from marginflow.registry import QUERIES, Tables, registered
from marginflow.sources import (
    publish,
    publish_by_month,
    published_stores,
    read_footers,
    read_measures,
    readers,
    scan_store,
    views,
)

# Results that are one row or a top list, and the sample entitlements made from a top list.
ONE_TASK = {"row_count", "published_row_count", "top_200", "entitled_rows", "entitled_grains"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.collect()
    text = plan_of(df)
    return text.split("== Initial Plan ==")[0]


@pytest.fixture(scope="module")
def stored(measures, tmp_path_factory):
    """The measure table as files, not partitioned, so that a scan is easy to recognize."""
    folder = str(tmp_path_factory.mktemp("stored") / "m")
    measures.write.parquet(folder)
    return read_measures(measures.sparkSession, folder, trimmed=True)


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_python_no_products_no_single_task(spark, name):
    plan = plan_of(registered()[name](spark, SMALL))
    assert not re.search("Python|Pandas|Arrow", plan)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    if name not in ONE_TASK:
        assert "SinglePartition" not in plan


@pytest.mark.parametrize("name", ["margin_statement", "level_table", "synthesized_e2"])
def test_statement_reads_its_rows_once(spark, stored, name):
    plan = final_plan(QUERIES[name](Tables(spark, SMALL, stored)))
    scans = len(re.findall("FileScan", plan))
    assert scans == 1 and "ReusedExchange" in plan


@pytest.mark.parametrize("operator", [margin_cascade, kpi_overview])
def test_one_scan_without_reuse(stored, operator):
    assert plan_of(operator(stored)).count("FileScan") == 1


def test_rollup_steps_share_one_scan(stored):
    plan = final_plan(period_rollup(stored))
    assert len(re.findall("FileScan", plan)) == 1 and "ReusedExchange" in plan


def test_totals_share_the_distinct_rows(stored):
    plan = final_plan(measures_with_totals(stored))
    assert len(re.findall("FileScan", plan)) == 1 and "BroadcastHashJoin" in plan


def test_counting_keys_of_derived_rows_writes_no_amounts(spark):
    """The job ahead of the join by key leaves out the text of every amount."""
    plan = plan_of(QUERIES["measures_with_totals"](Tables(spark, SMALL)).select("store", "month").distinct())
    assert "l_extendedprice" in plan
    plan = plan_of(Tables(spark, SMALL).measures.select("store", "month").distinct())
    assert "l_extendedprice" not in plan and "l_tax" not in plan


def test_few_suppliers_are_broadcast_at_any_file_size(spark, tmp_path):
    """Lines do not move to their suppliers if the suppliers' keys fit."""
    for name in ("lineitem", "nation", "part"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{SMALL}/{name}.parquet")
    many = spark.range(30_000).selectExpr("id s_suppkey", "CAST(id % 25 AS INT) s_nationkey", "CAST(id AS DOUBLE) s_acctbal")
    many.write.parquet(str(tmp_path / "supplier.parquet"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16k")
    try:
        plan = plan_of(Tables(spark, str(tmp_path)).measures)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "l_suppkey" in plan and "hashpartitioning(l_suppkey" not in plan


def test_rows_in_view_order_are_packed_until_they_are_whole(stored):
    """Texts are packed in the distinct ahead of the sort, and read from files once."""
    plan = final_plan(view_order(measures_with_totals(stored)))
    moved = [x for x in plan.splitlines() if "Exchange hashpartitioning(store" in x and "month" in x]
    assert any("_packed_texts" in x for x in moved) and not any("measure#" in x for x in moved)
    assert "Exchange rangepartitioning(month" in plan and len(re.findall("FileScan", plan)) == 1


def test_names_are_normalized_after_the_sums(stored):
    """No regular expression below the first shuffle."""
    for operator in (margin_cascade, kpi_overview, period_rollup, st.margin_statement):
        plan = plan_of(operator(stored))
        below = plan[plan.rindex("Exchange hashpartitioning"):]
        assert "FileScan" in below and "regexp" not in below


def test_scans_read_only_what_they_need(stored):
    schema = re.search(r"ReadSchema: struct<(.*?)>", plan_of(kpi_overview(stored))).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"store", "month", "measure", "value"}
    schema = re.search(r"ReadSchema: struct<(.*?)>", plan_of(margin_cascade(stored))).group(1)
    assert "level" not in schema and "pos" not in schema


def test_filters_reach_the_scan(stored):
    plan = plan_of(margin_cascade(stored.filter("store = 'NATION_12'")))
    assert "EqualTo(store,NATION_12)" in plan and "IsNotNull(month)" in plan


def test_cluster_settings_go_by_cells():
    small, large = cluster_settings(10**9, 10**6), cluster_settings(100 * 10**12, 10**10)
    assert small["spark.sql.shuffle.partitions"] == "200"
    assert 200 < int(large["spark.sql.shuffle.partitions"]) < 20_000
    assert 100 * 10**12 / int(large["spark.sql.files.maxPartitionBytes"]) <= 100_000
    assert large["spark.sql.adaptive.enabled"] == "true"


def test_published_cells_serve_a_report_by_partition(measures, tmp_path):
    from marginflow.operators.cells import summarize

    publish(summarize(measures), str(tmp_path / "s"))
    table = read_measures(measures.sparkSession, str(tmp_path / "s"))
    one = margin_cascade(table.filter("store = 'NATION_12'"))
    assert re.search(r"PartitionFilters: \[[^\]]*store#\d+[^\]]*= NATION_12", plan_of(one))
    want = margin_cascade(measures.filter("store = 'NATION_12'"))
    assert sorted(map(str, one.collect())) == sorted(map(str, want.collect()))


def pushed(df):
    return re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan_of(df), re.DOTALL).group(1)


def test_one_store_reaches_the_scan_of_names_with_blanks(spark, table, tmp_path):
    """On the path read_measures takes by itself."""
    names = ("B", " B ", "\u3000B", "AB", "A B", "b", "C", None)
    rows = [(s, "2024-01-01", "E1", "1", "m", "K", "L", str(i)) for i, s in enumerate(names)]
    table(rows).write.parquet(str(tmp_path / "t"))
    read = read_measures(spark, str(tmp_path / "t"))
    one = scan_store(read, " B ")
    assert "StringContains(store,B)" in pushed(one) and "StringStartsWith(store,B)" in pushed(one)
    assert sorted(r.value for r in one.collect()) == ["0", "1", "2"]
    assert scan_store(read.filter("value <> '1'"), "B").count() == 2
    # Where the stored name is out of reach the exact condition does it alone.
    grouped = read.groupBy("store").agg({"value": "max"})
    assert [r.store for r in scan_store(grouped, "B").collect()] == ["B"]


def test_one_store_skips_row_groups(spark, tmp_path):
    rows = spark.range(0, 40_000, 1, 1).selectExpr(
        "format_string('S%05d', id DIV 10) store", "CAST(id AS STRING) value"
    )
    rows.write.option("parquet.block.size", 65536).option("parquet.page.row.count.limit", 500).parquet(
        str(tmp_path / "t")
    )
    one = scan_store(read_measures(spark, str(tmp_path / "t")), "S00017")
    assert one.count() == 10


def test_totals_by_month_move_no_rows_and_start_no_job(spark, measures, tmp_path):
    publish_by_month(measures, "plan_by_month", 4, str(tmp_path / "t"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.sparkContext.setJobGroup("planning", "")
    try:
        df = measures_with_totals(spark.table("plan_by_month"), by_month=True)
        plan_of(df)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("planning")
        plan = final_plan(df)
        assert "Exchange" not in plan and "SelectedBucketsCount: 4 out of 4" in plan
        want = measures_with_totals(measures).select(*df.columns)
        assert sorted(map(str, df.collect())) == sorted(map(str, want.collect()))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        spark.sql("DROP TABLE plan_by_month")


def odd_rows(table):
    stores, months = ("A", " B", "NATION_1", "ä", None), ("2024-01-01", "2024-02-01", "2023-05-01", None)
    return table([(s, m, "E1", p, "m\x01s", None, "", v) for s in stores for m in months
                  for p, v in (("1", "1"), ("1", "1"), (None, "2"), ("3", "n/a"), ("4", None))])


def buckets_of(folder):
    return [re.search(r"_(\d{5})\.c", f.name).group(1) for f in folder.glob("*.parquet")]


@pytest.mark.parametrize("at_once", [1000, 30])
def test_buckets_go_by_rows_and_are_written_in_turns(spark, table, tmp_path, monkeypatch, at_once):
    """The same table, one file a bucket, whether it is written at once or in turns."""
    monkeypatch.setattr(readers, "ROWS_AT_ONCE", at_once)
    monkeypatch.setattr(readers, "ROWS_A_BUCKET", 5)
    df, path = odd_rows(table), str(tmp_path / "t")
    publish_by_month(df, "in_turns", None, path)
    try:
        found = spark.table("in_turns")
        assert found.columns == df.columns
        want = df.withColumn("store", F.trim("store"))
        assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
        got = measures_with_totals(found, by_month=True)
        assert "SelectedBucketsCount: 20 out of 20" in plan_of(got)
        assert sorted(map(str, got.collect())) == sorted(map(str, measures_with_totals(want).collect()))
        files = buckets_of(tmp_path / "t")
        assert len(files) == len(set(files)) > 4
        assert not spark.catalog.tableExists("in_turns_unfinished")
        with pytest.raises(Exception, match="(?i)exists"):
            publish_by_month(df, "in_turns", None, path)
    finally:
        spark.sql("DROP TABLE IF EXISTS in_turns")


def test_a_table_in_turns_is_there_whole_or_not_at_all(spark, table, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "ROWS_AT_ONCE", 30)
    write, turns = readers._write_buckets, []

    def broken(*args):
        turns.append(args)
        if len(turns) == 3:
            raise RuntimeError("no space left")
        write(*args)

    monkeypatch.setattr(readers, "_write_buckets", broken)
    with pytest.raises(RuntimeError, match="no space"):
        publish_by_month(odd_rows(table), "broken_off", 4, str(tmp_path / "t"))
    assert not spark.catalog.tableExists("broken_off")
    assert not spark.catalog.tableExists("broken_off_unfinished")


def test_a_table_is_replaced_in_turns_by_its_own_rows(spark, table, monkeypatch):
    monkeypatch.setattr(readers, "ROWS_AT_ONCE", 30)
    publish_by_month(odd_rows(table), "replaced", 4)
    try:
        publish_by_month(spark.table("replaced").filter("value = '1'"), "replaced", 4, mode="overwrite")
        assert spark.table("replaced").groupBy("value").count().collect() == [("1", 40)]
    finally:
        spark.sql("DROP TABLE IF EXISTS replaced")


def test_totals_look_up_their_month_without_sorting_rows(spark, measures, tmp_path):
    publish_by_month(measures, "looked_up", 4, str(tmp_path / "t"))
    try:
        views.publish_views(spark, measures="looked_up", with_totals="looked_up_view")
        for df in (measures_with_totals(spark.table("looked_up"), by_month=True), spark.table("looked_up_view")):
            plan = final_plan(df)
            assert "ShuffledHashJoin" in plan and "Sort " not in plan and "Exchange" not in plan
    finally:
        spark.sql("DROP VIEW IF EXISTS looked_up_view")
        spark.sql("DROP TABLE looked_up")


def test_counts_and_extremes_come_from_footers(spark, measures, tmp_path):
    from marginflow.operators.periods import latest_year
    from marginflow.operators.quality import row_count

    publish(measures, str(tmp_path / "t"))
    table = read_footers(spark, str(tmp_path / "t"))
    assert "PushedAggregation: [COUNT(*)]" in plan_of(row_count(table))
    assert "PushedAggregation: [MAX(month)]" in plan_of(latest_year(table))
    assert row_count(table).first()[0] == 32478
    got = sorted(map(tuple, latest_year(table).collect()))
    assert got == sorted(map(tuple, latest_year(measures).collect()))
    # Other reads go on as before.
    assert "FileScan" in plan_of(spark.read.parquet(str(tmp_path / "t")))


def test_stores_of_a_published_table_open_no_file(spark, table, tmp_path):
    rows = [(s, "2024-01-01", "E1", "1", "m", "K", "L", "1") for s in ("B ", "001", "1", "a/b=%c", None)]
    publish(table(rows), str(tmp_path / "t"))
    plan = plan_of(published_stores(spark, str(tmp_path / "t")))
    assert "parquet" not in plan.lower()
    for file in (tmp_path / "t").rglob("*.parquet"):
        if "store=B" in str(file):
            file.write_bytes(b"not parquet")  # a file that is opened would fail the query
    got = [r.store for r in published_stores(spark, str(tmp_path / "t")).collect()]
    assert got == ["001", "1", "B", "a/b=%c"]
