"""Loads in versions: expiry, the swap, and refreshes that fail."""

import time

import pytest
from pyspark.sql import functions as F

from marginflow.operators.cells import summarize
from marginflow.sources import load_once, versions


@pytest.fixture
def made():
    return []


@pytest.fixture
def load(spark, measures, tmp_path, made):
    """Loads of the rows of one level after the other."""

    def run(**options):
        def make():
            made.append(1)
            return measures.filter(F.col("level") == f"E{len(made)}")

        return load_once(spark, "t", make, folder=str(tmp_path), **options)

    return run


def levels(df):
    return {r.level for r in df.select("level").distinct().collect()}


def test_query_that_began_before_a_refresh_ends_right(load):
    before = load()
    again = load(refresh=True, keep_for=3600.0)
    assert levels(before) == {"E1"} and levels(again) == {"E2"}
    assert before.count() == 18000


def test_failed_refresh_keeps_the_table(spark, measures, tmp_path, load):
    load()
    broken = measures.withColumn("value", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        load_once(spark, "t", lambda: broken, refresh=True, folder=str(tmp_path))
    assert levels(load()) == {"E1"}
    assert len(list((tmp_path / "t").glob("data-*"))) == 1  # nothing is left of it


def test_refresh_that_was_killed_counts_for_nothing(spark, measures, tmp_path, load):
    load()
    # Files of a version without its mark, as a driver that is lost leaves them.
    measures.write.parquet(str(tmp_path / "t" / "data-0"))
    assert levels(load()) == {"E1"}


def test_max_age_is_honoured(load, made):
    load()
    assert levels(load(max_age=3600.0)) == {"E1"} and len(made) == 1
    time.sleep(0.3)
    assert levels(load(max_age=0.2)) == {"E2"} and len(made) == 2
    assert levels(load()) == {"E2"} and len(made) == 2


def test_replaced_versions_go_after_their_time(spark, tmp_path, load):
    home = str(tmp_path / "t")
    load()
    load(refresh=True, keep_for=3600.0)
    assert [v.number for v in versions.every(spark, home)] == [1, 2]
    time.sleep(0.2)
    assert [v.number for v in versions.drop_replaced(spark, home, 0.1)] == [1]
    assert [v.number for v in versions.every(spark, home)] == [2]
    assert len(list((tmp_path / "t").glob("data-*"))) == 1
    assert levels(load()) == {"E2"}


def test_two_refreshes_at_once_leave_one_table(spark, measures, tmp_path):
    home = str(tmp_path / "t")

    def inner(path):
        measures.filter("level = 'E2'").write.parquet(path)

    def outer(path):
        versions.add(spark, home, inner)  # ends while the other one still writes
        measures.filter("level = 'E1'").write.parquet(path)

    versions.add(spark, home, outer)
    assert [v.number for v in versions.every(spark, home)] == [1, 2]
    assert levels(spark.read.parquet(versions.current(spark, home).path)) == {"E1"}


def test_stores_with_digits_stay_text(spark, table, tmp_path):
    rows = [(s, "2024-01-01", "E1", "1", "m", "K", "L", "1") for s in ("001", "1")]
    got = load_once(spark, "d", lambda: table(rows), folder=str(tmp_path))
    assert sorted(r.store for r in got.collect()) == ["001", "1"]


def test_sums_are_loaded_once(spark, measures, tmp_path):
    sums = load_once(spark, "s", lambda: summarize(measures), folder=str(tmp_path))
    assert sorted(map(str, sums.select(*summarize(measures).columns).collect())) == sorted(
        map(str, summarize(measures).collect())
    )
