"""Every registered query against its SQL in another engine, over whole tables."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as spark_entry
from conftest import SMALL

from marginflow.registry import registered


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for file in sorted(os.listdir(SMALL)):
        name = file.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{file}'")
    return connection


def test_every_query_has_its_sql():
    """The training data operators are checked by hand where SQL cannot express them."""
    assert set(registered()) <= set(spark_entry.oracle_sql()) <= set(spark_entry.queries())


@pytest.mark.parametrize("name", list(spark_entry.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    df = spark_entry.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    result = db.execute(spark_entry.oracle_sql()[name])
    place = {c[0]: i for i, c in enumerate(result.description)}
    assert sorted(place) == columns
    want = Counter(tuple(r[place[c]] for c in columns) for r in result.fetchall())
    assert Counter(tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()) == want


def test_entry(spark):
    df = spark_entry.entry(spark)
    assert df.columns == ["store", "year", "product_line", "product_category",
                          "e1_total", "e2_total", "e3_total"]
    assert df.count() > 0
