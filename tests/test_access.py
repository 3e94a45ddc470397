from collections import Counter

import pytest
from pyspark.sql import functions as F

from marginflow.operators import access
from marginflow.plans import joins

JAN = "2024-01-01"


@pytest.fixture
def grants(spark):
    rows = [(1, "A"), (2, "A"), (2, " B "), (3, "*")]
    return spark.createDataFrame(rows, "user_level int, store string")


@pytest.fixture
def stores(table):
    return table([(s, m, "E1", "1", "m", "K", "L", "1")
                  for s in "ABC" for m in (JAN, "2024-04-01")])


@pytest.mark.parametrize("bound", [joins.MAX_BROADCAST_BYTES, -1])
def test_entitled_rows(stores, grants, monkeypatch, bound):
    monkeypatch.setattr(joins, "MAX_BROADCAST_BYTES", bound)
    got = Counter((r.user_level, r.store) for r in access.entitled_rows(stores, grants).collect())
    assert got == {(1, "A"): 2, (2, "A"): 2, (2, "B"): 2, (3, "A"): 2, (3, "B"): 2, (3, "C"): 2}
    mine = access.stores_for(stores, grants, 2)
    assert {r.store for r in mine.collect()} == {"A", "B"} and mine.columns == stores.columns


def test_no_grants_show_nothing(stores, grants):
    assert access.entitled_rows(stores, grants.filter("user_level > 9")).count() == 0


def test_entitled_grains(stores, grants):
    got = Counter((r.user_level, r.grain) for r in access.entitled_grains(stores, grants).collect())
    assert got == {(1, "year"): 1, (2, "year"): 2, (2, "quarter"): 4,
                   (3, "year"): 3, (3, "quarter"): 6, (3, "month"): 6}


def test_levels_are_clamped(spark):
    users = spark.createDataFrame([(None,), (0,), (-4,), (1,), (2,), (3,), (9,)], "security_level int")
    got = [r.user_level for r in access.effective_levels(users).collect()]
    assert got == [1, 1, 1, 1, 2, 3, 3]
    assert users.select(access.clamp_level(F.lit("2"))).first()[0] == 2
