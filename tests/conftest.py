import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from marginflow.plans.settings import local_session  # noqa: E402
from marginflow.sources import MEASURES  # noqa: E402
from marginflow.sources.derived import derived_measures  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", shuffle_partitions=4, memory="4g")
    session.conf.set("spark.sql.maxMetadataStringLength", "4000")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def measures(spark):
    """The derived measure table at the smallest scale."""
    return derived_measures(spark, SMALL)


@pytest.fixture
def table(spark):
    """Measure table from short tuples (store, month, level, pos, measure, category, line, value)."""

    def make(rows):
        full = [(s, m and dt.date.fromisoformat(m), *rest) for s, m, *rest in rows]
        return spark.createDataFrame(full, MEASURES)

    return make
