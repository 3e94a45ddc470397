"""Queries over what the package publishes: files by store, buckets by month, views, loads.

Each table is published once for a session and data folder, from the derived measures, and then
read by its queries. It lies in the shared folder the session names, or where it names none in a
new one of this machine.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame

from marginflow.operators import cascade, periods, quality, refused, totals
from marginflow.operators.cells import summarize
from marginflow.registry.oracles import (
    _CAMPAIGN,
    _EIGHT,
    _ELEVEN,
    _VIEW_1,
    _VIEW_2,
    _cascade,
    _m,
    _with,
)
from marginflow.registry.queries import Tables, query
from marginflow.sources import (
    load_once,
    publish,
    publish_by_month,
    published_stores,
    read_footers,
    shared_folder,
    views,
)
from marginflow.sources.derived import with_large_amounts

MAX_AGE = 3600.0  # seconds after which a load is made anew


@cache
def _folder(application: str, shared: str | None, sf_dir: str) -> str:
    name = f"published-{uuid.uuid4().hex}"
    return f"{shared or tempfile.mkdtemp(prefix='run-', dir=os.environ.get('TMPDIR', '/tmp'))}/{name}"


def folder(t: Tables) -> str:
    """Where this session keeps what it publishes of a data folder."""
    named = t.spark.conf.get("spark.checkpoint.dir", None)
    return _folder(
        t.spark.sparkContext.applicationId, shared_folder(t.spark) if named else None, t.sf_dir
    )


def by_store(t: Tables) -> str:
    """Path of the table partitioned by store."""
    path = f"{folder(t)}/by_store"
    if not _written(t, path):
        publish(t.measures, path, mode="overwrite")
    return path


def table_name(t: Tables, kind: str) -> str:
    return f"{kind}_{folder(t)[-32:]}"


def by_month(t: Tables) -> str:
    """Name of the table in buckets by store and month."""
    name = table_name(t, "by_month")
    if not t.spark.catalog.tableExists(name):
        publish_by_month(t.measures, name, None, f"{folder(t)}/by_month", "overwrite")
    return name


def by_campaign(t: Tables) -> str:
    """Name of the table in the campaign layout."""
    name = table_name(t, "by_campaign")
    if not t.spark.catalog.tableExists(name):
        path = f"{folder(t)}/by_campaign"
        t.by_campaign.write.mode("overwrite").option("path", path).saveAsTable(name)
    return name


def _written(t: Tables, path: str) -> bool:
    done = t.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(t.spark._jsc.hadoopConfiguration()).exists(done)


@query("published_stores")
def published_stores_query(t: Tables) -> DataFrame:
    return published_stores(t.spark, by_store(t))


@query("published_row_count")
def published_row_count_query(t: Tables) -> DataFrame:
    return quality.row_count(read_footers(t.spark, by_store(t)))


@query("published_latest_year")
def published_latest_year_query(t: Tables) -> DataFrame:
    return periods.latest_year(read_footers(t.spark, by_store(t)))


@query("totals_by_month")
def totals_by_month_query(t: Tables) -> DataFrame:
    return totals.measures_with_totals(t.spark.table(by_month(t)), by_month=True)


@query("view_with_totals")
def view_with_totals_query(t: Tables) -> DataFrame:
    name = table_name(t, views.WITH_TOTALS)
    views.publish_views(t.spark, measures=by_month(t), with_totals=name)
    return t.spark.table(name)


@query("view_plus_totals")
def view_plus_totals_query(t: Tables) -> DataFrame:
    name = table_name(t, views.PLUS_TOTALS)
    views.publish_views(t.spark, by_campaign=by_campaign(t), plus_totals=name)
    return t.spark.table(name)


@query("loaded_cascade")
def loaded_cascade_query(t: Tables) -> DataFrame:
    sums = load_once(
        t.spark, "sums", lambda: summarize(t.measures), folder=folder(t), max_age=MAX_AGE
    )
    return cascade.margin_cascade(sums)


@query("refused_amounts")
def refused_amounts_query(t: Tables) -> DataFrame:
    return refused.set_aside(with_large_amounts(t.measures)).refused


@query("cascade_set_aside")
def cascade_set_aside_query(t: Tables) -> DataFrame:
    measures = with_large_amounts(t.measures)
    margins = cascade.margin_cascade(refused.set_aside(measures).accepted)
    return refused.with_refused(margins, measures)


_LARGE = f"""
odd AS (
  SELECT store, month, level, pos, measure, product_category, product_line,
         CASE WHEN pos = '4' AND extract(month FROM month) = 1 THEN '1e15'
              WHEN pos = '9' AND extract(month FROM month) = 2 THEN '-Infinity'
              ELSE value END AS value
  FROM measures
), refused AS (
  SELECT {_EIGHT}, CASE WHEN value = '1e15' THEN 'out of range' ELSE 'infinite' END AS reason
  FROM odd WHERE value IN ('1e15', '-Infinity')
), accepted AS (SELECT * FROM odd WHERE value NOT IN ('1e15', '-Infinity'))"""


def published_oracles() -> dict[str, str]:
    """SQL text per query of this module."""
    twelve = f"{_EIGHT}, e1_total, e2_total, e3_total, overall_total"
    accepted = _m().replace("FROM measures", "FROM accepted")
    lacking = (
        "lacking AS (SELECT store, CAST(year(month) AS INTEGER) AS year, count(*) AS n "
        "FROM refused GROUP BY ALL)"
    )
    return {
        "published_stores": _with()
        + "SELECT DISTINCT trim(store) AS store FROM measures WHERE trim(store) <> ''",
        "published_row_count": _with() + "SELECT count(*) AS rows_total FROM measures",
        "published_latest_year": _with()
        + "SELECT store, CAST(max(year(month)) AS INTEGER) AS year FROM measures GROUP BY store",
        "totals_by_month": _with(_VIEW_1) + f"SELECT {twelve} FROM with_totals",
        "view_with_totals": _with(_VIEW_1) + f"SELECT {twelve} FROM with_totals",
        "view_plus_totals": _with(_CAMPAIGN, _VIEW_2)
        + f"SELECT {_ELEVEN} FROM plus_totals",
        "loaded_cascade": _with(_m()) + _cascade("store, year", "current"),
        "refused_amounts": _with(_LARGE) + f"SELECT {_EIGHT}, reason FROM refused",
        "cascade_set_aside": _with(
            _LARGE, accepted, f"margins AS ({_cascade('store, year', 'current')})", lacking
        )
        + "SELECT m.*, coalesce(l.n, 0) AS n_refused FROM margins m "
        "LEFT JOIN lacking l ON m.store = l.store AND m.year = l.year",
    }
