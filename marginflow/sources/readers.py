"""Scans and sinks of measure tables.

A published table is partitioned by store, so one store's scan prunes every other store's
files, and its files are sorted by month, so a period's scan skips row groups. A table published
by month is bucketed by store and month, so totals of a store's month meet their rows without a
shuffle.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from marginflow import catalog
from marginflow.functions import strip_space
from marginflow.operators.ordering import sorted_scan
from marginflow.plans.settings import shuffles_dropped
from marginflow.sources import versions
from marginflow.sources.schema import REQUIRED_STRICT, adapt_columns, adapt_levels, require_columns

STORED_NAME = "_store_as_stored"  # below the projection of `clean_stores`
MOST_ROWS = 50_000_000  # of one store and month in a table published by month
ROWS_A_BUCKET = 500_000  # where buckets go by the rows: what a task holds without spilling
LEAST_BUCKETS, MOST_BUCKETS = 8, 100_000
ROWS_AT_ONCE = 300_000_000  # of a table published by month; beyond, buckets are written in turns
MOST_TURNS = 8  # as the source is read in each


def read_measures(
    spark: SparkSession, path: str, format: str = "parquet", trimmed: bool = False, **options: str
) -> DataFrame:
    """A measure table from files, with adapted column names and levels.

    Store names are text, whatever they look like, without blanks at the ends. Spark takes
    names that are all digits for numbers where it guesses a type, as for the partitions of a
    published table: these are read again as text, so that `001` and `1` stay two stores. Say
    `trimmed` of files whose names have no blanks at the ends: any filter by store then skips
    parts of them. Otherwise `one_store` does.
    """

    def load(reader: DataFrameReader) -> DataFrame:
        return reader.format(format).options(**options).load(path)

    return clean_stores(adapt_levels(adapt_columns(with_text_stores(spark, load))), trimmed)


def with_text_stores(spark: SparkSession, load: Callable[[DataFrameReader], DataFrame]) -> DataFrame:
    """What `load` reads, read again with the names of stores as text if Spark guessed a number."""
    raw = load(spark.read)
    names = [c for c in raw.columns if catalog.SOURCE_COLUMNS.get(c, c) == "store"]
    if all(isinstance(raw.schema[c].dataType, StringType) for c in names):
        return raw
    fields = [StructField(f.name, StringType()) if f.name in names else f for f in raw.schema]
    return load(spark.read.schema(StructType(fields)))


def clean_stores(df: DataFrame, trimmed: bool = False) -> DataFrame:
    """Store names as text without blanks at the ends.

    The name as it is stored stays below the projection, where `one_store` finds it.
    """
    if "store" not in df.columns:
        return df
    if trimmed:
        is_text = isinstance(df.schema["store"].dataType, StringType)
        return df if is_text else df.withColumn("store", F.col("store").cast("string"))
    name = strip_space(F.col(STORED_NAME)).alias("store", metadata={"stored_as": STORED_NAME})
    held = df.withColumn(STORED_NAME, F.col("store").cast("string"))
    return held.select(*(name if c == "store" else F.col(f"`{c}`") for c in df.columns))


def one_store(df: DataFrame, store: str) -> DataFrame:
    """Rows of one store, asked for so that the file scan can skip parts.

    A scan can not use a condition on a trimmed name. So a weaker one on the name as it is
    stored comes first: it holds the name asked for, and begins with it or with what may be a
    blank, which is below `!` or outside of ASCII. It reaches the scan, whose row groups have
    least and largest names. Where the stored name is out of reach, as after a grouping, the
    exact condition is all there is.
    """
    name = store.strip()
    if name and "store" in df.columns and "stored_as" in df.schema["store"].metadata:
        stored = F.col(STORED_NAME)
        blank_first = (stored < "!") | (stored >= "\u0080")
        try:
            df = df.filter(stored.contains(name) & (stored.startswith(name) | blank_first))
        except AnalysisException:
            pass  # joined or grouped since it was read
    return df.filter(F.col("store") == name)


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    predicates: list[str],
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """A measure table from a database, one partition per predicate (such as one month each)."""
    raw = spark.read.jdbc(url, table, predicates=predicates, properties=properties or {})
    return clean_stores(adapt_levels(adapt_columns(raw)))


def scan_store(df: DataFrame, store: str) -> DataFrame:
    """All columns of one store, sorted. The filter reaches the scan."""
    return sorted_scan(one_store(df, store))


def scan_store_projected(df: DataFrame, store: str) -> DataFrame:
    """The twelve columns of the table with totals for one store, sorted."""
    table = require_columns(df, REQUIRED_STRICT).select(*REQUIRED_STRICT)
    return sorted_scan(one_store(table, store))


def distinct_stores(df: DataFrame) -> DataFrame:
    """Store names, trimmed, without NULLs and blanks, in order.

    Names are made distinct as stored first, so few of them are trimmed.
    """
    stored = df.select("store").filter(F.col("store").isNotNull()).distinct()
    name = strip_space(F.col("store"))
    # Blanks are found by an aggregate, as a filter would move down and trim every row.
    return (
        stored.groupBy(name.alias("name"))
        .agg(F.max(name != "").alias("named"))
        .filter("named")
        .select(F.col("name").alias("store"))
        .orderBy("store")
    )


def publish(
    df: DataFrame,
    path: str | None = None,
    table: str | None = None,
    mode: str = "errorifexists",
) -> None:
    """Write a measure table partitioned by store, to `path` and/or as catalog table `table`.

    The rebalance step gives each store whole files and splits the big stores over many
    tasks, so neither one task per store nor one file per store and task comes out.
    """
    if path is None and table is None:
        raise ValueError("publish needs a path or a table name")
    writer = (
        df.withColumn("store", strip_space(F.col("store")))
        .hint("rebalance", "store")
        .sortWithinPartitions("store", "month", "level", "measure")
        .write.mode(mode)
        .format("parquet")
        .partitionBy("store")
    )
    if table is None:
        writer.save(path)
    elif path is None:
        writer.saveAsTable(table)
    else:
        writer.option("path", path).saveAsTable(table)


def publish_by_month(
    df: DataFrame,
    table: str,
    buckets: int | None = 200,
    path: str | None = None,
    mode: str = "errorifexists",
    most_rows: int = MOST_ROWS,
) -> None:
    """Write a measure table as catalog table `table`, in buckets by store and month.

    All rows of a store's month are in one bucket, so their distinct rows, their totals and the
    way back of the totals need no shuffle (see `measures_with_totals`). A task reads a bucket,
    so `buckets` should be the table's size by what a task can hold; None takes one for every
    `ROWS_A_BUCKET` rows. A store's month is never split: one of more than `most_rows` rows is
    refused, as its bucket would be one long task; `publish` has no such bound.

    Of more than `ROWS_AT_ONCE` rows some buckets are written after the others, so that the disks
    hold the shuffle of a part of the rows at a time. `df` is read again for each of up to
    `MOST_TURNS` turns and must give the same rows. The table is there when all are written. What
    is added to a table, or replaces one at a given path, is written at once.
    """
    spark = df.sparkSession
    rows = df.withColumn("store", strip_space(F.col("store").cast("string")))
    with shuffles_dropped(spark):
        sizes = rows.groupBy("store", "month").count()
        hottest, count = sizes.agg(F.max("count"), F.sum("count")).first()
        if (hottest or 0) > most_rows:
            raise ValueError(
                f"a store's month has {hottest} rows, more than {most_rows}: use publish"
            )
        if buckets is None:
            buckets = min(max(LEAST_BUCKETS, -(-(count or 0) // ROWS_A_BUCKET)), MOST_BUCKETS)
        turns = min(-(-(count or 0) // ROWS_AT_ONCE), MOST_TURNS, buckets)
        there = turns > 1 and spark.catalog.tableExists(table)
        if turns <= 1 or (there and (mode.lower() != "overwrite" or path is not None)):
            _write_buckets(rows, table, buckets, path, mode)
            return
        unfinished = f"{table[:-1]}_unfinished`" if table.endswith("`") else f"{table}_unfinished"
        spark.sql(f"DROP TABLE IF EXISTS {unfinished}")
        # The number that Spark gives a bucket, so that each is written in one turn.
        turn = F.pmod(F.hash("store", "month"), F.lit(buckets)) % turns
        try:
            for number in range(turns):
                some = rows.filter(turn == number)
                _write_buckets(some, unfinished, buckets, path, "append" if number else mode)
            if there:
                spark.sql(f"DROP TABLE {table}")
            spark.sql(f"ALTER TABLE {unfinished} RENAME TO {table}")
        except BaseException:
            spark.sql(f"DROP TABLE IF EXISTS {unfinished}")
            raise


def _write_buckets(
    rows: DataFrame, table: str, buckets: int, path: str | None, mode: str
) -> None:
    """Rows as a table in buckets. One task writes a bucket, so there is one file for each."""
    writer = (
        rows.repartition(buckets, "store", "month")
        .write.mode(mode)
        .format("parquet")
        .bucketBy(buckets, "store", "month")
        .sortBy("store", "month")
    )
    (writer if path is None else writer.option("path", path)).saveAsTable(table)


def published_stores(spark: SparkSession, path: str) -> DataFrame:
    """Store names of a table that `publish` wrote, from its listing of partitions: no file is opened.

    The same rows as `distinct_stores` gives for it.
    """
    setting = "spark.sql.optimizer.metadataOnly"
    before = spark.conf.get(setting, None)
    table = with_text_stores(spark, lambda reader: reader.parquet(path)).select("store")
    spark.conf.set(setting, "true")
    try:
        # One row per partition folder, all of which the driver has listed to read the table.
        listed = table.distinct().collect()
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)
    return distinct_stores(spark.createDataFrame(listed, table.schema))


def read_footers(spark: SparkSession, path: str) -> DataFrame:
    """A table that `publish` wrote, whose counts and extremes Spark takes from file footers.

    Only aggregates without a filter on rows, by store or over all, are answered in this way.
    """
    source, push = "spark.sql.sources.useV1SourceList", "spark.sql.parquet.aggregatePushdown"
    before = spark.conf.get(source)
    spark.conf.set(push, "true")
    spark.conf.set(source, ",".join(s for s in before.split(",") if s.strip() != "parquet"))
    try:
        return with_text_stores(spark, lambda reader: reader.parquet(path))
    finally:
        spark.conf.set(source, before)


def publish_view(df: DataFrame, name: str) -> DataFrame:
    """Make `df` available to SQL under `name` in this session."""
    df.createOrReplaceTempView(name)
    return df


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors reach, as the cluster names it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("spark.checkpoint.dir is not set; give a folder all executors reach")
    return folder.rstrip("/")


def load_once(
    spark: SparkSession,
    table: str,
    make: Callable[[], DataFrame],
    refresh: bool = False,
    folder: str | None = None,
    max_age: float | None = None,
    keep_for: float = versions.KEEP_FOR,
) -> DataFrame:
    """A table that is made once and then read, until it is older than `max_age` seconds.

    `refresh` makes it anew at once. Its files are in the shared folder, so a lost executor takes
    nothing with it and the steps that made it are not run again. Every load is a version of its
    own beside the others, and counts only when all of it was written: a broken-off refresh
    leaves the version before in place. Queries that began on a version that was replaced go on
    reading it; its files go `keep_for` seconds after they were replaced, when the next version
    is made.
    """
    home = f"{folder or shared_folder(spark)}/{table}"
    found = versions.current(spark, home)
    stale = max_age is not None and found is not None and time.time() - found.made > max_age
    if refresh or stale or found is None:
        found = versions.add(spark, home, lambda path: publish(make(), path))
        versions.drop_replaced(spark, home, keep_for)
    path = found.path
    return with_text_stores(spark, lambda reader: reader.parquet(path))


def reload(spark: SparkSession, table: str) -> DataFrame:
    """A catalog table as it is now, forgetting cached file listings and data."""
    spark.catalog.refreshTable(table)
    return spark.table(table)
