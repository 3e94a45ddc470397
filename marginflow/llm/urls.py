"""URL filters: dated list entries as validity intervals, joined to captures as of fetch time.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"
HOST = SCHEME + r"(?:[^/?#@]*@)?([^/?#:@]+)"
FOREVER = "9999-12-31"
KINDS = ("url", "host", "domain")  # from the most to the least specific


def host_of(url: Column) -> Column:
    """Host in lower case without a final dot; null if there is none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.+$", "")
    return F.when(host != "", host)


def plain_url(url: Column) -> Column:
    """URL without scheme, query, fragment and final slashes, host and path in lower case."""
    bare = F.regexp_replace(F.regexp_replace(url, SCHEME, ""), r"[?#][\s\S]*$", "")
    return F.lower(F.regexp_replace(bare, r"/+$", ""))


def domains_of(host: Column) -> Column:
    """The host and its parent domains of two labels or more."""
    labels = F.split(host, r"\.")
    return F.when(
        F.size(labels) >= 2,
        F.transform(
            F.sequence(F.lit(1), F.size(labels) - 1),
            lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
        ),
    ).otherwise(F.array().cast("array<string>"))


def validity(entries: DataFrame) -> DataFrame:
    """Entries (`kind`, `pattern`, `action`, `day`, `category`) to intervals `since` to `until`.

    An `add` holds from its day until the next entry of its pattern, which may renew, change
    or `remove` it. Of several entries of a pattern on a day one counts: an `add` before a
    `remove`, then the greatest category. Entries with a null kind, pattern, action or day, or
    an unknown kind or action, are void. Patterns compare in lower case. Repeated entries are
    put together first, so a window holds a pattern's distinct days at most.
    """
    known = entries.filter(
        F.col("kind").isin(*KINDS)
        & F.col("action").isin("add", "remove")
        & F.col("pattern").isNotNull()
        & F.col("day").isNotNull()
    )
    one = known.groupBy("kind", F.lower("pattern").alias("pattern"), "day").agg(
        F.max(F.struct((F.col("action") == "add").alias("on"), "category")).alias("e")
    )
    later = Window.partitionBy("kind", "pattern").orderBy("day")
    return (
        one.withColumn("until", F.coalesce(F.lead("day").over(later), F.lit(FOREVER).cast("date")))
        .filter("e.on")
        .select(
            "kind",
            "pattern",
            F.col("day").alias("since"),
            "until",
            F.col("e.category").alias("category"),
        )
    )


def _as_of(probes: DataFrame, intervals: DataFrame) -> DataFrame:
    """Probes (`kind`, `pattern`, `_day`, ...) with the one interval that holds on their day."""
    return probes.join(intervals, ["kind", "pattern"]).filter(
        (F.col("since") <= F.col("_day")) & (F.col("_day") < F.col("until"))
    )


def filter_urls(
    captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched"
) -> DataFrame:
    """Every capture with `blocked` and the entry that held when it was fetched.

    New columns: `host`, `blocked`, `kind`, `pattern`, `category`, `since`; input columns of
    these names are replaced. Of several entries that hold, the most specific counts: the URL,
    then the host, then the longest domain. Hosts are looked up once per host and day, so
    captures of a hot host meet the list as a few rows; the way back to the captures is a
    join that adaptive execution splits.

    A null or malformed URL has no host and is not blocked; nor is a capture without a fetch
    day. Repeated captures all stay. A long URL is one key. Without entries nothing is
    blocked; without captures there are no rows.
    """
    made = {"host", "blocked", "kind", "pattern", "category", "since"}
    kept = [c for c in captures.columns if c.lower() not in made]
    rows = captures.select(
        F.struct(*kept).alias("row"),
        F.col(fetched).cast("date").alias("_day"),
        host_of(F.col(url)).alias("_host"),
        plain_url(F.col(url)).alias("_url"),
    )
    intervals = validity(entries)
    hosts = rows.select("_host", "_day").filter(
        F.col("_host").isNotNull() & F.col("_day").isNotNull()
    )
    probes = hosts.distinct().select(
        "_host",
        "_day",
        F.explode(
            F.concat(
                F.array(F.struct(F.lit("host").alias("kind"), F.col("_host").alias("pattern"))),
                F.transform(
                    domains_of(F.col("_host")),
                    lambda d: F.struct(F.lit("domain").alias("kind"), d.alias("pattern")),
                ),
            )
        ).alias("p"),
    )
    found = _as_of(probes.select("_host", "_day", "p.*"), intervals)
    # The join key is made after the grouping, so that the join has a shuffle of its own.
    by_host = (
        found.groupBy("_host", "_day")
        .agg(
            F.max_by(
                F.struct("kind", "pattern", "category", "since"),
                F.struct((F.col("kind") == "host").alias("exact"), F.length("pattern")),
            ).alias("_by_host")
        )
        .select(F.concat_ws(" ", "_day", "_host").alias("_key"), "_by_host")
    )
    by_url = intervals.filter("kind = 'url'").select(
        F.col("pattern").alias("_pattern"),
        F.col("since").alias("_since"),
        F.col("until").alias("_until"),
        F.struct("kind", "pattern", "category", "since").alias("_by_url"),
    )
    with_host = rows.withColumn(
        "_key", F.when(F.col("_host").isNotNull(), F.concat_ws(" ", "_day", "_host"))
    ).join(by_host, "_key", "left")
    joined = with_host.join(
        by_url,
        (F.col("_url") == F.col("_pattern"))
        & (F.col("_since") <= F.col("_day"))
        & (F.col("_day") < F.col("_until")),
        "left",
    )
    hit = F.coalesce("_by_url", "_by_host")
    return joined.select(
        "row.*",
        F.col("_host").alias("host"),
        hit.isNotNull().alias("blocked"),
        *(hit.getField(c).alias(c) for c in ("kind", "pattern", "category", "since")),
    )


def derived_captures(pages: DataFrame) -> DataFrame:
    """Pages with a fetch day, which the table lacks: a day of 2024 by page id."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int"))
    return pages.select("page_id", "url", day.alias("fetched"))


def derived_entries(pages: DataFrame) -> DataFrame:
    """A dated list made from the hosts and URLs of the pages by their digests.

    Hosts of gambling and pill shops and every fourth other host are listed, as a host or as
    the domain above it, most of them removed after 45 days and half listed again after 90.
    One URL in 64 is listed by itself.
    """
    start = F.lit("2024-01-01").cast("date")

    def entry(kind, pattern, action, day, category):
        return F.struct(
            kind.alias("kind"),
            pattern.alias("pattern"),
            F.lit(action).alias("action"),
            F.date_add(start, day.cast("int")).alias("day"),
            category.alias("category"),
        )

    h = F.md5("host")
    number = F.conv(F.substring(h, 3, 2), 16, 10).cast("int")
    labels = F.split("host", r"\.")
    parent = F.array_join(F.slice(labels, 2, F.size(labels)), ".")
    as_host = (F.substring(h, 2, 1) < "8") | (F.size(labels) < 4)
    kind = F.when(as_host, F.lit("host")).otherwise(F.lit("domain"))
    pattern = F.when(as_host, F.col("host")).otherwise(parent)
    category = F.when(F.substring(h, 7, 1) < "8", F.lit("spam")).otherwise(F.lit("adult"))
    hosts = pages.select(host_of(F.col("url")).alias("host")).distinct()
    listed = hosts.filter(F.col("host").rlike("casino|bets|pills") | (F.substring(h, 1, 1) < "4"))
    by_host = listed.select(
        F.explode(
            F.filter(
                F.array(
                    entry(kind, pattern, "add", number, category),
                    F.when(
                        F.substring(h, 5, 1) < "c",
                        entry(kind, pattern, "remove", number + 45, category),
                    ),
                    F.when(
                        F.substring(h, 6, 1) < "8",
                        entry(kind, pattern, "add", number + 90, category),
                    ),
                ),
                lambda e: e.isNotNull(),
            )
        ).alias("e")
    )
    u = F.md5("u")
    by_url = (
        pages.select(plain_url(F.col("url")).alias("u"))
        .filter((F.substring(u, 1, 1) == "0") & (F.substring(u, 2, 1) < "4"))
        .distinct()
        .select(
            entry(
                F.lit("url"),
                F.col("u"),
                "add",
                F.conv(F.substring(u, 3, 2), 16, 10),
                F.lit("single"),
            ).alias("e")
        )
    )
    return by_host.union(by_url).select("e.*")
