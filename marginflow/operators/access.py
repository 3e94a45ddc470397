"""Who may see which stores and periods.

Entitlements are rows of user level and store, `*` standing for all stores. The periods a
level may look at are fixed (see the catalog).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginflow import catalog
from marginflow.functions import strip_space
from marginflow.operators.periods import period_titles
from marginflow.plans.joins import join_small


def clamp_level(level: Column) -> Column:
    """User level within 1..3; missing is 1."""
    low, high = F.lit(catalog.USER_LEVELS[0]), F.lit(catalog.USER_LEVELS[-1])
    return F.greatest(low, F.least(high, F.coalesce(level.cast("int"), low)))


def effective_levels(users: DataFrame) -> DataFrame:
    """Users with the level that counts."""
    return users.withColumn("user_level", clamp_level(F.col("security_level")))


def stores_for(df: DataFrame, entitlements: DataFrame, user_level: int) -> DataFrame:
    """Rows one user level may see."""
    mine = entitlements.filter(clamp_level(F.col("user_level")) == user_level)
    return entitled_rows(df, mine).drop("user_level")


def entitled_rows(df: DataFrame, entitlements: DataFrame) -> DataFrame:
    """Rows each user level may see, once per level.

    The levels of a store come by equi-join, those with all stores as one scalar; there are
    three levels, so both lists are short. No row is compared with every entitlement.
    """
    # Three levels at most, whatever the entitlements say, so the sets below stay short.
    pairs = entitlements.select(
        clamp_level(F.col("user_level")).alias("user_level"),
        strip_space(F.col("store")).alias("store"),
    )
    named = (
        pairs.filter(F.col("store") != catalog.ALL_STORES)
        .groupBy("store")
        .agg(F.collect_set("user_level").alias("_named"))
    )
    everywhere = (
        pairs.filter(F.col("store") == catalog.ALL_STORES)
        .agg(F.collect_set("user_level").alias("_all"))
        .scalar()
    )
    levels = F.array_union(F.coalesce(F.col("_named"), F.array().cast("array<int>")), everywhere)
    return (
        join_small(df, named, ["store"], "left", keys=pairs)
        .withColumn("user_level", F.explode(levels))
        .drop("_named")
    )


def entitled_grains(df: DataFrame, entitlements: DataFrame) -> DataFrame:
    """Periods each user level may choose, for the stores it may see.

    The grain is checked on the data, not only in what a user is offered.
    """
    allowed = None
    for level, grains in catalog.LEVEL_GRAINS.items():
        test = (F.col("user_level") == level) & F.col("grain").isin(*grains)
        allowed = test if allowed is None else allowed | test
    return (
        entitled_rows(period_titles(df), entitlements)
        .filter(allowed)
        .select("user_level", "store", "grain", "year", "quarter", "month", "title")
    )
