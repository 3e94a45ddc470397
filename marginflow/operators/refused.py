"""Amounts that no sum can hold: set aside, listed with their rows, and counted per report.

`coerce_value` fails on a number of 1e14 or more. One such cell in a large table would end a run.
These operators take the rows out first, keep them as a table of their own, and mark every
report that lacks some, so the run goes on and no sum is wrong without a word.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginflow.functions import is_refused
from marginflow.operators.cells import SCOPE, in_report
from marginflow.operators.periods import with_scope
from marginflow.plans.joins import join_small


class SetAside(NamedTuple):
    """`accepted` and `refused` have all rows between them, each row in one."""

    accepted: DataFrame
    refused: DataFrame


def set_aside(df: DataFrame) -> SetAside:
    """Rows whose value can be summed, and the others with a `reason`.

    Text that is no number is accepted, as it counts 0 or NULL in every sum. Both are filters of
    `df`: rows do not move.
    """
    value = F.col("value")
    infinite = F.abs(value.try_cast("double")) == F.lit(float("inf"))
    reason = F.when(infinite, "infinite").otherwise("out of range")
    return SetAside(
        df.filter(~is_refused(value)), df.filter(is_refused(value)).withColumn("reason", reason)
    )


def refused_counts(df: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    """How many rows each report lacks: (*scope, `n_refused`), for reports that lack some."""
    refused = set_aside(in_report(with_scope(df, scope), scope)).refused
    return refused.groupBy(*scope).agg(F.count(F.lit(1)).alias("n_refused"))


def with_refused(result: DataFrame, df: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    """`result`, made from the accepted rows of `df`, with `n_refused` of each row's report.

    0 stands for sums that are whole. Reports all of whose rows were refused have no row in
    `result`; `refused_counts` has them.
    """
    counted = join_small(result, refused_counts(df, scope), list(scope), "left")
    return counted.withColumn("n_refused", F.coalesce("n_refused", F.lit(0)).cast("long"))
