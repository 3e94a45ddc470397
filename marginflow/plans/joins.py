"""Joins of a fact with a small per-key table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_BYTES = 64 * 1024 * 1024
FEW_BYTES = 1024 * 1024
_BYTES_PER_FIELD = 48  # more than a date, a decimal or a short list of levels takes in a row


def byte_bound(keys: DataFrame, extra_fields: int = 0) -> int:
    """Upper bound of the bytes a table of these key rows takes, counted by one cheap job."""
    text = sum(
        (F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in keys.columns),
        F.lit(_BYTES_PER_FIELD * (len(keys.columns) + extra_fields)),
    )
    return keys.agg(F.sum(text.cast("bigint"))).first()[0] or 0


def if_small(small: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`small` for a join by broadcast if these columns, copies too, take little, else as it is.

    A table below `FEW_BYTES` is left to Spark, which broadcasts it unasked.
    """
    bound = byte_bound(small.select(*columns))
    return F.broadcast(small) if FEW_BYTES < bound <= MAX_BROADCAST_BYTES else small


def join_small(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    keys: DataFrame | None = None,
) -> DataFrame:
    """Join `small`, which has one row per key, to `big` without moving `big` if that is safe.

    `small` is broadcast only after its size was counted and found below
    `MAX_BROADCAST_BYTES`. `keys` may give the same keys in a cheaper way than `small`
    itself, so that the count reads the key columns only; it may lack some of them if the
    others tell the rows of `small` apart. Beyond the bound the join is left
    to Spark: a shuffled join in which adaptive execution splits hot keys.
    """
    source = small if keys is None else keys
    probe = source.select(*[c for c in on if c in source.columns]).distinct()
    bound = byte_bound(probe, extra_fields=len(small.columns) - len(probe.columns))
    side = F.broadcast(small) if bound <= MAX_BROADCAST_BYTES else small
    return big.join(side, list(on), how)
