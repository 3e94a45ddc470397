"""Contiguous shards of near-equal bytes, cut from global prefix sums."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from marginflow.llm.frames import ship_code, stored

EVERY = (Window.unboundedPreceding, Window.unboundedFollowing)


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text plus one for its end; a null text is only its end."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def running_sums(rows: DataFrame, size: str) -> DataFrame:
    """Rows with `_range` (partition), and `_sum1` and `_rows1` before them in their partition."""
    names = {"_range": T.IntegerType(), "_sum1": T.LongType(), "_rows1": T.LongType()}
    schema = T.StructType([*rows.schema, *(T.StructField(k, v) for k, v in names.items())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, total, n = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            sizes = batch.column(batch.schema.get_field_index(size)).to_numpy()
            sums = total + np.cumsum(sizes)
            made = [
                pa.array(np.full(len(sizes), here, dtype=np.int32)),
                pa.array(sums - sizes),
                pa.array(n + np.arange(len(sizes), dtype=np.int64)),
            ]
            if len(sizes):
                total, n = int(sums[-1]), n + len(sizes)
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], schema=arrow)

    ship_code(rows.sparkSession)
    return rows.mapInArrow(run, schema)


def prefix_sums(
    rows: DataFrame, order: Sequence[str | Column], size: str, partitions: int | None = None
) -> DataFrame:
    """Each row with its place in the global order.

    `_before` has the sizes before it, `_at` the rows before it, `_total` all sizes.
    Rows are dealt into ranges of the order, sorted there, summed up as they pass, and written
    out, so that all later steps and any task run again see the same ranges. Rows move once.
    Only the totals of ranges, one row each, meet in one task. The order should end in a key
    that few rows share: rows that are equal in it all cannot be dealt to different ranges.
    """
    spark = rows.sparkSession
    n = partitions or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    names = [f"_order_{i}" for i in range(len(keys))]
    keyed = rows.select("*", *(k.alias(name) for k, name in zip(keys, names)))
    sorted_rows = keyed.repartitionByRange(n, *names).sortWithinPartitions(*names).drop(*names)
    dealt = stored(running_sums(sorted_rows, size))
    totals = dealt.groupBy("_range").agg(
        F.sum(size).alias("_sum"), F.count(F.lit(1)).alias("_rows")
    )
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_range",
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_sum0"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows0"),
        F.sum("_sum").over(Window.orderBy("_range").rowsBetween(*EVERY)).alias("_total"),
    )
    # One row per range: its number is set above, whatever the size of the table.
    return (
        dealt.join(F.broadcast(offsets), "_range")
        .withColumn("_before", F.col("_sum0") + F.col("_sum1"))
        .withColumn("_at", (F.col("_rows0") + F.col("_rows1")).cast("long"))
        .drop("_range", "_sum0", "_sum1", "_rows0", "_rows1")
    )


def cut(rows: DataFrame, size: str, shards: int) -> DataFrame:
    """`prefix_sums` rows with `shard` and `slot`, their place in it.

    A row belongs to the shard in which its middle byte lies, so a shard differs from an
    equal share by half a row at each end at most.
    """
    middle = F.col("_before").cast("decimal(38,0)") * 2 + F.col(size)
    shard = F.least(
        F.floor(middle * shards / (F.col("_total").cast("decimal(38,0)") * 2)), F.lit(shards - 1)
    )
    placed = rows.withColumn("shard", shard.cast("int")).drop("_total")
    first = placed.groupBy("shard").agg(F.min("_at").alias("_first"))
    return (
        placed.join(F.broadcast(first), "shard")
        .withColumn("slot", F.col("_at") - F.col("_first"))
        .drop("_first", "_at", "_before")
    )


def shard(
    docs: DataFrame,
    shards: int = 8,
    text: str = "text",
    doc_id: str = "doc_id",
    carry: Sequence[str] | None = None,
    order: Sequence[Column] | None = None,
) -> DataFrame:
    """Documents dealt to shards 0 to `shards` - 1 of near-equal bytes, in one global order.

    With `order` it is the order of these columns, such as that of a mix. Else it is by a hash of the text and then by document id, so that equal texts lie side
    by side and at most `shards` - 1 groups of them are cut, and a hot text is still spread
    over many tasks. Only id, size and checksum are sorted; with `carry` (default: all other
    columns) these go along. New columns: `size`, `text_crc32`, `shard`, `slot` (0, 1, ... in
    each shard); input columns of these names are replaced. A null text has size 1 and
    checksum 0, like an empty one, and sorts first. Rows that are equal in id
    and text get neighbouring slots in either order. A document is never split, however long.
    An empty table gives no rows.
    """
    made = {"size", "text_crc32", "shard", "slot"}
    others = docs.columns if carry is None else carry
    others = [c for c in others if c.lower() not in made and c != doc_id]
    body = F.col(text)
    by = [F.when(body.isNotNull(), F.xxhash64(body))] if order is None else order
    keys = [f"_key{i}" for i in range(len(by))]
    rows = docs.select(
        F.struct(doc_id, *others).alias("row"),
        text_size(body).alias("size"),
        F.coalesce(F.crc32(body.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        *(k.alias(name) for k, name in zip(by, keys)),
    )
    last = [] if order is not None else ["text_crc32", F.col("row").getField(doc_id)]
    placed = cut(prefix_sums(rows, [*keys, *last], "size"), "size", shards)
    return placed.select("row.*", "size", "text_crc32", "shard", "slot")


def digest(docs: DataFrame, shards: int = 8) -> DataFrame:
    """The contract's columns of the placement: without texts, with the law it obeys."""
    placed = shard(docs, shards, carry=[])
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast(T.IntegerType()).alias("grown_shard"),
    )
