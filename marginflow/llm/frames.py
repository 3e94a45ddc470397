"""Helpers the operators share: Arrow passes over rows, row digests, work folders."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Words are runs of anything but ASCII white space.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

_SHIPPED: set[str] = set()  # ids of the applications that have the package


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


BATCH_BYTES = 4 * 1024 * 1024  # of a batch that goes to or from a Python worker, or one longer row
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship_code(spark: SparkSession) -> None:
    """Send this package to the workers, once per application, as they run its functions.

    Batches to them hold BATCH_BYTES, unless the application was started with another number: with
    Spark's own 10,000 long texts, each executor keeps several times their bytes.
    """
    context = spark.sparkContext
    if not context.getConf().contains(BATCH_SETTING):
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="run-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """`batch` in parts of about BATCH_BYTES each, as one, if it is not larger."""
    rows = max(1, batch.num_rows * BATCH_BYTES // max(batch.nbytes, BATCH_BYTES))
    for start in range(0, max(1, batch.num_rows), rows):
        yield batch.slice(start, rows)


def append_columns(
    df: DataFrame,
    fields: T.StructType,
    compute: Callable[[pa.RecordBatch], Mapping[str, Sequence]],
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """`df` with the columns `fields`, computed from Arrow batches in the tasks that hold them.

    Only the columns `keep` (default: all) stay; kept columns with the name of a new one give
    way to it. Rows neither move nor change their number.
    """
    new = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    schema = T.StructType([*(df.schema[c] for c in kept), *fields])
    arrow = to_arrow_schema(schema)
    ship_code(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole)):
            made = compute(batch)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            columns += [
                made[f.name] if isinstance(made[f.name], pa.Array)
                else pa.array(made[f.name], type=arrow.field(f.name).type)
                for f in fields
            ]
            yield pa.RecordBatch.from_arrays(
                [c.cast(arrow.field(i).type) for i, c in enumerate(columns)], schema=arrow
            )

    return df.mapInArrow(run, schema)


def explode_batches(
    df: DataFrame,
    schema: str | T.StructType,
    compute: Callable[[pa.RecordBatch], Iterator[Mapping[str, Sequence]]],
) -> DataFrame:
    """Rows made from Arrow batches: `compute` yields dicts of equally long columns."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)
    ship_code(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for made in compute(batch):
                yield pa.RecordBatch.from_arrays(
                    [
                        made[f.name] if isinstance(made[f.name], pa.Array)
                        else pa.array(made[f.name], type=f.type)
                        for f in arrow
                    ],
                    schema=arrow,
                )

    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, decide: Callable[[pa.RecordBatch], Sequence[bool]]) -> DataFrame:
    """The rows for which `decide` says so, batch by batch, in the tasks that hold them."""
    ship_code(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(decide(batch)))

    return df.mapInArrow(run, df.schema)


def slices(texts: pa.Array, max_bytes: int) -> Iterator[tuple[int, int]]:
    """Row ranges with at most `max_bytes` of text each, or with a single longer text."""
    start = used = 0
    for i, size in enumerate(byte_lengths(texts)):
        if i > start and used + size > max_bytes:
            yield start, i
            start, used = i, 0
        used += size
    if start < len(texts):
        yield start, len(texts)


def byte_lengths(texts: pa.Array) -> list[int]:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_pylist()


def work_folder(spark: SparkSession) -> None:
    """Make sure that checkpoints go to a folder that driver and executors share.

    On a cluster that is `spark.checkpoint.dir`. Where it is unset, as in local tests, a new
    folder of this machine is taken.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(
            spark.conf.get("spark.checkpoint.dir", None)
            or tempfile.mkdtemp(prefix="run-", dir=os.environ.get("TMPDIR", "/tmp"))
        )


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is planned and run in here leaves no shuffle files: they go when it is done.

    Otherwise they stay until the driver happens to collect the plans as garbage, and the disks
    hold the shuffles of many steps at a time. Spark before 4.1 does not know the setting.
    """
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """`df` as a table in the shared folder, for results of which later steps read some columns.

    Files are compressed, unlike checkpoints. They stay until they are `dropped` or the folder is
    cleared.
    """
    spark = df.sparkSession
    work_folder(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Remove tables that `stored` has written, when all that was made of them is written too.

    What the driver holds of the steps behind goes as well, plans and bitmaps: Spark frees what it sent
    to executors when the driver collects its garbage, which it else does when its heap has grown.
    """
    for df in tables:
        for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
    if tables:
        tables[0].sparkSession._jvm.System.gc()


def stored_order(df: DataFrame) -> list[Column]:
    """Columns that sort the rows of `df`, read from files, as they were written.

    Spark names files by the number of the partition they were written from, and knows the place
    of each row in its file. Of what was not read from files it is the order of its partitions.
    """
    place = [F.col("_metadata.file_name"), F.col("_metadata.row_index")]
    try:
        df.select(*place)
    except AnalysisException:
        return [F.monotonically_increasing_id()]
    return place


def own_shuffle(key: str) -> Column:
    """The same number as an expression, so that a join on it does not reuse a grouping's shuffle:
    adaptive execution splits hot keys only where both sides are shuffled for the join.
    """
    return F.col(key).bitwiseXOR(F.lit(0).cast("long"))


BITS_A_KEY = 32  # of a bitmap, so that it lets one of 32 other rows through


def may_hold(
    df: DataFrame, keys: Sequence[str], wanted: DataFrame, bits: int = 1 << 25, rows: int | None = None
) -> DataFrame:
    """Rows of `df` whose `keys` may be among those of `wanted`: all that are, and a few others.

    A bitmap of digests, of `bits` / 8 bytes whatever the tables' size, goes to all tasks, so a
    join that follows moves few rows in vain. If `wanted` is known to have no more than `rows`, it is
    smaller for few of them. Where `wanted` has more keys than there are bits this lets most rows
    through and the join still is right.
    """
    if rows is not None:
        bits = min(bits, 1 << max(15, (BITS_A_KEY * rows).bit_length()))
    bit = (F.pmod(F.xxhash64(*keys), F.lit(bits)) + 1).cast("long")
    maps = (
        wanted.select(bit.alias("bit"))
        .groupBy(F.bitmap_bucket_number("bit").alias("_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("_map"))
    )
    numbered = df.withColumn("_bucket", F.bitmap_bucket_number(bit)).withColumn(
        "_place", F.bitmap_bit_position(bit)
    )

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [np.frombuffer(x.as_py(), dtype="<i8") for x in batch.column("_map")]
            yield pa.RecordBatch.from_pydict(
                {
                    "_bucket": batch.column("_bucket"),
                    "_words": pa.array(data, type=pa.list_(pa.int64())),
                }
            )

    # One row of 4 KB for each of bits / 32768 buckets, as numbers whose bits are read in place.
    ship_code(df.sparkSession)
    maps = maps.mapInArrow(words, "_bucket long, _words array<long>")
    held = F.expr("getbit(_words[CAST(_place DIV 64 AS INT)], CAST(_place % 64 AS INT)) = 1")
    return (
        numbered.join(F.broadcast(maps), "_bucket")
        .filter(held)
        .drop("_bucket", "_place", "_words")
    )


def saved(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder: computed once, and read again if an executor is lost."""
    work_folder(df.sparkSession)
    with shuffles_dropped(df.sparkSession):
        return df.select("*").checkpoint()  # planned again, so that the setting holds


SUM_PARTS = 32  # groups of tasks whose arrays are added first


def summed_arrays(
    df: DataFrame, total: Callable[[Iterator[pa.RecordBatch]], np.ndarray], dtype: str
) -> np.ndarray:
    """The sum of the flat arrays, all of one length, that `total` makes of each task's rows.

    Arrays of SUM_PARTS groups of tasks are added first, so no task gets those of all others and
    as many arrays as there are groups come here, whatever the input's size. They are added in
    the order of the tasks, so sums of floats are the same in every run. Without tasks it is empty.
    """
    ship_code(df.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        data = total(batches).astype(dtype).tobytes()
        yield pa.RecordBatch.from_pydict(
            {
                "group": pa.array([part % SUM_PARTS], type=pa.int32()),
                "part": pa.array([part], type=pa.int32()),
                "data": pa.array([data], type=pa.binary()),
            }
        )

    def add(table: pa.Table) -> pa.Table:
        rows = table.sort_by("part")
        first = rows.slice(0, 1)
        out = sum(np.frombuffer(x.as_py(), dtype=dtype) for x in rows.column("data"))
        return first.set_column(2, "data", pa.array([out.tobytes()], type=pa.binary()))

    schema = "group int, part int, data binary"
    groups = df.mapInArrow(count, schema).groupBy("group").applyInArrow(add, schema)
    rows = groups.toArrow().sort_by("group").column("data")
    return sum((np.frombuffer(x.as_py(), dtype=dtype) for x in rows), np.zeros(0, dtype) if not len(rows) else 0)
