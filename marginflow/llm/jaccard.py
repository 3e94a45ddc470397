"""N-gram Jaccard join of documents: MinHash banding, then verification on full n-gram sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginflow.llm.frames import WORD, explode_batches, own_shuffle, saved, slices
from marginflow.llm.hashing import Words, bands, shingle_sets, tune
from marginflow.llm.links import NO_RANK, class_links, linked_components, pack

WIDTH = 5  # words of an n-gram
PERCENT = 80  # least similarity
ROWS = 5  # minima joined in a band
RECALL = 0.999  # chance that a pair at the least similarity shares a band
SLICE_BYTES = 512 * 1024  # a slice's arrays have eight bytes and more for each byte of text


def text_id(text: Column) -> Column:
    """Digest by which equal texts are put together."""
    return F.sha2(text, 256)


def signatures(docs: DataFrame, text: str, width: int, rows: int, n_bands: int) -> DataFrame:
    """`docs` (`doc_id`, text) to (`digest`, `doc_id`, `size`, `keys`); no row without words.

    `size` is the number of n-grams with repeats, `keys` are the band hashes.
    """

    def compute(batch: pa.RecordBatch) -> Iterator[dict]:
        texts = batch.column(batch.schema.get_field_index("_text"))
        for start, end in slices(texts, SLICE_BYTES):
            words = Words(texts.slice(start, end - start))
            values, starts = shingle_sets(words, width)
            some = np.flatnonzero(np.diff(starts))
            keys = bands(rows, n_bands, values, starts)[some].astype(np.int64)
            pick = pa.array(some + start)
            yield {
                "digest": batch.column(batch.schema.get_field_index("digest")).take(pick),
                "doc_id": batch.column(batch.schema.get_field_index("doc_id")).take(pick),
                "size": pa.array(np.diff(starts)[some]),
                "keys": pa.ListArray.from_arrays(
                    pa.array(np.arange(len(some) + 1, dtype=np.int32) * n_bands),
                    pa.array(keys.ravel()),
                ),
            }

    rows_in = docs.select(
        text_id(F.col(text)).alias("digest"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col(text).alias("_text"),
    )
    return explode_batches(
        rows_in, "digest string, doc_id long, size long, keys array<long>", compute
    )


def packed_sets(rows: DataFrame, width: int) -> DataFrame:
    """(`item`, `text`) to members for `linked_components` with their n-gram sets."""

    def compute(batch: pa.RecordBatch) -> Iterator[dict]:
        texts = batch.column(batch.schema.get_field_index("text"))
        for start, end in slices(texts, SLICE_BYTES):
            part = batch.slice(start, end - start)
            words = Words(texts.slice(start, end - start))
            values, starts = shingle_sets(words, width)
            item = part.column(part.schema.get_field_index("item"))
            yield {
                "item": item,
                "rank": item,
                "place": pa.array(np.zeros(end - start, dtype=np.int64)),
                "values": [
                    pack(values[starts[i] : starts[i + 1]]) for i in range(end - start)
                ],
            }

    return explode_batches(rows, "item long, rank long, place long, values binary", compute)


def text_classes(
    docs: DataFrame, width: int, percent: int, rows: int, recall: float, counted: bool = True
) -> DataFrame:
    """One row per different text of `docs` (`doc_id`, `text`) that has words.

    (`digest`, `first_id`, `weight`, `class_id`, `leads`): the smallest id that has the text, how
    many rows have it, its class, and whether it is the first text of its class. If `counted`, also
    `rep_id`, the smallest id of a text that it is linked to, and `n_links` of each of these rows.
    """
    n_bands = tune(percent / 100, recall, rows)
    texts = (
        signatures(docs, "text", width, rows, n_bands)
        .groupBy("digest")
        .agg(
            F.min("doc_id").alias("first_id"),
            F.count(F.lit(1)).alias("weight"),
            F.first("keys").alias("keys"),
        )
    )
    texts = saved(texts.withColumn("item", F.xxhash64("digest")))
    keys = texts.select(
        "item", F.explode("keys").alias("key"), F.col("item").alias("rank"), F.lit(0).cast("long").alias("place")
    )

    def fetch(items: DataFrame) -> DataFrame:
        chosen = items.join(texts.select("item", "digest", "first_id"), "item")
        bodies = docs.select("doc_id", "text", text_id(F.col("text")).alias("_digest"))
        # One copy of each text, the one with the smallest id: copies go to different tasks.
        near = bodies.join(
            chosen,
            (bodies["_digest"] == chosen["digest"])
            & bodies["doc_id"].eqNullSafe(chosen["first_id"]),
        )
        return packed_sets(near.select("item", "text"), width)

    linked_items, members = linked_components(keys, fetch, percent)
    # A class is named by the smallest document id in it; texts without an id come last.
    firsts = texts.select(F.col("item").alias("node"), "first_id", "digest")
    named = linked_items.join(firsts, "node")
    first = F.struct(F.col("first_id").isNull().alias("no_id"), "first_id", "digest")
    leaders = named.groupBy("component").agg(F.min(first).alias("leader"))
    classes = linked_items.join(
        leaders.select(own_shuffle("component").alias("_component"), "leader"),
        F.col("component") == F.col("_component"),
    ).select(F.col("node").alias("item"), "leader")
    named_texts = (
        texts.join(classes, "item", "left")
        .select(
            "item",
            "digest",
            "first_id",
            "weight",
            F.when(F.col("leader").isNull(), F.col("first_id"))
            .otherwise(F.col("leader.first_id"))
            .alias("class_id"),
            F.coalesce(F.col("leader.digest") == F.col("digest"), F.lit(True)).alias("leads"),
        )
    )
    if not counted:
        return named_texts.drop("item")
    weights = texts.select(
        own_shuffle("item").alias("_text"),
        F.coalesce("first_id", F.lit(NO_RANK)).alias("rank"),
        F.col("weight").alias("place"),
    )
    sets = members.select("item", "values").join(weights, F.col("item") == F.col("_text")).drop("_text")
    in_classes = linked_items.select(F.col("node").alias("item"), F.col("component").alias("class"))
    per_item = class_links(in_classes, sets, percent).select(
        own_shuffle("item").alias("_linked"), "links", F.expr(f"nullif(rep, {NO_RANK})").alias("rep")
    )
    return named_texts.join(per_item, F.col("item") == F.col("_linked"), "left").select(
        "digest",
        "first_id",
        "weight",
        "class_id",
        F.when(F.col("links").isNull(), F.col("first_id")).otherwise(F.col("rep")).alias("rep_id"),
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"),
        "leads",
    )


def jaccard_groups(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    width: int = WIDTH,
    percent: int = PERCENT,
    rows: int = ROWS,
    recall: float = RECALL,
) -> DataFrame:
    """Every document (`doc_id`) with `class_id`, `n_links` and `rep_id`.

    Two documents are linked if the Jaccard similarity of their sets of `width`-word n-grams
    is `percent` / 100 or more. `class_id` is the smallest document id that can be reached over
    links; a document without links is its own class. Words are as they stand; a text of 1 to 4
    words has all its words as its only n-gram.

    Equal texts are one item. To find the classes, texts of a crowd of near copies are compared with
    representatives, and texts of different classes that share a band with each other. Then every
    two texts of a class are compared, in blocks, without a row for a pair: `n_links` counts all
    documents that the document is linked to, its equal copies among them. `rep_id` is the
    smallest id of a text it is linked to, or that of its own text if there is none. The number of
    bands follows from the recall wanted at the least similarity; which texts share a band is
    found exactly in all buckets, and pairs are verified on their full sets (64-bit hashes of the
    n-grams).

    Null, empty and blank texts have no n-grams: no links and a class of their own. A null id
    names no class, but is in one like any other; a class of null ids alone is null. Rows that
    repeat an id and a text count as documents of their own. Other columns do not matter. An
    empty table gives no rows.
    """
    renamed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    verdicts = text_classes(renamed, width, percent, rows, recall).select(
        F.concat(F.lit("="), "digest").alias("_digest"), "class_id", "n_links", "rep_id"
    )
    # By the text alone, as every copy needs its class; a hot text is split where it is joined.
    return (
        renamed.select("doc_id", F.concat(F.lit("="), text_id(F.col("text"))).alias("_digest"))
        .join(verdicts, "_digest", "left")
        .select(
            "doc_id",
            F.coalesce("class_id", "doc_id").alias("class_id"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("rep_id", "doc_id").alias("rep_id"),
        )
    )


def keep_one(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    width: int = WIDTH,
    percent: int = PERCENT,
    rows: int = ROWS,
    recall: float = RECALL,
) -> DataFrame:
    """One document of each class of `jaccard_groups`, with the columns it came with.

    It is the one with the smallest id; of rows that repeat its id and text one stays. Every
    document without words stays.
    """
    renamed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    kept = (
        text_classes(renamed, width, percent, rows, recall, counted=False)
        .filter("leads")
        .select("digest", "first_id", F.lit(True).alias("kept"))
    )
    body = F.col(text)
    rows_in = docs.select(
        F.struct(*docs.columns).alias("row"),
        text_id(body).alias("digest"),
        F.col(doc_id).cast("long").alias("id"),
        F.coalesce(~body.rlike(WORD), F.lit(True)).alias("wordless"),
    )
    joined = rows_in.join(
        kept.withColumnRenamed("digest", "_digest"),
        (F.col("digest") == F.col("_digest")) & F.col("id").eqNullSafe(F.col("first_id")),
        "left",
    )
    same = Window.partitionBy("digest", "id").orderBy(F.lit(1))
    stays = F.col("kept") & (F.row_number().over(same) == 1)
    return (
        joined.withColumn("stays", F.coalesce(F.col("wordless") | stays, F.lit(False)))
        .filter("stays")
        .select("row.*")
    )
