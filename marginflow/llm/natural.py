"""Near copies of whole natural paragraphs: MinHash bands, exact Jaccard, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginflow.llm.frames import (
    append_columns,
    dropped,
    explode_batches,
    may_hold,
    own_shuffle,
    slices,
    stored,
)
from marginflow.llm.hashing import Words, bands, mixed, shingles, tune
from marginflow.llm.links import linked_components, pack

ROWS = 4  # minima joined in a band
SLICE_BYTES = 512 * 1024


def natural_parts(words: Words, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First words (over all texts) and numbers of words of the paragraphs, which do not overlap.

    A line of `least` words or more is a paragraph. Shorter lines make one together with those
    beside them, up to the next blank or longer line. Parts of fewer words are none. `words`
    come with their lines.
    """
    n = len(words.hash)
    if n == 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    step = np.diff(words.line)
    starts = np.unique(np.concatenate([words.first[:-1][words.counts > 0], np.flatnonzero(step) + 1]))
    short = np.diff(np.append(starts, n)) < least
    text = np.searchsorted(words.first, starts, side="right")
    goes_on = np.zeros(len(starts), dtype=bool)
    goes_on[1:] = (
        short[1:] & short[:-1] & (text[1:] == text[:-1]) & (step[starts[1:] - 1] == 1)
    )
    begin = starts[~goes_on]
    size = np.diff(np.append(begin, n))
    return begin[size >= least], size[size >= least]


def part_shingles(
    words: Words, begin: np.ndarray, size: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all parts in a row, in their order, and the starts of each part's."""
    n = size - width + 1
    starts = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(begin - starts[:-1], n) + np.arange(starts[-1])
    return shingles(words.hash, width)[at], starts


def part_hashes(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of each part's shingles in their order."""
    nth = np.arange(len(values)) - np.repeat(starts[:-1], np.diff(starts))
    terms = mixed(values + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9FB21C651E98DF25))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(terms, dtype=np.uint64)])
    return mixed(sums[starts[1:]] - sums[starts[:-1]])


def part_rows(docs: DataFrame, least: int, width: int, n_bands: int) -> DataFrame:
    """`docs` (`doc_id`, `text`) to (`doc_id`, `start`, `size`, `item`, `keys`) of its paragraphs."""

    def compute(batch: pa.RecordBatch) -> Iterator[dict]:
        texts = batch.column(batch.schema.get_field_index("text"))
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        for start, end in slices(texts, SLICE_BYTES):
            words = Words(texts.slice(start, end - start), lines=True)
            begin, size = natural_parts(words, least)
            if not len(begin):
                continue
            values, starts = part_shingles(words, begin, size, width)
            keys = bands(ROWS, n_bands, values, starts)
            owner = np.searchsorted(words.first, begin, side="right") - 1
            yield {
                "doc_id": ids.take(pa.array(owner + start)),
                "start": pa.array((begin - words.first[owner]).astype(np.int32)),
                "size": pa.array(size.astype(np.int32)),
                "item": pa.array(part_hashes(values, starts).view(np.int64)),
                "keys": pa.ListArray.from_arrays(
                    pa.array(np.arange(len(begin) + 1, dtype=np.int32) * n_bands),
                    pa.array(keys.ravel().view(np.int64)),
                ),
            }

    return explode_batches(
        docs, "doc_id long, start int, size int, item long, keys array<long>", compute
    )


def read_parts(wanted: DataFrame, docs: DataFrame, width: int, as_sets: bool) -> DataFrame:
    """`wanted` (`item`, `doc_id`, `start`, `size`) to members for `linked_components`.

    `values` are the shingles as a packed set, or in their order.
    """
    by_doc = wanted.groupBy("doc_id").agg(
        F.collect_set(F.struct("start", "size", "item")).alias("wanted")
    )
    rows = may_hold(docs, ["doc_id"], wanted, rows=wanted.count()).join(
        by_doc.select(own_shuffle("doc_id").alias("_id"), "wanted"),
        F.col("doc_id").eqNullSafe(F.col("_id")),
    ).select("text", "wanted")

    def compute(batch: pa.RecordBatch) -> Iterator[dict]:
        texts = batch.column(batch.schema.get_field_index("text"))
        wishes = batch.column(batch.schema.get_field_index("wanted"))
        for start, end in slices(texts, SLICE_BYTES):
            words = Words(texts.slice(start, end - start))
            own = wishes.slice(start, end - start)
            owner = pc.list_parent_indices(own).to_numpy()
            asked = pc.list_flatten(own)
            first, size, item = (asked.field(i).to_numpy() for i in range(3))
            # Where an id repeats, each of its rows is asked for all; one has the paragraph.
            fits = np.flatnonzero(first + size <= words.counts[owner])
            begin = words.first[owner[fits]] + first[fits]
            values, starts = part_shingles(words, begin, size[fits].astype(np.int64), width)
            mine = np.flatnonzero(part_hashes(values, starts).view(np.int64) == item[fits])
            if not len(mine):
                continue
            lists = (values[starts[i] : starts[i + 1]] for i in mine)
            names = pa.array(item[fits[mine]])
            yield {
                "item": names,
                "rank": names,
                "place": pa.array(np.zeros(len(mine), dtype=np.int64)),
                "values": [pack(v) if as_sets else v.tobytes() for v in lists],
            }

    return explode_batches(rows, "item long, rank long, place long, values binary", compute)


def shared_ends(pairs: DataFrame, width: int) -> DataFrame:
    """`pairs` (`item`, `values`, `lead_values`) to (`item`, `low`, `high`).

    The words from the first to the last shingle that the lead has too; equal if there is none.
    """

    def compute(batch: pa.RecordBatch) -> dict:
        own, lead = (
            batch.column(batch.schema.get_field_index(c)).to_pylist()
            for c in ("values", "lead_values")
        )
        low, high = [], []
        for a, b in zip(own, lead):
            here = np.frombuffer(a, dtype=np.uint64)
            both = np.flatnonzero(np.isin(here, np.frombuffer(b, dtype=np.uint64)))
            low.append(int(both[0]) if len(both) else 0)
            high.append(int(both[-1]) + width if len(both) else 0)
        return {"low": pa.array(low, type=pa.int32()), "high": pa.array(high, type=pa.int32())}

    fields = T.StructType(
        [T.StructField("low", T.IntegerType()), T.StructField("high", T.IntegerType())]
    )
    return append_columns(pairs, fields, compute, ["item"])


def repeated_parts(
    docs: DataFrame, percent: int, recall: float, least: int, width: int
) -> DataFrame:
    """(`doc_id`, `start`, `cluster`, `removed`, `begin`, `end`): natural paragraphs that repeat.

    Paragraphs of `docs` (`doc_id`, `text`) are those of `natural_parts`. Equal ones are one item;
    items are linked if the Jaccard similarity of their sets of `width`-word shingles is
    `percent` / 100 or more, and a cluster is what hangs together. The first paragraph of a
    cluster, by document and place, stays. Of each other one the words go that lie between the
    first and the last shingle that the first one has too: a word changed within goes with it,
    what stands before or after stays. One that has no shingle in common with the first stays.
    """
    n_bands = tune(percent / 100, recall, ROWS)
    rows = stored(part_rows(docs, least, width, n_bands))
    firsts = stored(
        rows.groupBy("item").agg(
            F.min(F.struct("doc_id", "start", "size")).alias("first"),
            F.count(F.lit(1)).alias("n"),
            F.first("keys").alias("keys"),
        )
    )
    keys = firsts.select(
        "item",
        F.explode("keys").alias("key"),
        F.col("item").alias("rank"),
        F.lit(0).cast("long").alias("place"),
    )

    def fetch(items: DataFrame) -> DataFrame:
        wanted = firsts.select("item", "first.*").join(items, "item")
        return read_parts(stored(wanted), docs, width, as_sets=True)

    linked_items, members = linked_components(keys, fetch, percent)
    dropped(members)
    near = linked_items.select(F.col("node").alias("item"), "component")
    known = stored(
        firsts.select("item", "first", "n")
        .join(near, "item", "left")
        .filter("n > 1 OR component IS NOT NULL")
        .select("item", "first", F.coalesce("component", "item").alias("cluster"))
    )
    leads = stored(
        known.groupBy("cluster").agg(
            F.min(F.struct("first", "item")).alias("lead"), F.count(F.lit(1)).alias("n")
        )
    )
    led = stored(
        known.join(
            leads.select(own_shuffle("cluster").alias("_cluster"), "lead", "n"),
            F.col("cluster") == F.col("_cluster"),
        ).select("item", "first", "cluster", "lead", "n")
    )
    # Once for each different text of a paragraph, not for each copy.
    several = led.filter("n > 1").select("item", "first.*", F.col("lead.item").alias("lead"))
    ordered = stored(read_parts(several.drop("lead"), docs, width, as_sets=False))
    lead_values = ordered.join(
        leads.filter("n > 1").select(F.col("lead.item").alias("item")), "item"
    ).select(own_shuffle("item").alias("_lead"), F.col("values").alias("lead_values"))
    pairs = (
        ordered.select("item", "values")
        .join(several.select("item", "lead"), "item")
        .filter("item <> lead")
        .join(lead_values, F.col("lead") == F.col("_lead"))
        .select("item", "values", "lead_values")
    )
    ends = stored(shared_ends(pairs, width))
    verdicts = led.join(ends, "item", "left").select(
        own_shuffle("item").alias("_item"), "cluster", "lead", "low", "high"
    )
    spots = may_hold(rows.select("doc_id", "start", "size", "item"), ["item"], known, rows=known.count())
    met = spots.join(verdicts, F.col("item") == F.col("_item"))
    leads_itself = F.col("doc_id").eqNullSafe(F.col("lead.first.doc_id")) & (
        F.col("start") == F.col("lead.first.start")
    )
    begin = F.col("start") + F.coalesce("low", F.lit(0))
    end = F.col("start") + F.coalesce("high", "size")
    return met.select(
        "doc_id",
        "start",
        "cluster",
        (~leads_itself & (end > begin)).alias("removed"),
        begin.alias("begin"),
        F.greatest(begin, end).alias("end"),
    )
