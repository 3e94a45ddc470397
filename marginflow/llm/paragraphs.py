"""Substring dedup: MinHash banding of paragraphs that are anchored in the text itself.

A paragraph is a run of PARAGRAPH words that starts at an anchor. Anchors are the places whose
five-word shingle has the smallest hash among REACH places in a row, so they depend on the
words around them alone: wherever a passage of PARAGRAPH + REACH - 1 words is repeated, in the
middle of a line or across lines, all its copies have an anchor, and so a paragraph, in common.
Shorter natural paragraphs (lines, runs of lines without a blank one, whole texts) have an anchor
of their own, chosen by their own words, so exact copies of them have one in common as well.
Whole natural paragraphs are items of their own beside these, see `natural`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginflow.llm.frames import (
    WORD,
    append_columns,
    dropped,
    explode_batches,
    may_hold,
    own_shuffle,
    slices,
    stored,
)
from marginflow.llm.hashing import LARGEST, Words, mixed, seeds, shingles, sliding, tune
from marginflow.llm.links import linked_components, pack
from marginflow.llm.natural import repeated_parts
from marginflow.llm.packed import repeated_keys

PARAGRAPH = 20  # words
REACH = 31  # with PARAGRAPH: passages of 50 words or more are found
WIDTH = 5  # words of a shingle
PERCENT = 80
RECALL = 0.99  # of a pair of paragraphs at the least similarity; equal ones are always found
ROWS = 4
CONTEXT = 32  # words beside a paragraph; anchors of a passage and its ends are nearer than that
MANY_BITS = 1 << 26
SLICE_BYTES = 512 * 1024  # arrays of this many numbers stay near the processor


def anchors(words: Words) -> np.ndarray:
    """Places (over all texts) of the words at which paragraphs start.

    Windows of REACH shingles that lie in one text mark their smallest. Lines, runs of lines
    and texts of PARAGRAPH words or more that are too short to be sure of one mark the smallest
    of the places at which a whole paragraph fits. A paragraph must end in the text that it
    starts in. `words` come with their lines.
    """
    h = shingles(words.hash, WIDTH)
    counts = words.counts
    n = len(h)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    text = np.repeat(np.arange(len(counts)), counts)[:n]
    last = words.first[1:][text]  # end of the text each shingle starts in
    at = np.arange(n)
    marked = np.zeros(n, dtype=bool)
    least = sliding(h, REACH)
    whole = at[: len(least)] + REACH - 1 + WIDTH <= last[: len(least)]
    # A place is marked if it is the smallest of some window that holds it.
    windows = np.where(whole, least, 0).astype(np.uint64)
    padded = np.concatenate([np.zeros(REACH - 1, dtype=np.uint64), windows, np.zeros(REACH, dtype=np.uint64)])
    best = sliding(padded, REACH, np.maximum)[:n]
    marked = best == h
    for first in natural_starts(words):
        marked[own_anchors(h, first)] = True
    return at[marked & (at + PARAGRAPH <= last)]


def natural_starts(words: Words) -> Iterator[np.ndarray]:
    """First words of all texts, of all runs of lines without a blank one, and of all lines.

    Each has the number of words as its last entry.
    """
    n = len(words.hash)
    yield np.unique(np.append(words.first, n))
    step = np.diff(words.line)
    for least in (2, 1):
        starts = np.flatnonzero(step >= least) + 1
        yield np.unique(np.concatenate([words.first, starts, [n]]))


def own_anchors(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The smallest of the places at which a paragraph fits, of each part too short for REACH."""
    sizes = np.diff(first)
    some = np.flatnonzero((sizes >= PARAGRAPH) & (sizes < PARAGRAPH + REACH - 1))
    begin, nth = first[some], np.arange(REACH - 1)
    fits = nth[None, :] <= (sizes[some] - PARAGRAPH)[:, None]
    places = np.minimum(begin[:, None] + nth[None, :], len(h) - 1)
    return begin + np.where(fits, h[places], LARGEST).argmin(axis=1)


def paragraph_hashes(words: Words, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the words of each paragraph, in their order."""
    factor = seeds(PARAGRAPH, 21) | np.uint64(1)
    out = np.zeros(len(starts), dtype=np.uint64)
    for j in range(PARAGRAPH):
        out += words.hash[starts + j] * factor[j]
    return mixed(out)


def paragraph_shingles(words: Words, starts: np.ndarray) -> np.ndarray:
    """(paragraphs, shingles) hashes."""
    h = shingles(words.hash, WIDTH)
    return h[starts[:, None] + np.arange(PARAGRAPH - WIDTH + 1)[None, :]]


def least_similarity(percent: int) -> float:
    """Smallest Jaccard similarity of `percent` / 100 or more that two paragraphs can have.

    Their sets have one size, so similarities come in steps: at 80 the next is 15/17, which
    is one different word at an end. The bands are tuned to that: many minima in few bands
    keep paragraphs apart that have half of their words in common.
    """
    size = PARAGRAPH - WIDTH + 1
    both = -(-2 * size * percent // (100 + percent))
    return both / (2 * size - both)


def counted_keys(owner: np.ndarray, start: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which rows tell of a key at a place of its own.

    Paragraphs that overlap share most shingles and so many keys, which says nothing. Of the
    paragraphs of a text with the same key the first counts, and the last if they do not
    overlap. Keys that count twice or more are at two places that do not overlap. Rows come in
    the order of `owner` and `start`.
    """
    order = np.argsort(key, kind="stable")
    o, k, s = owner[order], key[order], start[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (o[1:] != o[:-1]) | (k[1:] != k[:-1])
    begins = np.flatnonzero(new)
    ends = np.append(begins[1:], len(order)) - 1
    far = s[ends] - s[begins] >= PARAGRAPH
    out = np.zeros(len(order), dtype=bool)
    out[order[begins]] = True
    out[order[ends[far]]] = True
    return out


def paragraph_rows(docs: DataFrame, bands: int, rows: int = ROWS) -> DataFrame:
    """`docs` (`doc_id`, `text`) to (`doc_id`, `start`, `item`, `keys`, `counted`).

    `start` is the number of the paragraph's first word in its document, `item` the hash of its
    words, `keys` the hashes of its bands, and the bits of `counted` tell which of them count.
    """

    def lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))

    def compute(batch: pa.RecordBatch) -> Iterator[dict]:
        texts = batch.column(batch.schema.get_field_index("text"))
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        for start, end in slices(texts, SLICE_BYTES):
            words = Words(texts.slice(start, end - start), lines=True)
            places = anchors(words)
            if not len(places):
                continue
            owner = np.searchsorted(words.first, places, side="right") - 1
            first = places - words.first[owner]
            values = np.ascontiguousarray(paragraph_shingles(words, places).T)
            salts = seeds(rows * bands, 22)
            keys = np.zeros((len(places), bands), dtype=np.uint64)
            told = np.zeros((len(places), bands), dtype=bool)
            for b in range(bands):
                keys[:, b] = salts[b]
                for r in range(rows):
                    salt = salts[b * rows + r]
                    order = values ^ salt
                    order *= salt | np.uint64(1)
                    order ^= order >> np.uint64(32)
                    keys[:, b] = mixed(keys[:, b] + order.min(axis=0))
                told[:, b] = counted_keys(owner, first, keys[:, b])
            yield {
                "doc_id": ids.take(pa.array(owner + start)),
                "start": pa.array(first.astype(np.int32)),
                "item": pa.array(paragraph_hashes(words, places).view(np.int64)),
                "keys": lists(keys.ravel(), np.full(len(places), bands)),
                "counted": pa.array((told << np.arange(bands)).sum(axis=1).astype(np.int32)),
            }

    return explode_batches(
        docs, "doc_id long, start int, item long, keys array<long>, counted int", compute
    )


def told_keys(batch: pa.RecordBatch) -> np.ndarray:
    """The keys that count, of a batch of `paragraph_rows`."""
    counted = batch.column("counted").to_numpy()
    keys = batch.column("keys").flatten().to_numpy().view(np.uint64)
    bands = len(keys) // max(1, len(counted))
    told = (counted[:, None] >> np.arange(bands)[None, :]) & 1
    return keys[told.ravel().astype(bool)]


def paragraph_sets(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """Members for `linked_components`: `wanted` (`item`, `doc_id`, `start`) with shingles.

    A document is read once for all its wanted paragraphs, of which it has at most as many as
    words.
    """
    by_doc = wanted.groupBy("doc_id").agg(
        F.collect_list(F.struct("item", "start")).alias("wanted")
    )
    rows = may_hold(docs, ["doc_id"], wanted, rows=wanted.count()).join(
        by_doc.select(own_shuffle("doc_id").alias("_id"), "wanted"),
        F.col("doc_id").eqNullSafe(F.col("_id")),
    ).select("doc_id", "text", "wanted")

    def compute(batch: pa.RecordBatch) -> Iterator[dict]:
        texts = batch.column(batch.schema.get_field_index("text"))
        wishes = batch.column(batch.schema.get_field_index("wanted"))
        ids = batch.column(batch.schema.get_field_index("doc_id")).fill_null(-(2**63))
        for start, end in slices(texts, SLICE_BYTES):
            words = Words(texts.slice(start, end - start))
            own = wishes.slice(start, end - start)
            owner = pc.list_parent_indices(own).to_numpy()
            asked = pc.list_flatten(own)
            item, first = (asked.field(i).to_numpy() for i in range(2))
            # Where an id repeats, each of its rows is asked for all; one has the paragraph.
            fits = np.flatnonzero(first + PARAGRAPH <= words.counts[owner])
            places = words.first[owner[fits]] + first[fits]
            mine = paragraph_hashes(words, places).view(np.int64) == item[fits]
            pick, places = fits[mine], places[mine]
            if not len(pick):
                continue
            values = np.sort(paragraph_shingles(words, places), axis=1)
            repeats = (values[:, 1:] == values[:, :-1]).any(axis=1).tolist()
            yield {
                "item": pa.array(item[pick]),
                "rank": ids.take(pa.array(owner[pick] + start)),
                "place": pa.array(first[pick].astype(np.int64)),
                "values": [pack(v) if twice else v.tobytes() for v, twice in zip(values, repeats)],
            }

    return explode_batches(
        rows,
        "item long, rank long, place long, values binary",
        compute,
    )


def most_shift(percent: int) -> int:
    """How many words apart two paragraphs that are as similar may start in the same passage."""
    size = PARAGRAPH - WIDTH + 1
    return size + (-2 * size * percent) // (100 + percent)


def paragraph_contexts(spots: DataFrame, docs: DataFrame, shift: int) -> DataFrame:
    """`spots` (`doc_id`, `start`, `item`, `cluster`) with `around`, read from the documents.

    `around` has 32-bit hashes of CONTEXT words on either side and of the first and last words of
    the paragraph, of which a `shift` makes use, 0 where the text has none. Rows that repeat a
    document have the spots that are theirs.
    """
    by_doc = spots.groupBy("doc_id").agg(
        F.collect_list(F.struct("start", "item", "cluster")).alias("wanted")
    )
    rows = may_hold(docs, ["doc_id"], spots, rows=spots.count()).join(
        by_doc.select(own_shuffle("doc_id").alias("_id"), "wanted"),
        F.col("doc_id").eqNullSafe(F.col("_id")),
    ).select("doc_id", "text", "wanted")

    def compute(batch: pa.RecordBatch) -> Iterator[dict]:
        texts = batch.column(batch.schema.get_field_index("text"))
        wishes = batch.column(batch.schema.get_field_index("wanted"))
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        for start, end in slices(texts, SLICE_BYTES):
            words = Words(texts.slice(start, end - start))
            own = wishes.slice(start, end - start)
            owner = pc.list_parent_indices(own).to_numpy()
            asked = pc.list_flatten(own)
            first, item, cluster = (asked.field(i).to_numpy() for i in range(3))
            # Where an id repeats, each of its rows is asked for all, once.
            order = np.lexsort((item, first, owner))
            fresh = np.ones(len(order), dtype=bool)
            fresh[1:] = np.any([np.diff(x[order]) != 0 for x in (owner, first, item)], axis=0)
            once = order[fresh]
            fits = once[first[once] + PARAGRAPH <= words.counts[owner[once]]]
            places = words.first[owner[fits]] + first[fits]
            mine = paragraph_hashes(words, places).view(np.int64) == item[fits]
            pick, places = fits[mine], places[mine]
            if not len(pick):
                continue
            low, high = words.first[owner[pick]], words.first[owner[pick] + 1]
            edge = min(shift, PARAGRAPH // 2)
            sides = np.r_[-CONTEXT:edge, PARAGRAPH - edge : PARAGRAPH + CONTEXT]
            at = places[:, None] + sides[None, :]
            short = (words.hash >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
            around = short[np.clip(at, 0, len(short) - 1)]
            around[(at < low[:, None]) | (at >= high[:, None])] = 0
            yield {
                "doc_id": ids.take(pa.array(owner[pick] + start)),
                "start": pa.array(first[pick]),
                "cluster": pa.array(cluster[pick]),
                "around": pa.Array.from_buffers(
                    pa.binary(),
                    len(around),
                    [
                        None,
                        pa.py_buffer(np.arange(len(around) + 1, dtype=np.int32) * around.shape[1] * 4),
                        pa.py_buffer(np.ascontiguousarray(around)),
                    ],
                ),
            }

    return explode_batches(rows, "doc_id long, start int, cluster long, around binary", compute)


def first_false(same: np.ndarray) -> np.ndarray:
    """How many entries of each row come before the first that is false."""
    return np.where(same.all(axis=1), same.shape[1], same.argmin(axis=1))


def common_run(here: np.ndarray, lead: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """How many words before and after each paragraph are those beside the lead's paragraph.

    (paragraphs, words) hashes, 0 for no word, the first and last CONTEXT beside them. Similar paragraphs may start up to `shift` words
    apart; the shift with the longest run counts.
    """
    before = after = np.zeros(len(here), dtype=np.int64)
    for d in sorted(range(-shift, shift + 1), key=abs):
        other = np.zeros_like(lead)
        if d >= 0:
            other[:, : lead.shape[1] - d] = lead[:, d:]
        else:
            other[:, -d:] = lead[:, :d]
        same = (here == other) & (here != 0)
        left = first_false(same[:, :CONTEXT][:, ::-1])
        right = first_false(same[:, -CONTEXT:])
        longer = left + right > before + after
        before, after = np.where(longer, left, before), np.where(longer, right, after)
    return before, after


def extended(spots: DataFrame, percent: int) -> DataFrame:
    """`spots` (`doc_id`, `start`, `cluster`, `removed`, `around`, `_around`) with their words.

    `begin` and `end` of a removed one go on as far as the words are the lead's.
    """
    shift = most_shift(percent)

    def compute(batch: pa.RecordBatch) -> dict:
        def matrix(name: str) -> np.ndarray:
            column = batch.column(batch.schema.get_field_index(name))
            _, offsets, data = column.buffers()
            ends = np.frombuffer(offsets, dtype=np.int32)[[column.offset, column.offset + len(column)]]
            return np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[1]].view(np.uint32).reshape(len(column), -1)

        start, removed = (
            batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
            for c in ("start", "removed")
        )
        if not len(start):
            return {"begin": [], "end": []}
        before, after = common_run(matrix("around"), matrix("_around"), shift)
        return {
            "begin": pa.array((start - before * removed).astype(np.int32)),
            "end": pa.array((start + PARAGRAPH + after * removed).astype(np.int32)),
        }

    fields = T.StructType(
        [T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]
    )
    return append_columns(spots, fields, compute, ["doc_id", "start", "cluster", "removed"])


def repeated_paragraphs(docs: DataFrame, percent: int = PERCENT, recall: float = RECALL) -> DataFrame:
    """(`doc_id`, `start`, `cluster`, `removed`, `begin`, `end`): paragraphs of `docs` that repeat.

    Equal paragraphs are one item. Items that share a band and have a Jaccard similarity of
    `percent` / 100 or more are linked, and a cluster is what hangs together; `cluster` is the
    smallest item in it. Paragraphs that overlap where they first stand do not link. All paragraphs of a cluster but the first, by document and place, are
    removed, with the words on either side (from `begin` up to `end`) that the first has too.
    """
    n_bands = tune(least_similarity(percent), recall, ROWS)
    rows = stored(paragraph_rows(docs, n_bands))
    total = rows.agg(F.sum(F.bit_count("counted"))).first()[0]
    several = stored(repeated_keys(rows.select("keys", "counted"), told_keys, total))
    every = rows.select(
        "item",
        F.explode("keys").alias("key"),
        F.coalesce("doc_id", F.lit(-(2**63)).cast("long")).alias("rank"),
        F.col("start").cast("long").alias("place"),
    )
    keys = stored(may_hold(every, ["key"], several, MANY_BITS, several.count()))
    dropped(several)

    def places(items: DataFrame) -> DataFrame:
        """(`doc_id`, `start`) of all paragraphs that are one of `items`, with its columns."""
        asked = items.withColumn("_item", own_shuffle("item")).drop("item")
        few = may_hold(rows.select("doc_id", "start", "item"), ["item"], items, MANY_BITS, items.count())
        return few.join(asked, F.col("item") == F.col("_item")).drop("_item")

    def fetch(items: DataFrame) -> DataFrame:
        wanted = places(items).groupBy("item").agg(F.min(F.struct("doc_id", "start")).alias("first"))
        return paragraph_sets(stored(wanted.select("item", "first.*")), docs)

    linked_items, members = linked_components(keys, fetch, percent, extent=PARAGRAPH)
    dropped(members, keys)
    clusters = linked_items.select(F.col("node").alias("item"), F.col("component").alias("cluster"))
    again = repeated_keys(
        rows.select("item"), lambda batch: batch.column("item").to_numpy().view(np.uint64), rows.count()
    )
    known = again.select(F.col("key").alias("item")).unionByName(clusters.select("item")).distinct()
    known = stored(
        known.join(clusters, "item", "left").select(
            "item", F.coalesce("cluster", "item").alias("cluster")
        )
    )
    wanted = stored(places(known))
    dropped(rows, known)
    spots = stored(paragraph_contexts(wanted, docs, most_shift(percent)))
    dropped(wanted)
    # The words around are many bytes: those of the first are read where it is known to stand.
    here = F.struct("doc_id", "start")
    leads = stored(spots.groupBy("cluster").agg(F.min(here).alias("lead")).select("cluster", "lead.*"))
    few = may_hold(spots, ["cluster", "doc_id", "start"], leads, MANY_BITS, leads.count())
    first = leads.select(
        own_shuffle("cluster").alias("_cluster"), F.struct("doc_id", "start").alias("lead")
    )
    beside = (
        few.join(first.hint("shuffle_hash"), (F.col("cluster") == F.col("_cluster")) & here.eqNullSafe(F.col("lead")))
        .groupBy("_cluster", "lead")
        .agg(F.min("around").alias("_around"))
    )
    met = spots.join(
        beside.withColumn("_cluster", own_shuffle("_cluster")).hint("shuffle_hash"),
        F.col("cluster") == F.col("_cluster"),
    ).select(
        "doc_id",
        "start",
        "cluster",
        (~here.eqNullSafe(F.col("lead"))).alias("removed"),
        "around",
        "_around",
    )
    # Written here, so that the shuffles with the words around do not stay for what follows.
    found = stored(extended(met, percent))
    dropped(spots, leads)
    return found


def substring_dedup(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    percent: int = PERCENT,
    recall: float = RECALL,
) -> DataFrame:
    """Documents with passages that other places repeat, one row for each such document.

    (`doc_id`, `n_repeated`, `n_removed`, `removed_words`, `spans`): how many of its paragraphs
    repeat, how many of these go as a later copy, how many words those cover, and `spans`, an
    array of (`start`, `cluster`, `removed`, `begin`, `end`) by place. The first copy stays. Of a
    later one the words from `begin` up to `end` go: the paragraph, and up to 32 words on either
    side that stand beside the first copy too, which is all up to the next paragraph or the end
    of the passage. Passages of 50
    words or more are found wherever they stand, and exact copies of lines, runs of lines and
    whole texts of 20 words or more. Near copies of whole natural paragraphs (lines of 20 words or
    more, runs of shorter lines without a blank one) are found from a Jaccard similarity of
    `percent` / 100 on; of these the words between the first and the last five in a row that the
    first copy has too go. Other passages of 20 to 49 words are found by chance;
    anything shorter than 20 words never is.

    Null, empty and short texts have no paragraphs and no row. A null id sorts before all
    others. Rows that repeat an id are one document: paragraphs at the same place in two of
    them are the first at both, and appear in `spans` once for each row. An empty table gives
    no rows. Long texts are read whole.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = repeated_paragraphs(rows, percent, recall).unionByName(
        repeated_parts(rows, percent, recall, PARAGRAPH, WIDTH)
    )
    # A document's own paragraphs: as many as it has anchors and lines.
    spans = found.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("start", "cluster", "removed", "begin", "end"))).alias(
            "spans"
        )
    )
    gone = F.filter("spans", lambda s: s["removed"])
    # In the order of their first words, what each adds to those before it.
    by_begin = F.sort_array(F.transform(gone, lambda s: F.struct(s["begin"], s["end"])))
    covered = F.aggregate(
        by_begin,
        F.struct(F.lit(0).alias("words"), F.lit(0).alias("end")),
        lambda a, s: F.struct(
            (a["words"] + F.greatest(s["end"] - F.greatest(a["end"], s["begin"]), F.lit(0))).alias("words"),
            F.greatest(a["end"], s["end"]).alias("end"),
        ),
    )
    return spans.select(
        "doc_id",
        F.size("spans").cast("long").alias("n_repeated"),
        F.size(gone).cast("long").alias("n_removed"),
        covered["words"].cast("long").alias("removed_words"),
        "spans",
    )


def drop_passages(
    docs: DataFrame, found: DataFrame, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """`docs` without the words that `substring_dedup` removes, with the columns they came with.

    What stands between the words that stay is kept as it is.
    """
    gone = found.filter("n_removed > 0").select("doc_id", "spans")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("body"))
    joined = rows.join(gone, rows["row"][doc_id].cast("long").eqNullSafe(gone["doc_id"]), "left")
    pattern = regex.compile(WORD)

    def rest(body: str, spans: list[dict]) -> str:
        lost = {w for s in spans if s["removed"] for w in range(s["begin"], s["end"])}
        parts, end = [], 0
        for i, m in enumerate(pattern.finditer(body)):
            if i in lost:
                parts.append(body[end : m.start()])
                end = m.end()
        return "".join([*parts, body[end:]])

    def compute(batch: pa.RecordBatch) -> dict:
        bodies = batch.column(batch.schema.get_field_index("body")).to_pylist()
        spans = batch.column(batch.schema.get_field_index("spans")).to_pylist()
        return {"body": [rest(b, s) if b and s else b for b, s in zip(bodies, spans)]}

    fields = T.StructType([T.StructField("body", T.StringType())])
    cleaned = append_columns(joined, fields, compute, ["row"])
    return cleaned.select(
        *(F.col("body" if c == text else f"row.`{c}`").alias(c) for c in docs.columns)
    )
