"""Line dedup by an exact set-similarity join with prefix, positional and length filters.

The tokens of a line are its five-word shingles. In one order of all tokens, rarest first, two
lines as similar as asked share a token among the first few of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginflow.llm.frames import (
    dropped,
    explode_batches,
    may_hold,
    own_shuffle,
    saved,
    ship_code,
    slices,
    stored,
)
from marginflow.llm.hashing import Words, mixed, shingle_sets, text_bytes
from marginflow.llm.links import STRIP, late_among
from marginflow.llm.packed import partner_rows

PERCENT = 80
WIDTH = 5  # words of a token
MIN_WORDS = 1  # of a line, unless the caller asks for another least
SLOTS = 1 << 22  # counters of the rarity table
CHUNKS = 64  # pieces of it that are added up apart from each other
PARTS = 8  # groups of tasks whose pieces are added first
KEY_BYTES = 6  # of a rank, a number of 46 bits
SLICE_BYTES = 512 * 1024  # arrays of this many numbers stay near the processor
MOST_LINES = 1 << 17  # sorted at a time
MANY_BITS = 1 << 26  # of the bitmap of lines with a verdict, 8 MB


def split_lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All lines of the texts in a row, the text each is from, and its number in it."""
    parts = pc.split_pattern(texts.fill_null("") if texts.null_count else texts, "\n")
    owner = pc.list_parent_indices(parts).to_numpy()
    first = np.searchsorted(owner, np.arange(len(texts)))
    return pc.list_flatten(parts), owner, np.arange(len(owner)) - first[owner]


def sequence_hashes(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each text's words in their order."""
    at = np.arange(len(words.hash), dtype=np.uint64)
    at -= np.repeat(words.first[:-1].astype(np.uint64), words.counts)
    out = []
    for salt in (np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xA0761D6478BD642F)):
        terms = mixed(words.hash + (at + np.uint64(1)) * salt)
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(terms, dtype=np.uint64)])
        whole = sums[words.first[1:]] - sums[words.first[:-1]]
        out.append(mixed(whole + words.counts.astype(np.uint64) * salt))
    return out[0], out[1]


def prefix_length(n, percent: int):
    """How many of `n` ordered tokens two similar sets cannot all miss."""
    return n + (-percent * n) // 100 + 1


def rank_of(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Place of each token in one order of all tokens, rarest first: a number of 46 bits.

    `counts` has for each slot how often it occurs, as a power of two.

    Six bits tell how often the token's slot occurs, as a power of two, and 40 are of its hash.
    One order for all lines is all the filters need; how well the counters tell rare tokens
    apart decides only how many candidates there are.
    """
    power = counts[(values % np.uint64(SLOTS)).astype(np.int64)].astype(np.uint64)
    return (power << np.uint64(40)) | (values >> np.uint64(24))


def ordered_ranks(
    values: np.ndarray, starts: np.ndarray, counts: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Different tokens of each line as ranks, rarest first, and the starts of each line's."""
    ranks = rank_of(values, counts)
    bits = max(1, int(len(starts) - 1).bit_length())
    if bits > 18:
        raise ValueError("too many lines at a time")
    owner = np.repeat(np.arange(len(starts) - 1, dtype=np.uint64), np.diff(starts))
    joined = np.sort((owner << np.uint64(46)) | ranks)
    fresh = np.ones(len(joined), dtype=bool)
    fresh[1:] = joined[1:] != joined[:-1]
    joined = joined[fresh]
    owner = (joined >> np.uint64(46)).astype(np.int64)
    return joined & np.uint64(2**46 - 1), np.searchsorted(owner, np.arange(len(starts)))


def ordered_set(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Different tokens of one line, in the order of their ranks."""
    values = np.unique(values)
    return values[np.argsort(rank_of(values, counts), kind="stable")]


COUNTS = "chunk int, part int, data binary"


def _chunks(total: np.ndarray, chunks: list[int], part: int) -> pa.RecordBatch:
    """Pieces of a table of counters as rows, compressed; counters end at 2^32 - 1."""
    size = SLOTS // CHUNKS
    total = np.minimum(total, np.uint64(2**32 - 1)).astype(np.uint32)
    pieces = [total[i * size : (i + 1) * size] for i in range(len(chunks))]
    return pa.RecordBatch.from_pydict(
        {
            "chunk": pa.array(chunks, type=pa.int32()),
            "part": pa.array([part] * len(chunks), type=pa.int32()),
            "data": [pa.compress(p.tobytes(), codec="zstd", asbytes=True) for p in pieces],
        }
    )


def _added(table: pa.Table) -> pa.Table:
    """Sum of the pieces of one chunk."""
    size = SLOTS // CHUNKS
    total = np.zeros(size, dtype=np.uint64)
    for data in table.column("data"):
        raw = pa.decompress(data.as_py(), decompressed_size=4 * size, codec="zstd", asbytes=True)
        total += np.frombuffer(raw, dtype=np.uint32)
    chunk, part = table.column("chunk")[0].as_py(), table.column("part")[0].as_py()
    return pa.Table.from_batches([_chunks(total, [chunk], part)])


def rarity(docs: DataFrame) -> np.ndarray:
    """How often the tokens of each slot occur in all documents' lines, as a power of two.

    A token's slot is a part of its hash. Each task counts in a table of SLOTS counters, which
    it hands on in compressed pieces when it is done. The pieces are added in two steps, so no
    task gets those of all others, and what is collected here, SLOTS numbers, does not grow
    with the corpus or its vocabulary.
    """
    ship_code(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, dtype=np.uint64)
        for batch in batches:
            for start, end in slices(batch.column(0), SLICE_BYTES):
                lines, _, _ = split_lines(batch.column(0).slice(start, end - start))
                values, _ = shingle_sets(Words(lines), WIDTH)
                np.add.at(total, (values % np.uint64(SLOTS)).astype(np.int64), np.uint64(1))
        yield _chunks(total, list(range(CHUNKS)), TaskContext.get().partitionId() % PARTS)

    tables = docs.select("text").mapInArrow(count, COUNTS)
    for keys in (["chunk", "part"], ["chunk"]):
        tables = tables.groupBy(*keys).applyInArrow(_added, COUNTS)
    out = np.zeros(SLOTS, dtype=np.uint64)
    size = SLOTS // CHUNKS
    for row in tables.toArrow().to_pylist():
        raw = pa.decompress(row["data"], decompressed_size=4 * size, codec="zstd", asbytes=True)
        out[row["chunk"] * size : (row["chunk"] + 1) * size] = np.frombuffer(raw, dtype=np.uint32)
    return np.frexp(out.astype(np.float64))[1].astype(np.uint8)


def line_rows(
    docs: DataFrame, counters, percent: int = PERCENT, least: int = MIN_WORDS
) -> DataFrame:
    """`docs` (`doc_id`, `text`) to its lines of `least` words or more.

    (`doc_id`, `line_no`, `h1`, `h2`, `size`, `keys`): two independent 64-bit hashes stand for
    the words of the line in their order, so lines that differ in blanks alone are equal;
    `size` is the number of its different tokens, `keys` its prefix, rarest first, in KEY_BYTES
    each. A line of fewer than WIDTH words has no keys: its one token is all its words, so it is similar to
    equal lines alone, and these are one item.
    """

    def compute(batch: pa.RecordBatch) -> Iterator[dict]:
        texts = batch.column(batch.schema.get_field_index("text"))
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        for start, end in slices(texts, SLICE_BYTES):
            lines, owner, number = split_lines(texts.slice(start, end - start))
            words = Words(lines)
            h1, h2 = sequence_hashes(words)
            wanted = np.flatnonzero(words.counts >= max(1, least))
            values, starts = shingle_sets(words, WIDTH)
            for some in np.array_split(wanted, len(wanted) // MOST_LINES + 1):
                # The tokens of lines of `least` words or more.
                n = np.diff(starts)[some]
                ends = np.concatenate([[0], np.cumsum(n)])
                nth = np.arange(ends[-1]) - np.repeat(ends[:-1], n)
                own = values[np.repeat(starts[some], n) + nth]
                ranks, first = ordered_ranks(own, ends, counters.value)
                sizes = np.diff(first)
                lengths = np.minimum(prefix_length(sizes, percent), sizes)
                lengths[words.counts[some] < WIDTH] = 0
                ends = np.concatenate([[0], np.cumsum(lengths)])
                nth = np.arange(ends[-1]) - np.repeat(ends[:-1], lengths)
                keys = ranks[np.repeat(first[:-1], lengths) + nth]
                keys = np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES])
                yield {
                    "doc_id": ids.take(pa.array(owner[some] + start)),
                    "line_no": pa.array(number[some].astype(np.int32)),
                    "h1": pa.array(h1[some].view(np.int64)),
                    "h2": pa.array(h2[some].view(np.int64)),
                    "size": pa.array(sizes.astype(np.int32)),
                    "keys": pa.Array.from_buffers(
                        pa.binary(),
                        len(some),
                        [
                            None,
                            pa.py_buffer((KEY_BYTES * ends).astype(np.int32)),
                            pa.py_buffer(keys),
                        ],
                    ),
                }

    return explode_batches(
        docs, "doc_id long, line_no int, h1 long, h2 long, size int, keys binary", compute
    )


def prefix_tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Item, size, number of tokens and the tokens of a batch of `line_rows` (`h1`, `size`, `keys`)."""
    keys = batch.column("keys")
    data, starts = text_bytes(keys)
    tokens = np.zeros((len(data) // KEY_BYTES, 8), dtype=np.uint8)
    tokens[:, :KEY_BYTES] = data.reshape(-1, KEY_BYTES)
    return (
        batch.column("h1").to_numpy(),
        batch.column("size").to_numpy(),
        np.diff(starts) // KEY_BYTES,
        tokens.view(np.uint64).ravel(),
    )


def line_sets(wanted: DataFrame, docs: DataFrame, counters) -> DataFrame:
    """Members for `late_items`: `wanted` (`item`, `doc_id`, `line_no`) with tokens.

    Lines that nobody wants are left out before the join, so few texts move.
    """
    every = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    lines = may_hold(every, ["doc_id", "line_no"], wanted)
    asked = wanted.select("item", F.col("doc_id").alias("_id"), F.col("line_no").alias("_no"))
    rows = lines.join(
        asked, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("line_no") == F.col("_no"))
    ).select("item", "doc_id", "line_no", "line")

    def compute(batch: pa.RecordBatch) -> Iterator[dict]:
        part = pa.Table.from_batches([batch])
        for start, end in slices(batch.column(3), SLICE_BYTES):
            own = part.slice(start, end - start)
            words = Words(own.column("line").combine_chunks())
            h1, _ = sequence_hashes(words)
            values, starts = shingle_sets(words, WIDTH)
            # Where an id repeats, the line at this place may be another one.
            pick = np.flatnonzero(h1.view(np.int64) == own.column("item").to_numpy())
            own = own.take(pa.array(pick))
            yield {
                "item": own.column("item").combine_chunks(),
                "rank": own.column("doc_id").combine_chunks().fill_null(-(2**63)),
                "place": own.column("line_no").combine_chunks().cast(pa.int64()),
                "values": [
                    ordered_set(values[starts[i] : starts[i + 1]], counters.value).tobytes()
                    for i in pick
                ],
            }

    return explode_batches(
        rows,
        "item long, rank long, place long, values binary",
        compute,
    )


def may_match(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Pairs that pass the length, prefix and positional filters; sets are in token order.

    Length: the smaller set has `percent` of the larger. Prefix: they share a token among the
    first of each. Positional: what lies behind the first shared token can still make up the
    overlap needed, which is `percent` / (100 + `percent`) of both sizes.
    """
    a = np.array([len(x) for x in left], dtype=np.int64)
    b = np.array([len(x) for x in right], dtype=np.int64)
    out = np.zeros((len(left), len(right)), dtype=bool)
    if not len(a) or not len(b):
        return out

    def postings(sets, sizes):
        lengths = np.minimum(prefix_length(sizes, percent), sizes)
        owner = np.repeat(np.arange(len(sets)), lengths)
        place = np.concatenate([np.arange(n) for n in lengths])
        token = np.concatenate([s[:n] for s, n in zip(sets, lengths)])
        order = np.argsort(token, kind="stable")
        return token[order], owner[order], place[order]

    token_a, owner_a, place_a = postings(left, a)
    token_b, owner_b, place_b = postings(right, b)
    for token in np.intersect1d(token_a, token_b):
        i0, i1 = np.searchsorted(token_a, [token, token + np.uint64(1)])
        j0, j1 = np.searchsorted(token_b, [token, token + np.uint64(1)])
        if token == np.uint64(2**64 - 1):
            i1, j1 = len(token_a), len(token_b)
        columns, rest_b = owner_b[j0:j1], (b[owner_b[j0:j1]] - place_b[j0:j1])[None, :]
        for start in range(i0, i1, STRIP):
            some = slice(start, min(start + STRIP, i1))
            rows = owner_a[some]
            sizes_a, sizes_b = a[rows][:, None], b[columns][None, :]
            needed = -(-percent * (sizes_a + sizes_b) // (100 + percent))
            reach = np.minimum(sizes_a - place_a[some][:, None], rest_b)
            near = 100 * np.minimum(sizes_a, sizes_b) >= percent * np.maximum(sizes_a, sizes_b)
            out[np.ix_(rows, columns)] |= near & (reach >= needed)
    return out


def repeated_lines(
    docs: DataFrame, percent: int = PERCENT, least: int = MIN_WORDS
) -> tuple[DataFrame, DataFrame]:
    """All lines of `docs` (`doc_id`, `text`) by `doc_id`, and those that go (`doc_id`, `line_no`).

    A line goes if an earlier line, in the order of document id and line number, has a Jaccard
    similarity of `percent` / 100 or more to it, whether that one stays or goes itself.
    """
    counters = docs.sparkSession.sparkContext.broadcast(rarity(docs))
    rows = stored(line_rows(docs, counters, percent, least))
    # One row per different line, where it comes first.
    firsts = stored(
        rows.groupBy("h1", "h2").agg(
            F.min(F.struct("doc_id", "line_no")).alias("first"),
            F.count(F.lit(1)).alias("n"),
        )
    )

    n, tokens = rows.agg(F.count(F.lit(1)), F.sum("size")).first()
    total = n + (tokens or 0) * (100 - percent) // 100
    partners = stored(
        partner_rows(rows.select("h1", "size", "keys"), prefix_tokens, percent, total)
    )
    names = partners.select("item").distinct()
    few = may_hold(firsts.withColumnRenamed("h1", "item"), ["item"], names)
    wanted = stored(
        few.join(names.select(own_shuffle("item").alias("_item")), F.col("item") == F.col("_item"))
        .groupBy("item").agg(F.min("first").alias("first"))
        .select("item", "first.*")
    )
    shared = saved(
        partners.join(
            wanted.select(
                own_shuffle("item").alias("_item"),
                F.coalesce("doc_id", F.lit(-(2**63)).cast("long")).alias("rank"),
                F.col("line_no").cast("long").alias("place"),
            ),
            F.col("item") == F.col("_item"),
        ).drop("_item")
    )
    dropped(partners)
    late = stored(
        late_among(shared, lambda items: line_sets(wanted, docs, counters), percent, may_match)
    )
    verdicts = firsts.join(
        late.select(own_shuffle("item").alias("_item"), F.lit(True).alias("late")),
        F.col("h1") == F.col("_item"),
        "left",
    ).filter("late OR n > 1")
    verdicts = stored(
        verdicts.select("h1", "h2", "first", F.coalesce("late", F.lit(False)).alias("late"))
    )
    # Lines without a verdict stay where they are.
    here = F.struct("doc_id", "line_no")
    told = verdicts.select(
        own_shuffle("h1").alias("_h1"), F.col("h2").alias("_h2"), "first", "late"
    )
    few = may_hold(rows.select("doc_id", "line_no", "h1", "h2"), ["h1", "h2"], verdicts.select("h1", "h2"), MANY_BITS)
    removed = (
        few.join(told, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")))
        .filter(F.col("late") | ~here.eqNullSafe(F.col("first")))
        .select("doc_id", "line_no")
    )
    return rows.select("doc_id"), removed


def line_dedup(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    percent: int = PERCENT,
    least: int = MIN_WORDS,
) -> DataFrame:
    """(`doc_id`, `n_lines`, `n_removed`, `removed`): per document what line dedup takes out.

    `n_lines` counts lines of `least` words or more, the only ones looked at; `removed` lists the
    numbers of the lines (from 0) that repeat an earlier one. By default every line that has
    a word is looked at; a line of fewer than five words repeats equal lines only.

    The join is exact: a line that the first line of none of its prefix tokens makes go is compared
    with every earlier one that the filters let through. Equal lines are one item, so a hot line
    makes no pairs; of near copies each is compared with the first.

    Null, empty and blank texts have no lines and give a row with zeros. A null id sorts
    before all others. Rows that repeat an id are one document: a line at the same place in
    two of them is the first at both, and the result has one row for the id. An empty table
    gives no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    lines, removed = repeated_lines(rows, percent, least)
    nowhere = F.lit(None).cast("int").alias("gone")
    parts = [
        lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).select("doc_id", "n", nowhere),
        removed.select("doc_id", F.lit(0).cast("long").alias("n"), F.col("line_no").alias("gone")),
        rows.select("doc_id", F.lit(0).cast("long").alias("n"), nowhere),
    ]
    return (
        parts[0].unionByName(parts[1]).unionByName(parts[2])
        .groupBy("doc_id")
        .agg(
            F.sum("n").cast("long").alias("n_lines"),
            F.count("gone").alias("n_removed"),
            F.sort_array(F.collect_set("gone")).alias("removed"),
        )
    )


def drop_lines(
    docs: DataFrame, found: DataFrame, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """`docs` without the lines that `line_dedup` lists, with the columns they came with.

    Null texts, and documents of which no line goes, stay as they are; a text that loses all its
    lines is empty. Rows that repeat an id lose the same line numbers. An empty table gives no rows.
    """
    gone = found.filter("n_removed > 0").select("doc_id", "removed")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("body"))
    joined = rows.join(gone, rows["row"][doc_id].cast("long").eqNullSafe(gone["doc_id"]), "left")
    rest = F.array_join(
        F.filter(
            F.split("body", "\n", -1), lambda line, i: ~F.array_contains(F.col("removed"), i)
        ),
        "\n",
    )
    body = F.when(F.col("removed").isNotNull(), rest).otherwise(F.col("body"))
    return joined.select(
        *(body.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns)
    )
