"""Verified links between items that share a key, without a row for every pair.

The representative of an item is the first of all it shares a key with. Items are compared with it
and move once for that: a star. Most near copies are linked by then, however many there are. What
is left to ask goes in blocks: items are compared with those of their keys that may still tell
something new, which are of another star, or come before an item that has no earlier
partner yet. A task that holds a block on either side compares all their sets at once, and returns
a row per item. So no link between stars is lost, and a crowd is not compared with itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginflow.llm.components import components, reachable
from marginflow.llm.frames import dropped, may_hold, own_shuffle, saved, ship_code, stored

BLOCK_ITEMS = 2048
BLOCK_VALUES = 1 << 20  # hashes in the sets of a block, unless a single item has more
MANY_BITS = 1 << 26  # of the bitmap of shared keys, 8 MB
CALL_ITEMS = 4096  # items that one call compares, about
CALL_VALUES = 1 << 20  # hashes in their sets, about
SMALL = 64  # pairs up to which those of all such pairs of blocks are compared at once
PAIR_VALUES = 1 << 18  # hashes in the sets of these pairs, at a time
CHUNK = 1024  # columns of the incidence matrix at a time
STRIP = 256  # rows of a matrix of pairs at a time, where it needs further ones of its size


def pack(values: np.ndarray) -> bytes:
    """A set of hashes as bytes, sorted."""
    return np.unique(values).tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint64)


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set on the left with each on the right.

    Products of incidence matrices, over the values that both sides have, some at a time.
    """
    out = np.zeros((len(left), len(right)), dtype=np.int32)
    if not left or not right:
        return out
    a, b = np.concatenate(left), np.concatenate(right)
    rows = np.repeat(np.arange(len(left)), [len(x) for x in left])
    columns = np.repeat(np.arange(len(right)), [len(x) for x in right])
    common = np.intersect1d(a, b)
    if left is right:  # values of one item alone link nothing
        values, times = np.unique(a, return_counts=True)
        common = values[times > 1]
    at, bt = np.searchsorted(common, a), np.searchsorted(common, b)
    at[at == len(common)] = 0
    bt[bt == len(common)] = 0
    if not len(common):
        return out
    in_a, in_b = common[at] == a, common[bt] == b
    at, rows, bt, columns = at[in_a], rows[in_a], bt[in_b], columns[in_b]
    order_a, order_b = np.argsort(at, kind="stable"), np.argsort(bt, kind="stable")
    at, rows, bt, columns = at[order_a], rows[order_a], bt[order_b], columns[order_b]
    for start in range(0, len(common), CHUNK):
        ends = np.array([start, start + CHUNK])
        i, j = np.searchsorted(at, ends), np.searchsorted(bt, ends)
        width = min(CHUNK, len(common) - start)
        x = np.zeros((len(left), width), dtype=np.float32)
        y = np.zeros((len(right), width), dtype=np.float32)
        x[rows[i[0] : i[1]], at[i[0] : i[1]] - start] = 1
        y[columns[j[0] : j[1]], bt[j[0] : j[1]] - start] = 1
        for top in range(0, len(left), STRIP):
            out[top : top + STRIP] += (x[top : top + STRIP] @ y.T).astype(np.int32)
    return out


def linked(
    left: list[np.ndarray], right: list[np.ndarray], percent: int
) -> np.ndarray:
    """Which pairs have a Jaccard similarity of `percent` / 100 or more; empty sets have none."""
    both = overlaps(left, right)
    a = np.array([len(x) for x in left])[:, None]
    b = np.array([len(x) for x in right])[None, :]
    out = np.zeros(both.shape, dtype=bool)
    for start in range(0, len(left), STRIP):
        rows = slice(start, start + STRIP)
        part = both[rows].astype(np.int64)
        out[rows] = (part > 0) & (100 * part >= percent * (a[rows] + b - part))
    return out


def spanning(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Places of some of the links (`u`, `v`), under n, that hold together all that the links do."""
    label, chosen = np.arange(n), np.zeros(0, dtype=np.int64)
    while True:
        between = np.flatnonzero(label[u] != label[v])
        if not len(between):
            return chosen
        # A link out of each part.
        parts = np.concatenate([label[u[between]], label[v[between]]])
        _, first = np.unique(parts, return_index=True)
        chosen = np.union1d(chosen, between[first % len(between)])
        label = reachable(n, u[chosen], v[chosen])


RESULT = "item long, hub long, late long"
COUNTED = "item long, links long, rep long"
NO_RANK = 2**63 - 1


@dataclass
class Side:
    """Items that stand on one side of a comparison."""

    item: np.ndarray
    rank: np.ndarray
    place: np.ndarray
    values: list[bytes]

    def sets(self) -> list[np.ndarray]:
        return [unpack(x) for x in self.values]


def in_turn(left: Side, right: Side) -> np.ndarray:
    """Numbers of the items of both sides, in the order of rank, place and item."""
    rank, place, item = (
        np.concatenate([getattr(left, c), getattr(right, c)]) for c in ("rank", "place", "item")
    )
    order = np.lexsort((item, place, rank))
    fresh = np.ones(len(order), dtype=np.int64)
    fresh[1:] = np.any([x[order][1:] != x[order][:-1] for x in (rank, place, item)], axis=0)
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(fresh)
    return out


@dataclass
class Few:
    """Pairs of items (`i`, `j`) of all pairs of blocks that have few of them.

    `i` and `j` are places in the arrays of the items that meet there, of which one may stand for
    an item more than once. `own` tells the pairs of a block that meets itself, each once. `both` are
    the sizes of the intersections, `sizes` those of the items' sets.
    """

    item: np.ndarray
    rank: np.ndarray
    place: np.ndarray
    sizes: np.ndarray
    i: np.ndarray
    j: np.ndarray
    own: np.ndarray
    both: np.ndarray

    def linked(self, percent: int) -> np.ndarray:
        either = self.sizes[self.i] + self.sizes[self.j] - self.both
        return (self.both > 0) & (100 * self.both >= percent * either)


def pair_overlaps(
    values: np.ndarray, starts: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int
) -> np.ndarray:
    """Sizes of the intersections of the sets `i` and `j`, 0 if one is too small for `percent`.

    Set n is values[starts[n]] to values[starts[n + 1] - 1]. The values of some pairs are sorted at once.
    """
    out = np.zeros(len(i), dtype=np.int64)
    size = np.diff(starts)
    low, high = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
    some = np.flatnonzero((low > 0) & (100 * low >= percent * high))
    known, number = np.unique(values, return_inverse=True)
    ends = np.cumsum(low[some] + high[some])
    at = 0
    while at < len(some):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIR_VALUES, "right")))
        pairs = some[at:upto]
        owner = np.concatenate([i[pairs], j[pairs]])
        n = size[owner]
        where = np.repeat(starts[owner] - np.cumsum(n) + n, n) + np.arange(n.sum())
        nth = np.repeat(np.tile(np.arange(len(pairs)), 2), n)
        met = np.sort(nth * len(known) + number[where])
        twice = met[1:][met[1:] == met[:-1]] // len(known)
        out[pairs] = np.bincount(twice, minlength=len(pairs))
        at = upto
    return out


def sides(table: pa.Table, percent: int) -> tuple[Few, Iterator[tuple[Side, Side]]]:
    """The pairs of blocks that were dealt to one call: those of few items, and the two sides of others.

    A block without a second side meets itself.
    """
    a, b, item, rank, place = (
        table.column(c).to_numpy() for c in ("a", "b", "item", "rank", "place")
    )
    second = table.column("second").to_numpy().astype(bool)
    values = table.column("values")
    order = np.lexsort((item, second, b, a))
    a, b, second, item = a[order], b[order], second[order], item[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    # Rows that repeat a document have brought the same item more than once.
    fresh = new.copy()
    fresh[1:] |= (item[1:] != item[:-1]) | (second[1:] != second[:-1])
    # Of each pair of blocks the items of the first side stand before those of the second.
    group = np.cumsum(new)[fresh] - 1
    order, second, item, rank, place = order[fresh], second[fresh], item[fresh], rank[order[fresh]], place[order[fresh]]
    n = np.bincount(group)
    starts = np.cumsum(n) - n
    n_right = np.bincount(group, weights=second).astype(np.int64)
    n_left = n - n_right
    own = n_right == 0
    right = np.where(own, starts, starts + n_left)
    n_right = np.where(own, n_left, n_right)
    few = n_left * n_right <= SMALL

    def side(start: int, size: int) -> Side:
        mine = slice(start, start + size)
        data = values.take(pa.array(order[mine])).to_pylist()
        return Side(item[mine], rank[mine], place[mine], data)

    def many() -> Iterator[tuple[Side, Side]]:
        for g in np.flatnonzero(~few).tolist():
            left = side(starts[g], n_left[g])
            yield left, left if own[g] else side(right[g], n_right[g])

    some = np.flatnonzero(few)
    times = (n_left * n_right)[some]
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    pairs = np.repeat(some, times)
    i, j = starts[pairs] + nth // n_right[pairs], right[pairs] + nth % n_right[pairs]
    once = ~own[pairs] | (i < j)
    pairs, i, j = pairs[once], i[once], j[once]
    # Numbered among the items that stand in one of these.
    mine = np.flatnonzero(few[group])
    number = np.cumsum(few[group]) - 1
    flat = pa.concat_arrays(values.take(pa.array(order[mine])).chunks) if len(mine) else None
    if flat is None:
        data, offsets = np.zeros(0, dtype=np.uint64), np.zeros(1, dtype=np.int64)
    else:
        raw = flat.buffers()
        ends = np.frombuffer(raw[1], dtype=np.int32)[flat.offset : flat.offset + len(flat) + 1].astype(np.int64)
        whole = np.frombuffer(raw[2], dtype=np.uint8) if raw[2] else np.zeros(0, dtype=np.uint8)
        data, offsets = whole[ends[0] : ends[-1]].view(np.uint64), (ends - ends[0]) // 8
    i, j = number[i], number[j]
    both = pair_overlaps(data, offsets, i, j, percent)
    return Few(item[mine], rank[mine], place[mine], np.diff(offsets), i, j, own[pairs], both), many()


def count_sides(percent: int) -> Callable:
    """Function for some pairs of blocks: how many links each item has to the other side.

    An item counts `place` times. `rep` is the smallest `rank` of the items it is linked to.
    """

    def counted_few(few: Few) -> Iterator[tuple]:
        links = np.zeros(len(few.item), dtype=np.int64)
        least = np.full(len(few.item), NO_RANK, dtype=np.int64)
        found = few.linked(percent)
        for i, j in ((few.i[found], few.j[found]), (few.j[found], few.i[found])):
            np.add.at(links, i, few.place[j])
            np.minimum.at(least, i, few.rank[j])
        yield from zip(few.item.tolist(), links.tolist(), least.tolist())

    def counted(left: Side, right: Side) -> Iterator[tuple]:
        ours = left.sets()
        found = linked(ours, ours if right is left else right.sets(), percent)
        if right is left:
            np.fill_diagonal(found, False)
        both = [(left, right, found)] if right is left else [(left, right, found), (right, left, found.T)]
        for mine, other, hits in both:
            for start in range(0, len(mine.item), STRIP):
                part = hits[start : start + STRIP]
                links = part @ other.place
                least = np.where(part, other.rank[None, :], NO_RANK).min(axis=1)
                yield from zip(mine.item[start : start + STRIP].tolist(), links.tolist(), least.tolist())

    def run(table: pa.Table) -> pa.Table:
        few, many = sides(table, percent)
        out = [*counted_few(few), *(row for left, right in many for row in counted(left, right))]
        columns = zip(*out) if out else ([], [], [])
        return pa.table(
            {
                name: pa.array(column, type=pa.int64())
                for name, column in zip(("item", "links", "rep"), columns)
            }
        )

    return run


def compare_sides(percent: int, may_match: Callable | None = None, extent: int = 0) -> Callable:
    """Function for some pairs of blocks: what is told of the links between the two sides.

    Rows with a `hub` are links, as many as hold together what all links do: `item` is of the first
    side, `hub` of the second. Rows with `late` name an item of which a partner comes before it.
    `may_match` tells the pairs that need a look;
    sets without one are not compared. Items of one `rank` whose places are less than `extent`
    apart overlap and are not linked.
    """

    def at_once(left: Side, right: Side) -> np.ndarray:
        ours = left.sets()
        theirs = ours if right is left else right.sets()
        if may_match is None:
            return linked(ours, theirs, percent)
        maybe = may_match(ours, theirs, percent)
        rows, columns = np.flatnonzero(maybe.any(axis=1)), np.flatnonzero(maybe.any(axis=0))
        out = np.zeros_like(maybe)
        out[np.ix_(rows, columns)] = linked(
            [ours[i] for i in rows], [theirs[i] for i in columns], percent
        )
        return out & maybe

    def compared_few(few: Few) -> Iterator[tuple]:
        found = few.linked(percent)
        i, j = few.i[found], few.j[found]
        found = few.item[i] != few.item[j]
        if extent:
            found &= (np.abs(few.place[i] - few.place[j]) >= extent) | (few.rank[i] != few.rank[j])
        i, j = i[found], j[found]
        items, node = np.unique(few.item, return_inverse=True)
        order = np.lexsort((few.item, few.place, few.rank))
        turn = np.empty(len(order), dtype=np.int64)
        turn[order] = np.arange(len(order))
        for at in spanning(len(items), node[i], node[j]).tolist():
            yield int(few.item[i[at]]), int(few.item[j[at]]), None
        for item in np.unique(few.item[np.where(turn[i] > turn[j], i, j)]).tolist():
            yield item, None, item

    def compared(left: Side, right: Side) -> Iterator[tuple]:
        found = at_once(left, right)
        found &= left.item[:, None] != right.item[None, :]
        if right is left:
            found = np.triu(found)
        if extent:
            apart = np.abs(left.place[:, None] - right.place[None, :]) >= extent
            found &= apart | (left.rank[:, None] != right.rank[None, :])
        if not found.any():
            return
        # An item may stand on both sides.
        items, node = np.unique(np.concatenate([left.item, right.item]), return_inverse=True)
        turn = in_turn(left, right)
        ours, theirs = node[: len(left.item)], node[len(left.item) :]
        mine, other = turn[: len(left.item)], turn[len(left.item) :]
        label, late = np.arange(len(items)), set()
        # Some rows at a time, as nearly all pairs of a crowd are links.
        for start in range(0, len(left.item), STRIP):
            i, j = np.nonzero(found[start : start + STRIP])
            i += start
            late.update(np.where(mine[i] > other[j], left.item[i], right.item[j]).tolist())
            between = np.flatnonzero(label[ours[i]] != label[theirs[j]])
            u, v = ours[i[between]], theirs[j[between]]
            chosen = spanning(len(items), label[u], label[v])
            for at in chosen.tolist():
                yield int(items[u[at]]), int(items[v[at]]), None
            label = reachable(len(items), label[u[chosen]], label[v[chosen]])[label]
        for item in late:
            yield item, None, item

    def run(table: pa.Table) -> pa.Table:
        few, many = sides(table, percent)
        out = [*compared_few(few), *(row for left, right in many for row in compared(left, right))]
        columns = zip(*out) if out else ([], [], [])
        return pa.table(
            {
                name: pa.array(column, type=pa.int64())
                for name, column in zip(("item", "hub", "late"), columns)
            }
        )

    return run


def shared_keys(keys: DataFrame) -> DataFrame:
    """(`item`, `key`, `rank`, `place`) rows of the keys that two or more different items have.

    The extremes are made from partial ones. Most keys have one item, and a bitmap of the others
    keeps their rows from moving. The way back is a join with a shuffle of its own, so a hot key is
    split by adaptive execution; the side of one row per shared key is hashed, so that the many
    rows need no sorting. Of an item that stands at several places the first counts.
    """
    hot = stored(
        keys.groupBy("key")
        .agg(F.min("item").alias("_first"), F.max("item").alias("_last"))
        .filter(F.col("_first") < F.col("_last"))
        .select("key")
    )
    few = may_hold(keys, ["key"], hot, MANY_BITS, hot.count())
    found = hot.select(F.col("key").alias("_key")).hint("shuffle_hash")
    joined = few.join(found, F.col("key") == F.col("_key"))
    order = F.min(F.struct("rank", "place"))
    shared = saved(joined.groupBy("item", "key").agg(order.alias("at")).select("item", "key", "at.*"))
    dropped(hot)
    return shared


def dealt(groups: DataFrame, by: str) -> DataFrame:
    """(`item`, `by`, `size`, `spread`) rows with `chunk`: parts of bounded items and sizes.

    Items are dealt by ranges of `spread`, an evenly spread number, so no task sees a whole group.
    """
    totals = groups.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"))
    chunks = totals.select(
        own_shuffle(by).alias("_by"),
        F.greatest(
            F.ceil(F.col("n") / BLOCK_ITEMS), F.ceil(F.col("total") / BLOCK_VALUES), F.lit(1)
        ).alias("chunks"),
    )
    return (
        groups.join(chunks, F.col(by) == F.col("_by"))
        .withColumn(
            "chunk",
            F.least(
                F.floor((F.col("spread") / F.lit(2.0**64) + 0.5) * F.col("chunks")), F.col("chunks") - 1
            ),
        )
        .drop("_by", "chunks")
    )


def compared_seats(seats: DataFrame, members: DataFrame, compare: Callable) -> DataFrame:
    """`compare` over `seats` (`a`, `b`, `second`, `item`, `size`), each with the set of its item."""
    return called(seats, members, compare, RESULT)


def called(seats: DataFrame, members: DataFrame, compare: Callable, result: str) -> DataFrame:
    """`compare` over calls: many pairs of blocks have a few items only, so a call gets several."""
    seats = saved(seats)
    n, total = seats.agg(F.count(F.lit(1)), F.sum("size")).first()
    calls = max(1, -(-n // CALL_ITEMS), int(-(-(total or 0) // CALL_VALUES)))
    sets = members.select(own_shuffle("item").alias("_item"), "rank", "place", "values")
    met = seats.join(sets, F.col("item") == F.col("_item"))
    rows = met.select(
        F.pmod(F.xxhash64("a", "b"), F.lit(calls)).alias("call"),
        "a",
        "b",
        "second",
        "item",
        "rank",
        "place",
        "values",
    )
    ship_code(seats.sparkSession)
    return rows.groupBy("call").applyInArrow(compare, result)


def star_links(shared: DataFrame, members: DataFrame, compare: Callable) -> DataFrame:
    """Links between items and their representative, the first of all items they share a key with."""
    first = shared.groupBy("key").agg(F.min(F.struct("rank", "place", "item")).alias("first"))
    asks = (
        shared.select("item", "key")
        .join(
            first.select(own_shuffle("key").alias("_key"), "first"), F.col("key") == F.col("_key")
        )
        .groupBy("item")
        .agg(F.min("first").alias("first"))
        .select("item", F.col("first.item").alias("lead"))
        .filter("item <> lead")
    )
    sizes = members.select(own_shuffle("item").alias("_item"), (F.octet_length("values") / 8).alias("size"))
    groups = asks.join(sizes, F.col("item") == F.col("_item")).drop("_item")
    groups = groups.withColumn("spread", F.xxhash64("item"))
    stars = saved(dealt(groups, "lead").select("lead", "chunk", "item", "size"))
    spot = [F.col("lead").alias("a"), F.col("chunk").cast("long").alias("b")]
    askers = stars.select(*spot, F.lit(False).alias("second"), "item", "size")
    # A representative is about as large as what is like it.
    leads = stars.groupBy(*spot, "lead").agg(F.max("size").alias("size"))
    leads = leads.select("a", "b", F.lit(True).alias("second"), F.col("lead").alias("item"), "size")
    return compared_seats(askers.unionByName(leads), members, compare)


def block_links(
    asks: DataFrame, answers: DataFrame, worth: str, members: DataFrame, compare: Callable
) -> DataFrame:
    """Links between items that ask and items that answer under one key, key by key.

    `asks` and `answers` have (`item`, `key`, `low`, `high`): `low` and `high` are the bounds of a
    number that `worth` compares (`l_low`, `l_high` of the asking block, `r_low`, `r_high` of the
    answering one) to leave out pairs of blocks that have nothing to say. On either side the items
    of a key are one block, or several if they are many.
    """
    sizes = members.select(own_shuffle("item").alias("_item"), (F.octet_length("values") / 8).alias("size"))

    def blocks(rows: DataFrame, side: str) -> tuple[DataFrame, DataFrame]:
        sized = rows.join(sizes, F.col("item") == F.col("_item")).drop("_item")
        placed = saved(
            dealt(sized.withColumn("spread", F.xxhash64("item")), "key").select(
                "item", "size", "key", "low", "high", F.xxhash64("key", "chunk").alias("block")
            )
        )
        spots = placed.groupBy("key", F.col("block").alias(side)).agg(
            F.min("low").alias(f"{side}_low"), F.max("high").alias(f"{side}_high")
        )
        return placed.select("item", "size", "block"), spots

    placed_l, l = blocks(asks, "l")
    placed_r, r = blocks(answers, "r")
    r = r.withColumn("_key", own_shuffle("key")).drop("key")
    pairs = saved(
        l.join(r, (F.col("key") == F.col("_key")) & F.expr(worth))
        .select(F.col("l").alias("a"), F.col("r").alias("b"))
    )
    seats = [
        pairs.select("a", "b", own_shuffle(end).alias("_block"))
        .join(placed, F.col("_block") == F.col("block"))
        .select("a", "b", F.lit(second).alias("second"), "item", "size")
        for end, placed, second in (("a", placed_l, False), ("b", placed_r, True))
    ]
    return compared_seats(seats[0].unionByName(seats[1]), members, compare)


def key_links(rows: DataFrame, members: DataFrame, compare: Callable) -> DataFrame:
    """Links between items of different stars that share a key; one row of an item for each key.

    `rows` has (`item`, `key`, `star`, `crowd`): `crowd` names a star that is too large for a block,
    of which no two items are compared. Keys of the same items are one. The items of a key meet in
    one block, or in each pair of its blocks if it has more.
    """
    # Items stand once under a key, so two digests of 64 bits tell their sets apart.
    same = [F.bit_xor(F.xxhash64("item", F.lit(i))).alias(f"_same{i}") for i in range(2)]
    spread = rows.groupBy("key").agg(
        F.min("star").alias("low"), F.max("star").alias("high"), F.count(F.lit(1)).alias("n"), *same
    )
    chosen = (
        spread.filter("low < high").groupBy("n", "_same0", "_same1").agg(F.min("key").alias("key"))
    )
    mixed = rows.join(
        chosen.select(own_shuffle("key").alias("_key")), F.col("key") == F.col("_key")
    ).drop("_key")
    sizes = members.select(own_shuffle("item").alias("_item"), (F.octet_length("values") / 8).alias("size"))
    sized = mixed.join(sizes, F.col("item") == F.col("_item")).drop("_item")
    parts = sized.withColumn("part", F.xxhash64("key", "crowd")).withColumn("spread", F.xxhash64("item"))
    placed = saved(
        dealt(parts, "part").select(
            "item", "key", "crowd", "size", F.xxhash64("part", "chunk").alias("block")
        )
    )
    blocks = placed.select("key", "crowd", "block").distinct()
    others = blocks.select(
        own_shuffle("key").alias("_key"), F.col("crowd").alias("_crowd"), F.col("block").alias("b")
    )
    pairs = saved(
        blocks.join(others, (F.col("key") == F.col("_key")) & (F.col("block") <= F.col("b")))
        .filter(~F.coalesce(F.col("crowd") == F.col("_crowd"), F.lit(False)))
        .select(F.col("block").alias("a"), "b")
    )
    met = placed.select("item", "size", "block")
    seats = [
        ends.select("a", "b", own_shuffle(end).alias("_block"))
        .join(met, F.col("_block") == F.col("block"))
        .select("a", "b", F.lit(second).alias("second"), "item", "size")
        for end, ends, second in (("a", pairs, False), ("b", pairs.filter("a < b"), True))
    ]
    return compared_seats(seats[0].unionByName(seats[1]), members, compare)


def _members(shared: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    items = stored(shared.select("item").distinct())
    members = stored(fetch(items))
    dropped(items)
    return members


def star_labels(stars: DataFrame) -> DataFrame:
    """(`_node`, `component`, `size`): the representative that each linked item leads to in two steps.

    What has one label hangs together; what hangs together may have several.
    """
    up = saved(
        stars.filter("item <> hub").groupBy("item").agg(F.min("hub").alias("hub"))
    )
    again = up.select(own_shuffle("item").alias("_hub"), F.col("hub").alias("_top"))
    low = up.join(again, F.col("hub") == F.col("_hub"), "left").select(
        F.col("item").alias("_node"), F.coalesce("_top", "hub").alias("component")
    )
    tops = low.select(F.col("component").alias("_node"), "component").distinct()
    labels = saved(
        low.unionByName(tops).groupBy("_node").agg(F.min("component").alias("component"))
    )
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return labels.join(
        sizes.select(own_shuffle("component").alias("_component"), "size"),
        F.col("component") == F.col("_component"),
    ).select("_node", "component", "size")


def class_links(classes: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(`item`, `links`, `rep`): all links of each item of `classes` (`item`, `class`).

    `members` has (`item`, `rank`, `place`, `values`): an item counts `place` times, and `rep` is the
    smallest `rank` of the items it is linked to. Every two items of a class are compared, once.
    A class of up to BLOCK_ITEMS items is one block; of a larger one each pair of blocks meets, so
    its rows grow with the square of its size over BLOCK_ITEMS.
    """
    sizes = members.select(own_shuffle("item").alias("_item"), (F.octet_length("values") / 8).alias("size"))
    sized = classes.join(sizes, F.col("item") == F.col("_item")).drop("_item")
    placed = saved(
        dealt(sized.withColumn("spread", F.xxhash64("item")), "class").select(
            "item", "size", "class", "chunk"
        )
    )
    blocks = placed.select("class", F.xxhash64("class", "chunk").alias("block")).distinct()
    others = blocks.select(own_shuffle("class").alias("_class"), F.col("block").alias("b"))
    pairs = saved(
        blocks.join(others, (F.col("class") == F.col("_class")) & (F.col("block") <= F.col("b")))
        .select(F.col("block").alias("a"), "b")
    )
    met = placed.select("item", "size", F.xxhash64("class", "chunk").alias("block"))
    seats = [
        ends.select("a", "b", own_shuffle(end).alias("_block"))
        .join(met, F.col("_block") == F.col("block"))
        .select("a", "b", F.lit(second).alias("second"), "item", "size")
        for end, ends, second in (("a", pairs, False), ("b", pairs.filter("a < b"), True))
    ]
    counted = called(seats[0].unionByName(seats[1]), members, count_sides(percent), COUNTED)
    return counted.groupBy("item").agg(F.sum("links").alias("links"), F.min("rep").alias("rep"))


def linked_components(
    keys: DataFrame, fetch: Callable[[DataFrame], DataFrame], percent: int, extent: int = 0
) -> tuple[DataFrame, DataFrame]:
    """What hangs together of items that share keys: (`node`, `component`), and their members.

    `keys` has (`item`, `key`, `rank`, `place`), the first three long, with repeats if need be.
    `fetch` adds to items their `rank`, `place` and `values` (packed set). After the stars, the
    items of each key that has several stars are compared. Items without a link have no row. The
    links behind it are verified and hold every component together; `class_links` counts all.
    """
    shared = shared_keys(keys)
    members = _members(shared, fetch)
    compare = compare_sides(percent, extent=extent)
    stars = saved(star_links(shared, members, compare))
    known = star_labels(stars)
    crowd = F.when(F.col("size") >= BLOCK_ITEMS, F.col("component"))
    rows = saved(
        shared.join(known, F.col("item") == F.col("_node"), "left").select(
            "item", "key", F.coalesce("component", "item").alias("star"), crowd.alias("crowd")
        )
    )
    rest = saved(key_links(rows, members, compare))
    links = stars.unionByName(rest).select(F.col("item").alias("u"), F.col("hub").alias("v"))
    return components(links), members


def late_items(
    keys: DataFrame,
    fetch: Callable[[DataFrame], DataFrame],
    percent: int,
    may_match: Callable | None = None,
) -> DataFrame:
    """(`item`): items with a partner that comes before them, by `rank` and `place`.

    Takes what `linked_components` takes. The representative of a key is the first of its items, so
    most items that have an earlier partner find it there. Each of the others asks all items that
    come before it under one of its keys, where that is not just the one it was compared with.
    """
    return late_among(shared_keys(keys), fetch, percent, may_match)


def late_among(
    shared: DataFrame,
    fetch: Callable[[DataFrame], DataFrame],
    percent: int,
    may_match: Callable | None = None,
) -> DataFrame:
    """What `late_items` does, for written rows of keys that several items have, one of each."""
    members = _members(shared, fetch)
    compare = compare_sides(percent, may_match)
    stars = saved(star_links(shared, members, compare).filter("late IS NOT NULL").select("late"))
    told = stars.distinct().select(own_shuffle("late").alias("_late"))
    at = F.struct("rank", "place", "item")
    rows = shared.select("item", "key", at.alias("at"))
    firsts = rows.groupBy("key").agg(F.min("at").alias("first"))
    placed = saved(
        rows.join(
            firsts.select(own_shuffle("key").alias("_key"), "first"), F.col("key") == F.col("_key")
        ).drop("_key")
    )
    # An item was compared with the first of all its keys. It asks where another one comes before it.
    asked = rows.select("item").distinct().join(told, F.col("item") == F.col("_late"), "left_anti")
    leads = placed.groupBy("item").agg(F.min("first").alias("lead"))
    open_items = leads.join(
        asked.select(own_shuffle("item").alias("_item")), F.col("item") == F.col("_item")
    ).select(own_shuffle("item").alias("_item"), "lead")
    seconds = (
        placed.filter("at > first").groupBy("key").agg(F.min("at").alias("second"))
        .select(own_shuffle("key").alias("_key"), "second")
    )
    asks = (
        placed.filter("at > first")
        .join(open_items, F.col("item") == F.col("_item"))
        .join(seconds, F.col("key") == F.col("_key"))
        .filter("first <> lead OR at > second")
        .select("item", "key", "at")
    )
    asks = saved(asks)
    bounds = [F.col("at").alias("low"), F.col("at").alias("high")]
    wanted = asks.groupBy("key").agg(F.max("at").alias("last"))
    answers = rows.join(
        wanted.select(own_shuffle("key").alias("_key"), "last"),
        (F.col("key") == F.col("_key")) & (F.col("at") < F.col("last")),
    )
    # Keys under which the same items ask and answer are one.
    both = asks.select("item", "key", F.lit(0).alias("side")).unionByName(
        answers.select("item", "key", F.lit(1).alias("side"))
    )
    same = [F.bit_xor(F.xxhash64("item", "side", F.lit(i))).alias(f"_same{i}") for i in range(2)]
    chosen = saved(
        both.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *same)
        .groupBy("n", "_same0", "_same1").agg(F.min("key").alias("key"))
        .select(own_shuffle("key").alias("_key"))
    )
    asks, answers = (
        side.join(chosen.withColumnRenamed("_key", "_chosen"), F.col("key") == F.col("_chosen"), "left_semi")
        .select("item", "key", *bounds)
        for side in (asks, answers)
    )
    rest = block_links(asks, answers, "r_low < l_high", members, compare)
    found = rest.filter("late IS NOT NULL").select("late")
    return stars.unionByName(found).select(F.col("late").alias("item")).distinct()
