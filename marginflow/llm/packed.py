"""Keys that several rows have, found without a row for every key.

Tasks pack their keys into arrays, a piece for each bucket of keys, and Spark shuffles the pieces. A
bucket's pieces are sorted at once. What a task has of a key many times it hands on only as
often as others need it, so a hot key is not many numbers in its bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marginflow.llm.frames import ship_code
from marginflow.llm.hashing import mixed

TASK_KEYS = 1 << 20  # that a task packs at a time
BUCKET_KEYS = 1 << 19  # about, of a bucket
CROWD = 64  # rows of a key from which a task thins them out
PAIRS = 1 << 22  # compared at a time

PIECES = "bucket int, settled boolean, data binary"


def packed(*columns: np.ndarray) -> bytes:
    """Arrays of one length as bytes, those of the same place in a number side by side."""
    return b"".join(c.view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns)


def unpacked(data: bytes, *kinds) -> list[np.ndarray]:
    kinds = [np.dtype(k) for k in kinds]
    n = len(data) // sum(k.itemsize for k in kinds)
    out, at = [], 0
    for kind in kinds:
        size = n * kind.itemsize
        raw = np.frombuffer(data, dtype=np.uint8, count=size, offset=at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(raw.T).view(kind).ravel())
        at += size
    return out


def pieces(key: np.ndarray, buckets: int, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Rows with sorted `key`, evenly spread numbers, cut into ranges of keys, one for a bucket."""
    edges = np.array([i * 2**64 // buckets for i in range(1, buckets)], dtype=np.uint64)
    ends = np.concatenate([[0], np.searchsorted(key, edges), [len(key)]])
    for bucket in np.flatnonzero(np.diff(ends)).tolist():
        some = slice(ends[bucket], ends[bucket + 1])
        # Steps between sorted keys are smaller numbers than keys.
        steps = np.diff(key[some], prepend=np.uint64(0))
        yield bucket, packed(steps, *(c[some] for c in columns))


def _batch(rows: list[tuple[int, bool, bytes]]) -> pa.RecordBatch:
    bucket, settled, data = zip(*rows)
    return pa.RecordBatch.from_pydict(
        {
            "bucket": pa.array(bucket, type=pa.int32()),
            "settled": pa.array(settled, type=pa.bool_()),
            "data": pa.array(data, type=pa.binary()),
        }
    )


def bucket_count(keys: int | None) -> int:
    return max(1, -(-int(keys or 0) // BUCKET_KEYS))


def repeated_keys(
    df: DataFrame, keys_of: Callable[[pa.RecordBatch], np.ndarray], total: int | None
) -> DataFrame:
    """(`key`): the numbers that `keys_of` finds twice or more in all batches of `df`.

    The keys are 64-bit hashes, about `total` of them.
    """
    ship_code(df.sparkSession)
    buckets = bucket_count(total)

    def found(keys: list[np.ndarray]) -> pa.RecordBatch:
        key = np.sort(np.concatenate(keys))
        # Two of a kind tell as much as many.
        third = np.zeros(len(key), dtype=bool)
        third[2:] = key[2:] == key[:-2]
        return _batch([(b, False, x) for b, x in pieces(key[~third], buckets)])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(keys_of(batch).astype(np.uint64, copy=False))
            n += len(held[-1])
            if n >= TASK_KEYS:
                yield found(held)
                held, n = [], 0
        if n:
            yield found(held)

    def several(table: pa.Table) -> pa.Table:
        parts = [np.cumsum(unpacked(x.as_py(), np.uint64)[0], dtype=np.uint64) for x in table["data"]]
        key = np.sort(np.concatenate(parts))
        again = np.zeros(len(key), dtype=bool)
        again[1:] = key[1:] == key[:-1]
        return pa.table({"key": pa.array(np.unique(key[again]).view(np.int64))})

    return df.mapInArrow(pack, PIECES).groupBy("bucket").applyInArrow(several, "key long")


def with_partner(
    key: np.ndarray, size: np.ndarray, place: np.ndarray, percent: int
) -> tuple[np.ndarray, np.ndarray]:
    """Which rows pass the length and positional filters with another one of their key.

    Rows are prefix tokens (`key`) of different sets: `size` of the set, `place` of the token in it.
    Also the rows that stand for the others: of a key and size the two with the least places are
    a partner wherever any other one is.
    """
    order = np.lexsort((place, size, key))
    key, size, place = key[order], size[order].astype(np.int64), place[order].astype(np.int64)
    n = len(key)
    new, kind = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
    new[1:] = key[1:] != key[:-1]
    kind[1:] = new[1:] | (size[1:] != size[:-1])
    chosen = kind.copy()
    chosen[1:] |= kind[:-1]
    group = np.cumsum(new) - 1
    partner = np.flatnonzero(chosen)
    count = np.bincount(group[partner], minlength=group[-1] + 1 if n else 0)
    begin = np.cumsum(count) - count
    pairs = count[group]
    ends = np.cumsum(pairs)
    alive = np.zeros(n, dtype=bool)
    at = 0
    while at < n:
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        rows = np.arange(at, upto)
        mine = pairs[rows]
        i = np.repeat(rows, mine)
        nth = np.arange(len(i)) - np.repeat(np.cumsum(mine) - mine, mine)
        j = partner[begin[group[i]] + nth]
        a, b = size[i], size[j]
        needed = -(-percent * (a + b) // (100 + percent))
        good = (i != j) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
        good &= np.minimum(a - place[i], b - place[j]) >= needed
        alive[i[good]] = True
        at = upto
    out, stands = np.empty(n, dtype=bool), np.empty(n, dtype=bool)
    out[order], stands[order] = alive, chosen
    return out, stands


def partner_rows(
    df: DataFrame,
    rows_of: Callable[[pa.RecordBatch], tuple[np.ndarray, ...]],
    percent: int,
    total: int | None,
) -> DataFrame:
    """(`item`, `key`): of all prefix tokens those that may lead to a similar set.

    `rows_of` makes of a batch (item, size, number of tokens, tokens) of its sets; copies of an item
    are the same set. A row stays if another item has the token and the length and positional
    filters let the two through; the first token that two similar sets share always does. There
    are about `total` tokens.
    """
    ship_code(df.sparkSession)
    buckets = bucket_count(total)
    kinds = (np.uint64, np.int64, np.uint32, np.uint32)

    def found(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch | None:
        item, size, count, tokens = (np.concatenate(c) for c in zip(*held))
        starts = np.cumsum(count) - count
        _, once = np.unique(item, return_index=True)
        n = count[once]
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        key = mixed(tokens[np.repeat(starts[once], n) + nth])
        order = np.argsort(key)
        key, place = key[order], nth[order].astype(np.uint32)
        owner = np.repeat(once, n)[order]
        names, sizes = item[owner], size[owner].astype(np.uint32)
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        out = []
        times = np.diff(np.append(np.flatnonzero(new), len(key)))
        crowd = np.flatnonzero(np.repeat(times >= CROWD, times))
        if len(crowd):
            alive, stands = with_partner(key[crowd], sizes[crowd], place[crowd], percent)
            settled = crowd[alive & ~stands]
            if len(settled):
                data = packed(names[settled], key[settled])
                out.append((int(names[settled[0]] % buckets), True, data))
            rest = np.ones(len(key), dtype=bool)
            rest[settled] = False
            key, names, sizes, place = (c[rest] for c in (key, names, sizes, place))
        out += [(b, False, x) for b, x in pieces(key, buckets, names, sizes, place)]
        return _batch(out) if out else None

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(rows_of(batch))
            n += len(held[-1][-1])
            if n >= TASK_KEYS:
                made = found(held)
                held, n = [], 0
                if made:
                    yield made
        if n:
            made = found(held)
            if made:
                yield made

    def joined(table: pa.Table) -> pa.Table:
        settled, open_rows = [], []
        for done, data in zip(table["settled"].to_pylist(), table["data"].to_pylist()):
            if done:
                settled.append(unpacked(data, np.int64, np.uint64))
            else:
                steps, *rest = unpacked(data, *kinds)
                open_rows.append((np.cumsum(steps, dtype=np.uint64), *rest))
        items, keys = [s[0] for s in settled], [s[1] for s in settled]
        if open_rows:
            key, item, size, place = (np.concatenate(c) for c in zip(*open_rows))
            order = np.argsort(key)
            same = key[order][1:] == key[order][:-1]
            shared = np.zeros(len(key), dtype=bool)
            shared[order[1:][same]] = shared[order[:-1][same]] = True
            some = np.flatnonzero(shared)
            some = some[np.lexsort((item[some], key[some]))]
            # The same item may come from several tasks.
            fresh = np.ones(len(some), dtype=bool)
            fresh[1:] = (key[some][1:] != key[some][:-1]) | (item[some][1:] != item[some][:-1])
            some = some[fresh]
            alive, _ = with_partner(key[some], size[some], place[some], percent)
            items.append(item[some[alive]])
            keys.append(key[some[alive]])
        return pa.table(
            {
                "item": pa.array(np.concatenate(items)),
                "key": pa.array(np.concatenate(keys).view(np.int64)),
            }
        )

    return df.mapInArrow(pack, PIECES).groupBy("bucket").applyInArrow(joined, "item long, key long")
