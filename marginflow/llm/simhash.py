"""SimHash near duplicates by a generalised pigeonhole: unequal thresholds on groups of bits.

Two fingerprints differ in DISTANCE bits at most. If the 64 bits are split into m parts with
thresholds of DISTANCE - m + 1 in all, then in some part they differ in no more bits than that
part's threshold: otherwise each part would have one more, DISTANCE + 1 in all. Correlated bits go
to one group, parts are runs of groups, and a dynamic program gives each part its threshold (or
none) by the number of probes and of candidates it would cost, estimated from the fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb, inf

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginflow.llm.components import components
from marginflow.llm.frames import (
    append_columns,
    explode_batches,
    own_shuffle,
    saved,
    ship_code,
    slices,
    stored,
    summed_arrays,
)
from marginflow.llm.hashing import mixed, seeds
from marginflow.llm.links import reachable

BITS = 64
DISTANCE = 4
WIDTH = 4  # words of a shingle
SEED = 42
GROUP = 8  # bits whose joint counts are taken
PARTS = (2, 3, 4, 5)  # how many parts are tried
PROBE, CANDIDATE = 1.0, 4.0  # cost of a probe that is made and of a candidate that is compared
CHUNK = 1 << 16  # shingles, or probes, at a time
SLICE_BYTES = 2 * 1024 * 1024
NEXT = 16  # fingerprints behind each in a sorted run that it is compared with
LEAST_MAP, MOST_MAP = 1 << 20, 1 << 28  # bits of the map of index keys, 128 KB to 32 MB


# --- fingerprints -----------------------------------------------------------------------------


def shingle_hashes(data: bytes, width: int = WIDTH) -> Iterator[np.ndarray]:
    """XXH64 of the `width`-word shingles of a text in UTF-8, A-Z lower-cased, some at a time."""
    words = data.lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    n = max(1, len(words) - width + 1)
    first, last = ends[:n] - lengths[:n], ends[min(width, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        pairs = zip(first[at : at + CHUNK].tolist(), last[at : at + CHUNK].tolist())
        yield np.array([digest(joined[a:b], SEED) for a, b in pairs], dtype=np.uint64)


def fingerprint(data: bytes, width: int = WIDTH) -> int:
    """Bits that over half of the shingles' hashes have; 0 without words."""
    n, ones = 0, np.zeros(BITS, dtype=np.int64)
    for hashes in shingle_hashes(data, width):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0]) if n else 0


def fingerprints(docs: DataFrame, text: str = "text", keep=None) -> DataFrame:
    """`docs` with `simhash`, the fingerprint as a signed number; null text counts as empty."""

    def compute(batch: pa.RecordBatch) -> dict:
        texts = batch.column(batch.schema.get_field_index(text))
        values = [fingerprint(v.as_buffer().to_pybytes()) if v.is_valid else 0 for v in texts]
        return {"simhash": pa.array(np.array(values, dtype=np.uint64).view(np.int64))}

    return append_columns(docs, T.StructType([T.StructField("simhash", T.LongType())]), compute, keep)


# --- groups, parts and thresholds -----------------------------------------------------------------


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _values(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def group_bits(together: np.ndarray, n: int) -> list[list[int]]:
    """Groups of GROUP bits, correlated ones together.

    `together` counts how often two bits are both 1. Each group starts with the bit that is
    correlated most to all that are left, and takes those most correlated to what it has.
    """
    p = np.diag(together) / n
    spread = np.sqrt(np.maximum(p * (1 - p), 0))
    scale = np.outer(spread, spread)
    related = np.abs(together / n - np.outer(p, p))
    related = np.divide(related, scale, out=np.zeros_like(related), where=scale > 0)
    np.fill_diagonal(related, 0)
    left, groups = list(range(len(p))), []
    while left:
        own = [max(left, key=lambda b: (related[b, left].sum(), -b))]
        left.remove(own[0])
        while len(own) < GROUP and left:
            best = max(left, key=lambda b: (related[b, own].sum(), -b))
            own.append(best)
            left.remove(best)
        groups.append(own)
    return groups


def group_codes(values: np.ndarray, groups: list[list[int]]) -> np.ndarray:
    """(groups, values): the bits of each group as a number."""
    bits = _bits(values)
    weights = 1 << np.arange(GROUP)
    return np.stack([bits[:, own] @ weights[: len(own)] for own in groups])


def distances_in(counts: np.ndarray) -> np.ndarray:
    """How two values drawn from these counts differ: share of pairs by number of bits."""
    codes = np.flatnonzero(counts)
    share = counts[codes] / counts.sum()
    apart = np.bitwise_count(codes[:, None] ^ codes[None, :])
    return np.bincount(apart.ravel(), np.outer(share, share).ravel(), minlength=GROUP + 1)


@dataclass(frozen=True)
class Part:
    bits: tuple[int, ...]
    threshold: int  # -1: the part is not probed


def ball(width: int, radius: int) -> int:
    return sum(comb(width, r) for r in range(radius + 1))


def allocate(widths: list[int], near: list[np.ndarray], n: int, distance: int) -> tuple[float, list[int]]:
    """Thresholds of the parts with the least cost, and that cost, by dynamic programming.

    `near` has for each part the share of pairs that differ in so many of its bits or fewer.
    """
    best = {0: (0.0, [])}  # by the sum of threshold + 1
    for width, share in zip(widths, near):
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, distance + 1):
                probes = n * ball(width, t) * PROBE if t >= 0 else 0.0
                met = n * n * share[min(t, len(share) - 1)] * CANDIDATE if t >= 0 else 0.0
                key, total = used + t + 1, cost + probes + met
                if key <= distance + 1 and total < new.get(key, (inf,))[0]:
                    new[key] = (total, [*chosen, t])
        best = new
    return best[distance + 1]


def plan_parts(groups: list[list[int]], counts: np.ndarray, n: int, distance: int = DISTANCE) -> list[Part]:
    """The parts and thresholds with the least cost, of all numbers of parts that are tried.

    Within a group the share of near pairs is from joint counts of all fingerprints; groups count as
    independent of each other.
    """
    inside = [distances_in(c) for c in counts]
    best: tuple[float, list[Part]] = (inf, [])
    for m in PARTS:
        runs = np.array_split(np.arange(len(groups)), m)
        near, parts = [], []
        for run in runs:
            share = np.ones(1)
            for g in run:
                share = np.convolve(share, inside[g])
            near.append(np.cumsum(share))
            parts.append(tuple(b for g in run for b in groups[g]))
        # Sum of threshold + 1 over m parts is distance + 1: thresholds of distance - m + 1.
        cost, chosen = allocate([len(p) for p in parts], near, n, distance)
        if cost < best[0]:
            best = (cost, [Part(bits, t) for bits, t in zip(parts, chosen)])
    return best[1]


def mask_of(bits) -> int:
    return sum(1 << int(b) for b in bits)


def part_masks(part: Part) -> np.ndarray:
    """All changes of up to `threshold` bits of the part, none first."""
    out = [mask_of(c) for r in range(part.threshold + 1) for c in combinations(part.bits, r)]
    return np.array(out, dtype=np.uint64)


def part_keys(values: np.ndarray, number: int, part: Part) -> np.ndarray:
    """Key of the bits of a part; other parts have other keys."""
    own = values & np.uint64(mask_of(part.bits))
    return mixed(own ^ seeds(number + 1, 31)[number])


def planned(values: DataFrame, n: int) -> list[Part]:
    """Parts for the fingerprints `values` (one column), from two passes of bounded counts over all."""

    def together(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((BITS, BITS), dtype=np.int64)
        for batch in batches:
            x = _bits(_values(batch)).astype(np.float32)
            for at in range(0, len(x), CHUNK):
                out += np.rint(x[at : at + CHUNK].T @ x[at : at + CHUNK]).astype(np.int64)
        return out.ravel()

    both = summed_arrays(values, together, "int64").reshape(BITS, BITS)
    groups = group_bits(both, n)

    def joint(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((len(groups), 1 << GROUP), dtype=np.int64)
        for batch in batches:
            for g, codes in enumerate(group_codes(_values(batch), groups)):
                out[g] += np.bincount(codes, minlength=1 << GROUP)
        return out.ravel()

    counts = summed_arrays(values, joint, "int64").reshape(len(groups), -1)
    return plan_parts(groups, counts, n)


# --- links ----------------------------------------------------------------------------------------


def gathered(values: np.ndarray, order: list[int]) -> np.ndarray:
    """The values with their bits in another order, the first of it highest, as signed numbers."""
    bits = _bits(values)[:, order[::-1]]
    packed = np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view(np.uint64).ravel()
    return (packed ^ np.uint64(1 << 63)).view(np.int64)  # sorts as the unsigned one


def runs_of_neighbours(values: DataFrame, parts: list[Part], distance: int = DISTANCE) -> DataFrame:
    """Links (`u`, `v`) between fingerprints that stand near each other in one of some sorted orders.

    Each part in turn comes first in the order. A fingerprint is compared with the next NEXT in its
    task, and of those that hang together there each is linked to the smallest, so there are as
    many rows as fingerprints and orders at most. All are true links; far from all are found.
    """
    orders = [
        [b for p in (*parts[i:], *parts[:i]) for b in p.bits] for i in range(len(parts))
    ]

    def spread(batch: pa.RecordBatch) -> Iterator[dict]:
        own = _values(batch)
        for i, order in enumerate(orders):
            yield {
                "turn": pa.array(np.full(len(own), i, dtype=np.int32)),
                "place": pa.array(gathered(own, order)),
                "value": pa.array(own.view(np.int64)),
            }

    rows = explode_batches(values, "turn int, place long, value long", spread)
    n = max(1, int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartitionByRange(n, "turn", "place").sortWithinPartitions("turn", "place")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, own = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.uint64)
        for batch in batches:
            fresh = batch.column(2).to_numpy().view(np.uint64)
            # The last few of the batch before are met again.
            turn = np.concatenate([turn[-NEXT:], batch.column(0).to_numpy()])
            own = np.concatenate([own[-NEXT:], fresh])
            found = []
            for step in range(1, min(NEXT, len(own) - 1) + 1):
                near = np.bitwise_count(own[step:] ^ own[:-step]) <= distance
                at = np.flatnonzero(near & (turn[step:] == turn[:-step]))
                found.append(np.stack([at, at + step]))
            a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), dtype=np.int64)
            label = reachable(len(own), a, b)
            some = np.flatnonzero(label != np.arange(len(own)))
            yield pa.RecordBatch.from_pydict(
                {
                    "u": pa.array(own[some].view(np.int64)),
                    "v": pa.array(own[label[some]].view(np.int64)),
                }
            )

    ship_code(values.sparkSession)
    return rows.mapInArrow(link, "u long, v long")


def key_map(index: DataFrame, n_keys: int) -> np.ndarray:
    """Which key digests the index has: a bitmap of a size between fixed bounds.

    Where there are more keys than bits it lets more probes through, and the result is the same.
    """
    bits = min(MOST_MAP, max(LEAST_MAP, 1 << (32 * max(1, n_keys) - 1).bit_length()))
    bit = F.pmod(F.col("key"), F.lit(bits)) + 1
    rows = (
        index.select(bit.alias("bit"))
        .groupBy(F.bitmap_bucket_number("bit").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map"))
    )
    out = np.zeros(bits // 8, dtype=np.uint8)
    size = 32768 // 8
    for batch in rows.toArrow().to_batches():
        for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            out[(bucket - 1) * size : bucket * size] = np.frombuffer(data, dtype=np.uint8)
    return out


def probes_of(nodes: DataFrame, parts: list[Part], held) -> DataFrame:
    """(`key`, `value`, `component`, `size`) for all keys near those of each node that may exist."""
    used = [(i, p, part_masks(p)) for i, p in enumerate(parts) if p.threshold >= 0]

    def compute(batch: pa.RecordBatch) -> Iterator[dict]:
        own = _values(batch)
        component, size = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        bitmap = held.value
        bits = np.uint64(len(bitmap) * 8)
        for number, part, masks in used:
            step = max(1, CHUNK // len(masks))
            for at in range(0, len(own), step):
                near = own[at : at + step, None] ^ masks[None, :]
                keys = part_keys(near.ravel(), number, part)
                # As pmod of the signed key, of which the number of bits is a divisor.
                spot = keys % bits
                some = np.flatnonzero(
                    bitmap[(spot >> np.uint64(3)).astype(np.int64)]
                    >> (spot & np.uint64(7)).astype(np.uint8)
                    & np.uint8(1)
                )
                who = at + some // len(masks)
                yield {
                    "key": pa.array(keys[some].view(np.int64)),
                    "value": pa.array(own[who].view(np.int64)),
                    "component": pa.array(component[who]),
                    "size": pa.array(size[who]),
                }

    return explode_batches(nodes, "key long, value long, component long, size long", compute)


def index_of(nodes: DataFrame, parts: list[Part]) -> DataFrame:
    """(`key`, `value`, `component`, `size`): the key of each part that is probed."""
    own = [Part(p.bits, 0 if p.threshold >= 0 else -1) for p in parts]

    def compute(batch: pa.RecordBatch) -> Iterator[dict]:
        values = _values(batch)
        for number, part in enumerate(own):
            if part.threshold >= 0:
                yield {
                    "key": pa.array(part_keys(values, number, part).view(np.int64)),
                    "value": pa.array(values.view(np.int64)),
                    "component": batch.column(1),
                    "size": batch.column(2),
                }

    return explode_batches(nodes, "key long, value long, component long, size long", compute)


def near_values(values: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(`value`, `component`): what hangs together of different `values`, one column, none null.

    Links found in sorted runs join most of what is near first. Then every value probes the keys
    within the thresholds, and is compared with the values there that are of another component,
    the smaller component with the larger. So a crowded region, which is one component by then,
    is not compared with itself, and what the join returns are links between components alone.
    No link is lost: two values within the distance are of one component, or meet in some part.
    Values without a link have no row.
    """
    spark = values.sparkSession
    n = values.count()
    if n < 2:
        return spark.createDataFrame([], "value long, component long")
    parts = planned(values, n)
    first = components(runs_of_neighbours(values, parts, distance))
    sizes = first.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    known = first.join(
        sizes.select(own_shuffle("component").alias("_component"), "size"),
        F.col("component") == F.col("_component"),
    ).select(F.col("node").alias("_value"), "component", "size")
    nodes = saved(
        values.join(known, F.col("value") == F.col("_value"), "left").select(
            "value",
            F.coalesce("component", "value").alias("component"),
            F.coalesce("size", F.lit(1)).cast("long").alias("size"),
        )
    )
    index = stored(index_of(nodes, parts))
    held = spark.sparkContext.broadcast(key_map(index, n * sum(p.threshold >= 0 for p in parts)))
    rank = F.struct("size", "component")
    # The last component of each key: of its members none has anything to ask.
    last = index.groupBy("key").agg(F.max(rank).alias("last"))
    asked = probes_of(nodes, parts, held).join(
        last.select(own_shuffle("key").alias("_key"), "last"),
        (F.col("key") == F.col("_key")) & (rank < F.col("last")),
    ).drop("_key", "last")
    there = index.select(
        own_shuffle("key").alias("_key"),
        F.col("value").alias("_value"),
        F.col("component").alias("_component"),
        F.struct("size", "component").alias("_rank"),
    )
    links = asked.join(
        there,
        (F.col("key") == F.col("_key"))
        & (rank < F.col("_rank"))
        & (F.bit_count(F.col("value").bitwiseXOR(F.col("_value"))) <= distance),
    )
    between = components(
        links.select(F.col("component").alias("u"), F.col("_component").alias("v"))
    ).select(F.col("node").alias("_component"), F.col("component").alias("_to"))
    return (
        nodes.join(between, F.col("component") == F.col("_component"), "left")
        .filter("size > 1 OR _to IS NOT NULL")
        .select("value", F.coalesce("_to", "component").alias("component"))
    )


def simhash_groups(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", distance: int = DISTANCE
) -> DataFrame:
    """Every document (`doc_id`) with its `fingerprint` and `component_id`.

    The fingerprint has a bit where over half of the XXH64 (seed 42) of the 4-word shingles have
    it, as 16 hexadecimal digits; A-Z are lower-cased, words are runs of anything but ASCII white
    space, and a text of 1 to 3 words is one shingle. Documents whose fingerprints differ in
    `distance` bits or fewer are linked, and `component_id` is the smallest id that can be reached.

    Equal fingerprints are one value, so copies make no pairs. Null, empty and blank texts have
    fingerprint zero and are linked like any other. A null id names no component but is in one;
    a component of null ids alone is null. Rows that repeat an id stay rows of their own. Other
    columns do not matter. An empty table gives no rows.
    """
    renamed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = stored(fingerprints(renamed, "text", ["doc_id"]))
    values = saved(
        rows.groupBy(F.col("simhash").alias("value")).agg(F.min("doc_id").alias("first_id"))
    )
    near = saved(near_values(values.select("value"), distance))
    firsts = near.join(
        values.select(own_shuffle("value").alias("_value"), "first_id"),
        F.col("value") == F.col("_value"),
    )
    names = firsts.groupBy("component").agg(F.min("first_id").alias("name"))
    named = near.join(
        names.select(own_shuffle("component").alias("_component"), "name"),
        F.col("component") == F.col("_component"),
    ).select(own_shuffle("value").alias("_in"), "name")
    # By value: its component's name, or its own smallest id. A hot value is split where it is joined.
    every = values.join(named, F.col("value") == F.col("_in"), "left").select(
        own_shuffle("value").alias("_value"),
        F.when(F.col("_in").isNull(), F.col("first_id")).otherwise(F.col("name")).alias("component_id"),
    )
    return rows.join(every, F.col("simhash") == F.col("_value")).select(
        "doc_id",
        F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"),
        "component_id",
    )
