"""Benchmark decontamination by q-gram lemma filtering and banded alignment."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginflow.llm.frames import explode_batches, keep_rows, slices
from marginflow.llm.hashing import mixed, seeds

BLOCK_CHARS = 1_000_000  # characters of benchmark items searched for in one pass
BLANKLESS = 0x2E80  # scripts from this code point on write words without blanks
SLICE_BYTES = 1024 * 1024


@dataclass(frozen=True)
class Budget:
    """`q` characters in a gram; `percent` of an item's characters may be edits."""

    q: int = 10
    percent: int = 8

    def edits(self, n: int) -> int:
        """Edits allowed in an item of `n` characters: so many that a shared gram is left."""
        return max(0, min(self.percent * n // 100, (n - self.q) // self.q))

    def threshold(self, n: int) -> int:
        """Grams that a text within the budget shares with the item (q-gram lemma)."""
        return n - self.q + 1 - self.edits(n) * self.q


def plain(text: str | None) -> str:
    """Lower case, every run of white space as one blank."""
    return " ".join((text or "").lower().split())


def gram_hashes(points: np.ndarray, q: int) -> np.ndarray:
    """Hash of the `q` code points that start at each place."""
    if len(points) < q:
        return np.zeros(0, dtype=np.uint64)
    factors = seeds(2 * q.bit_length() + 2, 11) | np.uint64(1)
    wide, width, out, have = mixed(points.astype(np.uint64)), 1, None, 0
    rest, i = q, 0
    # Grams of 1, 2, 4, ... characters, and those that make up q put together.
    while rest:
        if rest & 1:
            if out is None:
                out = wide
            else:
                n = len(points) - have - width + 1
                out = out[:n] * factors[i] + wide[have : have + n]
            have += width
            i += 1
        rest >>= 1
        if rest:
            n = len(points) - 2 * width + 1
            wide = wide[:n] * factors[i] + wide[width : width + n]
            width *= 2
            i += 1
    return mixed(out[: len(points) - q + 1])


def points_of(texts: Sequence[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


@cache
def word_points() -> np.ndarray:
    """Code points that belong to one word with those beside them."""
    kinds = (chr(cp).isalnum() for cp in range(BLANKLESS))
    out = np.zeros(0x110000, dtype=bool)
    out[:BLANKLESS] = np.fromiter(kinds, dtype=bool, count=BLANKLESS)
    return out


def align(item: np.ndarray, region: np.ndarray, low: int, high: int, budget: int):
    """Fewest edits between `item` and a part of `region`, and where that part ends.

    The alignment starts on a diagonal (place in the region less place in the item) from `low`
    to `high` and stays in this band. None if more than `budget` edits are needed.
    """
    diagonals = np.arange(low, high + 1)
    far = len(item) + len(region)
    steps = np.arange(len(diagonals))
    outside = (diagonals < 0) | (diagonals > len(region))
    cost = np.where(outside, far, 0)
    for i, c in enumerate(item, 1):
        at = diagonals + i - 1
        inside = (at >= 0) & (at < len(region))
        differs = np.ones(len(diagonals), dtype=np.int64)
        differs[inside] = region[at[inside]] != c
        new = np.where(inside, cost + differs, far)
        new[:-1] = np.minimum(new[:-1], cost[1:] + 1)
        new[(diagonals + i < 0) | (diagonals + i > len(region))] = far
        new = np.minimum.accumulate(new - steps) + steps
        cost = new
        if cost.min() > budget:
            return None
    best = int(cost.argmin())
    return int(cost[best]), int(diagonals[best] + len(item))


class Index:
    """The q-grams of some benchmark items, and where texts share enough of them."""

    def __init__(self, items: Sequence[tuple[int | None, str]], budget: Budget):
        self.budget = budget
        every = [(i, plain(t)) for i, t in items]
        known = [(i, t) for i, t in every if len(t) >= budget.q]
        small = [(i, t) for i, t in every if 0 < len(t) < budget.q]
        self.ids = [i for i, _ in [*known, *small]]
        self.texts = [t for _, t in known]
        # Items shorter than a gram: by length the hashes, and by hash the items.
        self.small: dict[int, tuple[np.ndarray, list[str], list[list[int]]]] = {}
        for n in sorted({len(t) for _, t in small}):
            holders: dict[str, list[int]] = {}
            for k, (_, t) in enumerate(small, len(known)):
                if len(t) == n:
                    holders.setdefault(t, []).append(k)
            hashes = np.concatenate([gram_hashes(points_of([t]), n) for t in holders])
            order = np.argsort(hashes, kind="stable")
            names = list(holders)
            self.small[n] = (
                hashes[order],
                [names[j] for j in order],
                [holders[names[j]] for j in order],
            )
        self.points = [points_of([t]) for t in self.texts]
        sizes = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.sizes = sizes
        self.edits = np.array([budget.edits(n) for n in sizes], dtype=np.int64)
        self.needed = np.array([budget.threshold(n) for n in sizes], dtype=np.int64)
        self.step = np.maximum(self.edits + 1, 16)  # half of a band's width
        grams = [gram_hashes(p, budget.q) for p in self.points]
        flat = np.concatenate(grams) if grams else np.zeros(0, dtype=np.uint64)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else item
        order = np.argsort(flat, kind="stable")
        self.item, self.place = item[order], place[order]
        self.gram, self.start = np.unique(flat[order], return_index=True)
        self.stop = np.append(self.start[1:], len(flat))
        bits = max(16, math.ceil(math.log2(64 * len(flat) + 1)))
        self.shift = np.uint64(64 - bits)
        self.present = np.zeros(1 << bits, dtype=bool)
        self.present[(self.gram >> self.shift).astype(np.int64)] = True

    def regions(self, texts: Sequence[str]) -> Iterator[tuple[int, int, int]]:
        """(text, item, first diagonal) of bands in which a text shares enough grams.

        Band b of an item has the diagonals from b to b + 2 steps; bands overlap by a step,
        which is more than the edits allowed, so the diagonals of a match lie in one band.
        """
        if not self.texts:
            return
        flat = points_of(texts)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        hashes = gram_hashes(flat, self.budget.q)
        spot = np.flatnonzero(self.present[(hashes >> self.shift).astype(np.int64)])
        at = np.searchsorted(self.gram, hashes[spot])
        at[at == len(self.gram)] = 0
        right = self.gram[at] == hashes[spot]
        spot, at = spot[right], at[right]
        text = np.searchsorted(starts, spot, side="right") - 1
        whole = spot + self.budget.q <= starts[text + 1]  # not over the end of the text
        spot, at, text = spot[whole], at[whole], text[whole]
        times = self.stop[at] - self.start[at]
        many = np.repeat(np.arange(len(spot)), times)
        nth = np.arange(len(many)) - np.repeat(np.cumsum(times) - times, times)
        posting = self.start[at[many]] + nth
        item = self.item[posting]
        diagonal = spot[many] - starts[text[many]] - self.place[posting]
        step = self.step[item]
        band = (diagonal + self.sizes[item]) // step  # from 0 on
        pair = text[many] * len(self.ids) + item
        bands = int(band.max()) + 2 if len(band) else 2
        key = np.concatenate([pair * bands + band + 1, pair * bands + band])
        found, count = np.unique(key, return_counts=True)
        pair, band = found // bands, found % bands
        item = pair % len(self.ids)
        enough = count >= self.needed[item]
        for p, i, b in zip(pair[enough], item[enough], band[enough]):
            low = (b - 1) * self.step[i] - self.sizes[i]
            yield int(p // len(self.ids)), int(i), int(low)

    def whole_words(self, texts: Sequence[str]) -> Iterator[tuple[int, int, int]]:
        """(text, item, end) of items shorter than a gram, where each first stands by itself."""
        if not self.small:
            return
        flat = points_of(texts)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        word = word_points()[flat]
        joined = np.zeros(len(flat) + 1, dtype=bool)  # a word goes on over this place
        joined[1:-1] = word[:-1] & word[1:]
        joined[starts] = False
        for n, (hashes, names, holders) in self.small.items():
            grams = gram_hashes(flat, n)
            at = np.minimum(np.searchsorted(hashes, grams), len(hashes) - 1)
            free = ~joined[: len(grams)] & ~joined[n : n + len(grams)]
            spot = np.flatnonzero((hashes[at] == grams) & free)
            text = np.searchsorted(starts, spot, side="right") - 1
            inside = spot + n <= starts[text + 1]
            spot, text = spot[inside], text[inside]
            _, first = np.unique(text * len(hashes) + at[spot], return_index=True)
            for j in first:
                t, h = int(text[j]), int(at[spot[j]])
                place = int(spot[j] - starts[t])
                if texts[t][place : place + n] == names[h]:
                    for item in holders[h]:
                        yield t, item, place + n

    def matches(self, texts: Sequence[str]) -> dict[tuple[int, int], tuple[int, int]]:
        """(text, item) to (edits, end) of the best alignment within the budget."""
        out = {(t, i): (0, end) for t, i, end in self.whole_words(texts)}
        for t, i, low in self.regions(texts):
            if out.get((t, i), (1, 0))[0] == 0:
                continue
            n, k = int(self.sizes[i]), int(self.edits[i])
            high = low + 2 * int(self.step[i])
            start = max(0, low)
            region = texts[t][start : max(0, high + n + k)]
            here = region.find(self.texts[i])
            if here >= 0:
                out[t, i] = (0, start + here + n)
                continue
            if k == 0:
                continue
            best = align(self.points[i], points_of([region]), low - start, high - start, k)
            if best and (t, i) not in out or best and best[0] < out[t, i][0]:
                out[t, i] = (best[0], start + best[1])
        return out


_INDEXES: dict[str, Index] = {}


def index_of(items: Sequence[tuple[int | None, str]], budget: Budget) -> Index:
    """The index of a block of items, made once per worker process."""
    key = hashlib.sha256(repr((items, budget)).encode()).hexdigest()
    if key not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[key] = Index(items, budget)
    return _INDEXES[key]


def item_blocks(
    benchmark: DataFrame, text: str, item_id: str, block_chars: int
) -> Iterator[list[tuple[int | None, str]]]:
    """The benchmark in blocks of about `block_chars` characters, one after the other.

    Items are dealt to blocks by a digest, so only one block is held at a time. Items with a
    null text are left out; those with a null id are items like others.
    """
    rows = benchmark.select(
        F.col(item_id).cast("long").alias("id"), F.col(text).alias("text")
    ).filter(F.col("text").isNotNull())
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_chars))
    for b in range(blocks):
        mine = F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b
        found = rows.filter(mine).distinct().collect()
        if found:
            yield sorted(((r.id, r.text) for r in found), key=lambda x: (x[0] is not None, *x[::-1]))


def benchmark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    budget: Budget = Budget(),
    text: str = "text",
    doc_id: str = "doc_id",
    item_text: str = "text",
    item_id: str = "item_id",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(`doc_id`, `item_id`, `edits`, `end`): documents that hold a benchmark item.

    Both are compared in lower case with runs of white space as one blank. A document holds an
    item if a part of its whole text differs from the item in `budget.edits` characters at
    most, of which `end` is the place after the last in the plain text and `edits` the fewest
    found. By the q-gram lemma such a part shares a number of grams with the item on nearby
    diagonals; bands with so many are aligned. Every item is searched for in every text, in
    blocks of items that are broadcast one at a time; documents are not moved.

    Null and empty texts hold nothing, and empty items are in no text. An item shorter than a
    gram is found only as it is and not as a part of a longer word, so "yes" is not in
    "yesterday"; scripts without blanks have no such ends of words. Items that repeat are found
    each by its id; different items without an id give a row each, with a null `item_id`.
    Documents that repeat give a row each. Long texts are scanned whole. Without items or
    documents there are no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, item_id long, edits long, end long"
    found = docs.sparkSession.createDataFrame([], schema)
    for items in item_blocks(benchmark, item_text, item_id, block_chars):
        block = docs.sparkSession.sparkContext.broadcast(items)

        def compute(batch: pa.RecordBatch, block=block) -> Iterator[dict]:
            index = index_of(block.value, budget)
            texts = batch.column(batch.schema.get_field_index("text"))
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for start, end in slices(texts, SLICE_BYTES):
                hits = index.matches([plain(t) for t in texts[start:end].to_pylist()])
                yield {
                    "doc_id": ids.take(pa.array([start + t for t, _ in hits], type=pa.int64())),
                    "item_id": pa.array([index.ids[i] for _, i in hits], type=pa.int64()),
                    "edits": [edits for edits, _ in hits.values()],
                    "end": [stop for _, stop in hits.values()],
                }

        found = found.unionByName(explode_batches(rows, schema, compute))
    return found


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    budget: Budget = Budget(),
    text: str = "text",
    item_text: str = "text",
    item_id: str = "item_id",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The documents that hold no benchmark item, with the columns they came with.

    Judged row by row in the tasks that read them, so nothing is shuffled or joined. An item is
    held as `benchmark_hits` describes, also one that is short or has no id. Documents with a
    null or empty text stay, rows that repeat are judged alike, and without items or documents
    nothing changes.
    """
    out = docs
    for items in item_blocks(benchmark, item_text, item_id, block_chars):
        block = docs.sparkSession.sparkContext.broadcast(items)

        def clean(batch: pa.RecordBatch, block=block) -> np.ndarray:
            index = index_of(block.value, budget)
            texts = batch.column(batch.schema.get_field_index(text))
            keep = np.ones(len(texts), dtype=bool)
            for start, end in slices(texts, SLICE_BYTES):
                hits = index.matches([plain(t) for t in texts[start:end].to_pylist()])
                keep[[start + t for t, _ in hits]] = False
            return keep

        out = keep_rows(out, clean)
    return out
