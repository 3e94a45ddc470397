import random

import numpy as np
import pytest
import xxhash
from llm.plain_versions import classes
from pyspark.sql import functions as F

from marginflow.llm import simhash

DISTANCE = simhash.DISTANCE


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64(s, seed=42).intdigest()
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def brute(values):
    """Smallest place each value hangs together with."""
    x = np.array(values, dtype=np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= DISTANCE
    return classes(len(x), {i: set(np.flatnonzero(near[i])) - {i} for i in range(len(x))})


def groups(spark, values):
    df = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "value long")
    return {np.int64(r.value).view(np.uint64).item(): r.component for r in simhash.near_values(df).collect()}


def same_partition(values, found):
    """Whether two values have one component just where brute force says so."""
    label = brute(values)
    sizes = np.bincount(label, minlength=len(values))
    assert set(found) == {v for v, l in zip(values, label) if sizes[l] > 1}
    names = {}
    for v, l in zip(values, label):
        if sizes[l] > 1:
            assert names.setdefault(l, found[v]) == found[v]
    assert len(set(names.values())) == len(names)


def test_fingerprints_as_the_contract_says(spark, docs, odd):
    rows = [*odd, (20, "A b C d"), (21, "a B c D"), (22, "É É É É"), (23, "é é é é"), (24, "one two"),
            (25, "a\u00a0b c\x0bd e"), (26, "x " * 70_000), (27, "a b c d e f a b c d")]
    got = simhash.fingerprints(docs(rows, clashing=True)).collect()
    assert [np.int64(r.simhash).view(np.uint64).item() for r in got] == [plain_fingerprint(t) for _, t in rows]
    # The hash is Spark's own.
    one = spark.createDataFrame([("a b c d",)], "s string").select(F.xxhash64("s")).first()[0]
    assert np.int64(one).view(np.uint64).item() == xxhash.xxh64(b"a b c d", seed=42).intdigest()


def clustered(draw, n, centres, flips, biased=False):
    """Values near some centres, others anywhere; with `biased` half of the bits hardly vary."""
    values = set()
    base = [draw.getrandbits(64) for _ in range(centres)]
    while len(values) < n:
        v = draw.choice(base)
        for _ in range(draw.randint(0, flips)):
            v ^= 1 << draw.randrange(64)
        if draw.random() < 0.3:
            v = draw.getrandbits(64)
        if biased:
            v &= 0xFFFFFFFF | 1 << draw.randrange(32, 64)
        values.add(v)
    return sorted(values)


@pytest.mark.parametrize("biased", [False, True])
def test_components_against_brute_force(spark, biased):
    values = clustered(random.Random(5 + biased), 1500, 60, 6, biased)
    same_partition(values, groups(spark, values))


def test_links_at_the_distance_and_one_beyond(spark):
    draw = random.Random(9)
    values = []
    for _ in range(120):
        v = draw.getrandbits(64)
        values.append(v)
        for k in (4, 5):
            w = v
            for b in draw.sample(range(64), k):
                w ^= 1 << b
            values.append(w)
    values = sorted(set(values))
    same_partition(values, groups(spark, values))


def test_a_crowded_region_is_not_compared_with_itself(spark):
    """Thousands of values within a few bits of each other, and strangers beside them."""
    draw = random.Random(2)
    centre = draw.getrandbits(64)
    places = draw.sample(range(64), 18)
    values = {centre}
    while len(values) < 3000:
        v = centre
        for b in draw.sample(places, draw.randint(0, 9)):
            v ^= 1 << b
        values.add(v)
    values |= {centre ^ draw.getrandbits(64) for _ in range(200)}
    values = sorted(values)
    df = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "value long")
    parts = simhash.planned(df, len(values))
    first = simhash.runs_of_neighbours(df, parts)
    assert first.count() <= len(values) * len(parts)
    same_partition(values, groups(spark, values))


def test_empty_and_single(spark):
    assert groups(spark, []) == {} and groups(spark, [7]) == {}
    assert set(groups(spark, [0, 1])) == {0, 1}
    assert groups(spark, [0, 2**64 - 1]) == {}


def test_thresholds_add_up_and_are_unequal_where_bits_are(spark):
    draw = np.random.default_rng(3)
    x = draw.integers(0, 2**63, 4000, dtype=np.uint64)
    skewed = x & np.uint64(0x00000000FFFFFFFF)  # half of the bits never vary
    for values in (x, skewed):
        bits = simhash._bits(values).astype(np.int64)
        groups_ = simhash.group_bits(bits.T @ bits, len(values))
        assert sorted(b for g in groups_ for b in g) == list(range(64))
        codes = simhash.group_codes(values, groups_)
        counts = np.stack([np.bincount(c, minlength=256) for c in codes])
        for n in (len(values), 10**7, 10**10):
            parts = simhash.plan_parts(groups_, counts, n)
            assert sum(p.threshold + 1 for p in parts) == DISTANCE + 1
            assert sorted(b for p in parts for b in p.bits) == list(range(64))
    assert len({p.threshold for p in parts}) > 1


def test_correlated_bits_share_a_group():
    draw = np.random.default_rng(4)
    free = draw.integers(0, 2, (5000, 8))
    bits = free[:, np.arange(64) % 8] ^ (draw.random((5000, 64)) < 0.05)  # bit b follows b % 8
    found = simhash.group_bits(bits.T @ bits, 5000)
    assert {frozenset(b % 8 for b in g) for g in found} == {frozenset([r]) for r in range(8)}


def test_dynamic_program_against_all_choices():
    from itertools import product

    draw = random.Random(1)
    for _ in range(20):
        m = draw.choice([2, 3, 4])
        widths = [draw.choice([8, 16, 24]) for _ in range(m)]
        near = [np.cumsum(np.array([draw.random() ** 9 for _ in range(w + 1)])) for w in widths]
        n = draw.choice([100, 10**6])

        def cost(ts):
            return sum(
                n * simhash.ball(w, t) + n * n * s[t] * simhash.CANDIDATE
                for w, s, t in zip(widths, near, ts)
                if t >= 0
            )

        best = min(cost(ts) for ts in product(range(-1, 5), repeat=m) if sum(t + 1 for t in ts) == 5)
        assert simhash.allocate(widths, near, n, 4)[0] == pytest.approx(best)


def test_documents_and_their_components(spark, docs, odd):
    base = [f"w{i}" for i in range(400)]
    near = [*base[:200], "changed", *base[201:]]
    rows = [*odd, (30, " ".join(base)), (31, " ".join(base)), (29, " ".join(near)), (32, "entirely other words stand here")]
    got = simhash.simhash_groups(docs(rows, clashing=True)).collect()
    assert len(got) == len(rows)
    values = [plain_fingerprint(t) for _, t in rows]
    label = brute(values)
    want = []
    for (i, _), v, l in zip(rows, values, label):
        ids = [j for (j, _), m in zip(rows, label) if m == l and j is not None]
        want.append((str(i), f"{v:016x}", str(min(ids) if ids else None)))
    assert sorted(want) == sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got)
    assert simhash.simhash_groups(docs([])).collect() == []
    assert simhash.simhash_groups(docs([(None, "a b")])).first().component_id is None


def test_query_on_a_whole_table_against_brute_force(spark):
    from marginflow.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    values = [plain_fingerprint(t) for _, t in rows]
    x = np.array(values, dtype=np.uint64)
    label = np.arange(len(x))
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= DISTANCE
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            break
        label = new
    ids = np.array([i for i, _ in rows])
    want = {(int(i), f"{v:016x}", int(ids[label == l].min())) for i, v, l in zip(ids, values, label)}
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in QUERIES["op12_simhash"](spark, folder).collect()}
    assert got == want and len({c for _, _, c in got}) < len(rows)
