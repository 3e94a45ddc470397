import numpy as np
from pyspark.sql import functions as F

from marginflow.llm import packed
from marginflow.llm.hashing import mixed


def prefixes(n, seed=5):
    """Sets as (item, size, prefix tokens): crowds under a few tokens, and rare ones."""
    draw = np.random.default_rng(seed)
    out = []
    for item in range(n):
        size = int(draw.integers(5, 60))
        k = size + (-80 * size) // 100 + 1
        tokens = draw.permutation(np.concatenate([draw.integers(0, 4, 2), draw.integers(10, 3 * n, k)]))
        out.append((item * 7919 - 3000, size, [int(t) for t in dict.fromkeys(tokens.tolist())][:k]))
    return out


def wanted_rows(sets):
    """(item, token) of all that the filters let through with another item, pair by pair."""
    rows = [(i, s, p, t) for i, s, tokens in sets for p, t in enumerate(tokens)]
    out = set()
    for i, a, p, t in rows:
        for j, b, q, u in rows:
            if t == u and i != j and 100 * min(a, b) >= 80 * max(a, b):
                if min(a - p, b - q) >= -(-80 * (a + b) // 180):
                    out.add((i, t))
    return out


def test_prefix_tokens_without_a_partner_go_and_no_others(spark, monkeypatch):
    """A crowd is thinned out in its tasks, copies of an item count once, and no row is lost."""
    monkeypatch.setattr(packed, "TASK_KEYS", 200)
    monkeypatch.setattr(packed, "CROWD", 6)
    sets = prefixes(150)
    df = spark.createDataFrame(sets + sets[:40], "item long, size int, tokens array<long>")

    def rows_of(batch):
        tokens = batch.column("tokens")
        return (
            batch.column("item").to_numpy(), batch.column("size").to_numpy(),
            tokens.value_lengths().to_numpy().astype(np.int64),
            tokens.flatten().to_numpy().view(np.uint64),
        )

    rows = packed.partner_rows(df.repartition(5), rows_of, 80, 3 * packed.BUCKET_KEYS)
    tokens = np.arange(500, dtype=np.uint64)
    named = dict(zip(mixed(tokens).view(np.int64).tolist(), tokens.tolist()))
    found = [(r.item, named[r.key]) for r in rows.collect()]
    want = wanted_rows(sets)
    assert set(found) == want and len(found) == len(want)
    assert 0 < len(want) < sum(len(t) for _, _, t in sets) / 2


def test_keys_that_repeat(spark, monkeypatch):
    monkeypatch.setattr(packed, "TASK_KEYS", 100)
    df = spark.range(0, 3000, 1, 7).select(F.xxhash64(F.col("id") % 2000).alias("key"))
    df = df.unionByName(df.filter("key % 50 = 0"))
    found = packed.repeated_keys(
        df, lambda b: b.column("key").to_numpy().view(np.uint64), 3 * packed.BUCKET_KEYS
    )
    want = {r.key for r in df.groupBy("key").count().filter("count > 1").collect()}
    got = [r.key for r in found.collect()]
    assert set(got) == want and len(got) == len(want)
    assert packed.repeated_keys(df.limit(0), lambda b: b.column("key").to_numpy(), None).collect() == []
