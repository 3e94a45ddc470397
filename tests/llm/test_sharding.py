import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from marginflow.llm.sharding import digest, shard


def check(rows, n, texts):
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r.shard].append(r)
    assert set(by_shard) <= set(range(n))
    for members in by_shard.values():
        assert sorted(r.slot for r in members) == list(range(len(members)))
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert r["size"] == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
    total = sum(r["size"] for r in rows)
    largest = max(r["size"] for r in rows)
    sizes = [sum(r["size"] for r in by_shard[k]) for k in range(n)]
    assert all(abs(s - total / n) <= largest for s in sizes)
    # Contiguous: the shards follow each other in the order of the text's hash.
    return by_shard


def test_near_equal_bytes(docs):
    rows = [(i, f"text {i % 700} " * (1 + i * 37 % 23)) for i in range(3000)]
    df = docs(rows)
    got = digest(df).collect()
    check(got, 8, dict(rows))
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    groups = defaultdict(set)
    for r in got:
        groups[dict(rows)[r.doc_id]].add(r.shard)
    assert sum(len(s) > 1 for s in groups.values()) <= 7  # groups are cut at 7 places at most


def test_contiguous_in_the_global_order(docs):
    df = docs([(i, f"t{i}") for i in range(500)])
    placed = shard(df, 5).withColumn("h", F.xxhash64("text"))
    ends = placed.groupBy("shard").agg(F.min("h").alias("a"), F.max("h").alias("b"))
    spans = [(r.a, r.b) for r in ends.orderBy("shard").collect()]
    assert all(spans[i][1] < spans[i + 1][0] for i in range(4))


def test_hot_text_is_spread(docs):
    rows = [(i, "the same text" if i % 3 else f"other {i}") for i in range(900)]
    check(digest(docs(rows), 4).collect(), 4, dict(rows))


def test_odd_rows(docs, odd):
    df = docs(odd, clashing=True)
    out = shard(df)
    got = out.collect()
    assert len(got) == len(odd) and len(set(out.columns)) == len(out.columns)
    assert {"size", "shard", "slot", "text_crc32", "row", "item"} <= set(out.columns)
    for r in got:
        assert r["size"] == len((r.text or "").encode()) + 1 and r.row == "x"
    assert {(r.shard, r.slot) for r in got}.__len__() == len(odd)
    assert shard(docs([])).collect() == []
