import random
from collections import Counter, defaultdict

from marginflow.llm.mixing import copies, mix


def targets(sizes, weights=(1, 2, 3), most=3):
    """Share by weight, cap, reshare what is above the caps, until nothing is."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, free, rest = {}, set(order), sum(sizes.values())
    while free:
        level = rest / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] > most * sizes[s]]
        if not over:
            out.update({s: level * w[s] for s in free})
            break
        for s in over:
            out[s] = most * sizes[s]
            rest -= out[s]
            free.discard(s)
    return out


def corpus(n=1200, seed=5):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        source = draw.choice(["a", "b", "b", "b", "c", "d", "é", None, "tiny" if i < 60 else "a"])
        words = min(400, int(draw.paretovariate(0.9)))
        rows.append((i, " ".join(f"w{i}-{k}" for k in range(words)), "en", source))
    return rows


def test_targets_and_whole_result(docs):
    rows = corpus()
    got = mix(docs(rows)).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(rows)))
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        assert r["size"] == len(r.text.split()) and r.taken == r["copies"] * r["size"]
        assert r.taken <= 3 * r["size"] and len(r["shards"]) == r["copies"]
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    want = targets(size)
    for s in size:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - target[s]) <= max(5, target[s] / 100)
    assert all(r.source_size == size[r.source] for r in got)


def test_shards_get_equal_shares_of_blocks_at_random(docs):
    rows = [(i, "one two three", "en", "ab"[i % 2]) for i in range(4000)]
    got = mix(docs(rows), shards=4)
    by = copies(got).groupBy("mix_shard", "source").count().collect()
    total = defaultdict(int)
    for r in by:
        total[r.mix_shard] += r["count"]
    assert len(total) == 4 and max(total.values()) < 1.25 * min(total.values())
    drawn = Counter(r.source for r in copies(got).select("source").collect())
    assert drawn["b"] > 1.9 * drawn["a"]


def test_reruns_agree_whatever_the_partitions(docs):
    rows = corpus(300)
    a = mix(docs(rows)).select("doc_id", "taken", "shards").collect()
    b = mix(docs(rows[::-1]).repartition(7)).select("doc_id", "taken", "shards").collect()
    assert sorted(map(repr, a)) == sorted(map(repr, b))


def test_native_plan(docs):
    plan = mix(docs(corpus(50)))._jdf.queryExecution().toString()
    assert not any(k in plan for k in ("Python", "Pandas", "ArrowEval", "MapInArrow"))


def test_odd_rows(docs, odd):
    df = docs(odd, clashing=True)
    out = mix(df)
    got = out.collect()
    assert len(got) == len(odd) and len(set(out.columns)) == len(out.columns)
    same = [r.taken for r in got if r.doc_id == 1]
    assert same[0] == same[1]  # repeated rows are drawn together
    assert all(r.taken == 0 for r in got if not (r.text or "").split())
    spread = copies(out)
    assert spread.count() == sum(r["copies"] for r in got)
    assert mix(docs([])).collect() == []
    blank = mix(docs([(1, None), (2, "")])).collect()
    assert [r.taken for r in blank] == [0, 0] and [r.target for r in blank] == [0.0, 0.0]


def test_a_source_of_which_one_document_holds_half(docs):
    short = [(i, " ".join(f"w{k}" for k in range(1 + i % 20)), "en", "a") for i in range(400)]
    total = sum(len(r[1].split()) for r in short)
    # As one document, and as equal rows that are drawn together.
    long = [(1000, " ".join(["long"] * total), "en", "a")]
    hot = [(1000, " ".join(["hot"] * 42), "en", "a")] * (total // 42)
    other = [(2000 + i, "x y z " * 100, "en", "b") for i in range(12)]
    for large in (long, hot):
        for seed in (1, 2):
            got = mix(docs(short + large + other), shards=4, seed=seed).collect()
            own = [r for r in got if r.source == "a"]
            taken, target = sum(r.taken for r in own), own[0].target
            assert len(got) == len(short + large + other)
            assert 0 <= target - taken < 1, (seed, target, taken)
            assert all(len(r["shards"]) == r["copies"] and None not in r["shards"] for r in got)
            assert len({r["copies"] for r in own if r.doc_id == 1000}) == 1
            shards = Counter(k for r in own for k in r["shards"] if r.doc_id < 1000)
            assert len(shards) == 4
