import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
from llm.plain_versions import classes

from marginflow.llm.components import components
from marginflow.llm.hashing import Words, shingle_sets, sliding, tune
from marginflow.llm.links import compare_sides, linked, overlaps, pack, reachable, spanning


def test_components_against_brute_force(spark):
    draw = random.Random(3)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(45)]
    edges += [(100 + i, 101 + i) for i in range(40)] + [(None, 3), (5, 5), (7, None)]
    links = {i: set() for i in range(200)}
    for u, v in edges:
        if u is not None and v is not None:
            links[u].add(v)
            links[v].add(u)
    label = classes(200, links)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: label[i] for i in range(200) if links[i] - {i}}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_overlaps_and_what_is_reachable():
    draw = np.random.default_rng(1)
    sets = [np.unique(draw.integers(0, 40, draw.integers(0, 30))).astype(np.uint64) for _ in range(30)]
    both = overlaps(sets, sets)
    other = overlaps(sets[:10], sets[10:])
    hits = linked(sets, sets, 50)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            n = len(set(a) & set(b))
            assert hits[i, j] == (n > 0 and 2 * n >= len(a) + len(b) - n)
            if i != j:
                assert both[i, j] == n
            if i < 10 <= j:
                assert other[i, j - 10] == n
    np.fill_diagonal(hits, False)
    label = classes(30, {i: set(np.flatnonzero(hits[i])) for i in range(30)})
    u, v = np.nonzero(hits)
    assert reachable(30, u, v).tolist() == label
    few = spanning(30, u, v)
    assert reachable(30, u[few], v[few]).tolist() == label and len(few) < 30


def test_words_as_bytes_split_them():
    texts = ["a b\tc\x0bd", "", None, "é ü  x\r\n", "a b", "one", "one", " lead", "trail "]
    words = Words(pa.array(texts))
    want = [(t or "").encode().split() for t in texts]
    assert words.counts.tolist() == [len(w) for w in want]
    seen = {}
    for i, ws in enumerate(want):
        for k, w in enumerate(ws):
            seen.setdefault(w, set()).add(int(words.hash[words.first[i] + k]))
    assert all(len(h) == 1 for h in seen.values())
    assert len(set.union(*seen.values())) == len(seen)
    sliced = Words(pa.array(texts).slice(3, 3))
    assert sliced.counts.tolist() == [len(w) for w in want[3:6]]


def test_shingles_of_short_and_long_texts():
    texts = pa.array(["a b c d e f", "a b c d e", "a b", "b a", None, "a b"])
    values, starts = shingle_sets(Words(texts), 5)
    sets = [set(values[starts[i] : starts[i + 1]].tolist()) for i in range(6)]
    assert [len(s) for s in sets] == [2, 1, 1, 1, 0, 1]
    assert sets[1] < sets[0] and sets[2] == sets[5] != sets[3]


def test_sliding_minimum():
    x = np.random.default_rng(2).integers(0, 99, 50)
    for width in (1, 2, 3, 7, 31, 50, 51):
        want = [x[i : i + width].min() for i in range(50 - width + 1)]
        assert sliding(x, width).tolist() == want


def test_bands_reach_the_recall():
    for rows in (1, 2, 5):
        n = tune(0.8, 0.999, rows)
        assert 1 - (1 - 0.8**rows) ** n >= 0.999 > 1 - (1 - 0.8**rows) ** (n - 1)


def test_may_hold_keeps_every_wanted_row(spark):
    from pyspark.sql import functions as F

    from marginflow.llm.frames import may_hold

    rows = spark.range(20_000).select((F.col("id") - 7).alias("a"), F.lit("x").alias("b"))
    wanted = spark.createDataFrame([(-7,), (0,), (5,), (19_000,), (10**12,)], "a long")
    few = may_hold(rows, ["a"], wanted, 1 << 20)
    got = {r.a for r in few.collect()}
    assert few.columns == ["a", "b"] and {-7, 0, 5, 19_000} <= got and len(got) < 100
    full = may_hold(rows, ["a"], rows.select("a"), 1 << 15)
    assert full.count() == 20_000  # a bitmap that is full lets all through
    assert may_hold(rows, ["a"], wanted.limit(0)).collect() == []


def test_a_bitmap_is_as_large_as_its_keys_need(spark):
    from marginflow.llm.frames import may_hold

    rows = spark.range(20_000).toDF("a")
    wanted = rows.filter("a % 4000 = 7")
    few = may_hold(rows, ["a"], wanted, 1 << 26, rows=5)
    got = {r.a for r in few.collect()}
    assert {7, 4007, 8007, 12007, 16007} <= got and len(got) < 100
    assert "pmod(xxhash64(a" in (plan := few._jdf.queryExecution().analyzed().toString())
    assert f"{1 << 15}" in plan and f"{1 << 26}" not in plan
    many = may_hold(rows, ["a"], rows, 1 << 16, rows=20_000)
    assert many.count() == 20_000  # `bits` is the most


def test_powers_of_many_sizes_are_kept_once():
    from marginflow.llm import hashing

    for n in (10, 5000, 70_000, 300_000, 900):
        words = Words(pa.array(["ab " * n, "ab"]))
        assert len(set(words.hash.tolist())) == 1
    assert sum(len(x) for x in hashing._POWERS.values()) <= 2 * max(map(len, hashing._POWERS.values()))


def test_batches_are_cut_by_their_bytes(spark):
    from marginflow.llm import frames

    batch = pa.RecordBatch.from_pydict({"n": list(range(3000)), "t": ["x" * 4000] * 2999 + [None]})
    cut = list(frames.parts(batch))
    assert len(cut) > 2 and max(p.nbytes for p in cut) < 1.1 * frames.BATCH_BYTES
    assert pa.Table.from_batches(cut).equals(pa.Table.from_batches([batch]))
    assert [p.num_rows for p in frames.parts(batch.slice(0, 0))] == [0]
    frames.ship_code(spark)
    assert spark.conf.get(frames.BATCH_SETTING) == str(frames.BATCH_BYTES)


def test_pairs_of_small_blocks_are_compared_at_once(monkeypatch):
    """As many pairs of blocks as a star each; results are those of blocks compared alone."""
    from marginflow.llm import links

    draw, rows = np.random.default_rng(7), []
    base = draw.integers(0, 2**63, (30, 16)).astype(np.uint64)
    sets = {}
    for g in range(4000):
        family = int(draw.integers(0, 30))
        for second in (False, True)[: 1 + g % 2]:
            for item in (family + 30 * draw.integers(0, 50, draw.integers(1, 5))).tolist():
                if item not in sets:
                    own = base[family].copy()
                    own[: item % 3] = draw.integers(0, 2**63, item % 3)
                    sets[item] = (pack(own[: 16 * (item % 17 > 0)]), item % 5, item % 61)
                rows.append((g // 3, g, second, item, sets[item][1], sets[item][2], sets[item][0]))
    names = ["a", "b", "second", "item", "rank", "place", "values"]
    table = pa.table(dict(zip(names, map(list, zip(*rows)))))

    def told():
        took = time.process_time()
        links_of = compare_sides(80, extent=20)(table).to_pylist()
        counts = links.count_sides(80)(table).to_pylist()
        took = time.process_time() - took
        hub = {i: set() for i in sets}
        for r in links_of:
            if r["hub"] is not None:
                hub[r["item"]].add(r["hub"])
                hub[r["hub"]].add(r["item"])
        late = {r["late"] for r in links_of} - {None}
        number = {i: n for n, i in enumerate(sorted(hub))}
        joined = classes(len(hub), {number[i]: {number[j] for j in v} for i, v in hub.items()})
        sums = {}
        for r in counts:
            links_n, rep = sums.get(r["item"], (0, links.NO_RANK))
            sums[r["item"]] = (links_n + r["links"], min(rep, r["rep"]))
        return (late, joined, sums), took

    at_once, quick = told()
    monkeypatch.setattr(links, "SMALL", 0)
    alone, slow = told()
    assert at_once == alone and 2 * quick < slow


def test_a_block_of_near_copies_needs_little_memory():
    """Nearly all pairs of a crowd are links; what is told of them is not made from a list of pairs."""
    draw, n = np.random.default_rng(4), 1024
    base = draw.integers(0, 2**63, 60).astype(np.uint64)
    sets = [base.copy() for _ in range(2 * n)]
    for s in sets:
        s[draw.integers(0, 60)] = draw.integers(0, 2**63)
    order = draw.permutation(2 * n)
    table = pa.table(
        {
            "a": pa.array([1] * 2 * n),
            "b": pa.array([2] * 2 * n),
            "second": pa.array([False] * n + [True] * n),
            "item": pa.array(np.arange(2 * n)),
            "rank": pa.array(order // 2),
            "place": pa.array(order % 2),
            "values": pa.array([pack(s) for s in sets], pa.binary()),
        }
    )
    tracemalloc.start()
    told = compare_sides(80)(table).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 45 * n * n  # bytes
    ends = np.array([(r["item"], r["hub"]) for r in told if r["hub"] is not None])
    assert len(ends) == 2 * n - 1 and not reachable(2 * n, *ends.T).any()
    late = sorted(r["late"] for r in told if r["late"] is not None)
    first = [min(order[:n]), min(order[n:])]
    assert late == [i for i in range(2 * n) if order[i] > first[i < n]]


def test_steps_leave_no_shuffle_files(spark):
    """Sums that are stored or saved leave their rows, not the shuffle that they were made with."""
    import glob

    from pyspark.sql import functions as F

    from marginflow.llm.frames import CLEANUP, saved, stored

    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {f for d in folders.localDirsString() for f in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}

    setting = spark.conf.get(CLEANUP)
    for keep in (stored, saved):
        before = files()  # those of other queries stay
        sums = spark.range(20_000).groupBy((F.col("id") % 5_000).alias("k")).agg(F.sum("id").alias("s"))
        kept = keep(sums)
        left = files() - before
        for _ in range(50):  # they go in the background
            if not left:
                break
            time.sleep(0.1)
            left = files() - before
        assert not left
        assert kept.count() == kept.count() == 5_000
    assert spark.conf.get(CLEANUP) == setting


def test_few_links_need_no_rounds(spark, monkeypatch):
    """A task holds together the links it has: few are done by then, and of many their ends are right."""
    from marginflow.llm import components as module

    written = []
    saved = module.saved
    monkeypatch.setattr(module, "saved", lambda df: written.append(saved(df)) or written[-1])
    order = list(range(120))
    random.Random(7).shuffle(order)
    chain = [*zip(order, order[1:]), (4000, 4001), (4001, 4001), (4000, 4001), (None, 4002)]
    edges = spark.createDataFrame(chain, "u long, v long").repartition(8)
    want = {**dict.fromkeys(range(120), 0), 4000: 4000, 4001: 4000}
    got = components(edges).collect()
    assert len(got) == len(want) and {r.node: r.component for r in got} == want
    assert len(written) == 2
    monkeypatch.setattr(module, "TASK_LINKS", 40)  # so four tasks have a part each
    got = components(edges).collect()
    assert len(got) == len(want) and {r.node: r.component for r in got} == want
    assert len(written) > 4


def test_stars_of_some_links_at_a_time(monkeypatch):
    from marginflow.llm import components as module

    monkeypatch.setattr(module, "TASK_LINKS", 4)
    batches = [
        pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})
        for u, v in (([9, 5], [7, 3]), ([7, 2**62], [5, -8]), ([], []), ([9], [8]))
    ]
    got = [list(zip(*(b.column(c).to_pylist() for c in ("u", "v")))) for b in module.stars(iter(batches))]
    assert got == [[(5, 3), (7, 3), (9, 3), (2**62, -8)], [(9, 8)]]
    assert list(module.stars(iter(batches[2:3]))) == []


def test_the_driver_lets_go_of_finished_steps(spark):
    """When tables of finished steps go, the driver's garbage is collected, with the plans behind them."""
    from marginflow.llm.frames import dropped, stored

    table = stored(spark.range(10).toDF("id"))
    factory = spark.sparkContext._jvm.java.lang.management.ManagementFactory

    def whole_heap():
        return [b.getCollectionCount() for b in factory.getGarbageCollectorMXBeans() if "Young" not in b.getName()]

    before = whole_heap()
    dropped()
    assert whole_heap() == before
    dropped(table)
    assert sum(whole_heap()) > sum(before)
