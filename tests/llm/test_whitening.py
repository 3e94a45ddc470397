import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginflow.llm import whitening
from marginflow.llm.whitening import Spectrum, rank_one, secular_roots


def scatter(x):
    c = x - x.mean(axis=0)
    return c.T @ c


def agrees(spectrum, x):
    s = scatter(x)
    size = max(np.abs(s).max(), 1)
    d = x.shape[1]
    q = spectrum.vectors
    assert np.abs(q @ np.diag(spectrum.values) @ q.T - s).max() < 1e-11 * size
    assert np.abs(q.T @ q - np.eye(d)).max() < 1e-11
    assert np.allclose(spectrum.mean, x.mean(axis=0)) and spectrum.n == len(x)


CASES = {
    "ordinary": lambda g: g.normal(size=(300, 12)),
    "few vectors": lambda g: g.normal(size=(5, 12)),
    "falling fast": lambda g: g.normal(size=(200, 16)) * 10.0 ** -np.arange(16),
    "equal columns": lambda g: g.normal(size=(200, 3))[:, [0, 0, 1, 2, 2, 2]],
    "constant": lambda g: np.full((20, 4), 7.0),
    "whole numbers": lambda g: g.integers(-3, 4, (400, 8)).astype(float),
    "repeated rows": lambda g: g.normal(size=(4, 6))[g.integers(0, 4, 200)],
    "one entry": lambda g: g.normal(size=(50, 1)),
}


@pytest.mark.parametrize("case", list(CASES))
def test_updates_and_combinations_keep_the_spectrum(case):
    x = CASES[case](np.random.default_rng(1))
    whole = Spectrum.empty(x.shape[1])
    for row in x:
        whole.add(row)
    agrees(whole, x)
    parts = [Spectrum.empty(x.shape[1]) for _ in range(3)]
    for i, row in enumerate(x):
        parts[i % 3].add(row)
    for part in parts[1:]:
        parts[0].combine(Spectrum.unpack(part.pack(), x.shape[1]))
    agrees(parts[0], x)


def test_secular_roots_against_a_general_solver():
    g = np.random.default_rng(2)
    for k in (1, 2, 3, 10, 40):
        for scale in (1.0, 1e-6, 1e6):
            d = np.sort(g.normal(size=k))
            z = g.normal(size=k) * 10.0 ** g.integers(-5, 1, k)
            roots, apart = secular_roots(d, z, scale)
            want = np.linalg.eigvalsh(np.diag(d) + scale * np.outer(z, z))
            assert np.allclose(roots, want, rtol=1e-12, atol=1e-12 * max(1, np.abs(want).max()))
            assert (np.diff(roots) > 0).all() and (roots >= d).all() and (roots[:-1] <= d[1:]).all()
            f = 1 + scale * (z[:, None] ** 2 / apart).sum(axis=0)
            assert np.isfinite(f).all()


def test_nothing_to_change():
    values, vectors = np.array([1.0, 2.0]), np.eye(2)
    for v, rho in ((np.zeros(2), 1.0), (np.ones(2), 0.0)):
        got = rank_one(values, vectors, v, rho)
        assert (got[0] == values).all() and (got[1] == vectors).all()


def table(spark, vectors, first=0):
    rows = [(first + i, None if v is None else list(map(lambda c: c if c is None else float(c), v))) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("n", F.lit("x"))


def plain(vectors, most=32):
    """The contract by whole arrays: (x, n, sums, e, q, trace)."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(col) for col in zip(*x)]
    y = np.array(x, dtype=np.float64) - np.array(sums) / n
    v = y.T @ y / n
    e, q = np.linalg.eigh(v)
    return x, n, sums, e[::-1][:most], q[:, ::-1][:, :most], np.trace(v), y


def compare(got, vectors, ids, most=32):
    x, n, sums, e, q, trace, y = plain(vectors, most)
    k = len(e)
    assert len(got) == n * k
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, {})[r.component] = r
    signs = None
    for i, vec_id in enumerate(ids):
        rows = [by_id[vec_id][c] for c in range(1, k + 1)]
        assert {r.n for r in rows} == {n}
        assert {r.deviation for r in rows} == {sum((n * a - s) ** 2 for a, s in zip(x[i], sums))}
        mine, want = np.array([r.whitened for r in rows]), y[i] @ q / np.sqrt(e)
        if signs is None:
            signs = np.sign(mine * want)
        assert np.allclose(mine * signs, want, rtol=1e-6, atol=1e-8)
        assert np.allclose([r.explained for r in rows], e / trace, rtol=1e-9)
    assert max(r.identity_error for r in got) < 1e-9


def test_against_whole_arrays(spark):
    g = np.random.default_rng(4)
    vectors = (g.normal(size=(300, 10)) @ g.normal(size=(10, 10))).tolist()
    df = table(spark, vectors).repartition(7)
    compare(whitening.whiten(df).collect(), vectors, range(300))
    compare(whitening.whiten(df, most=3).collect(), vectors, range(300), 3)


def test_bad_vectors_are_left_out(spark):
    g = np.random.default_rng(5)
    good = g.normal(size=(40, 3)).tolist()
    bad = [None, [1, None, 2], [float("nan"), 0, 0], [float("inf"), 0, 0], [0, float("-inf"), 1], [], [1, 2]]
    df = table(spark, good).unionByName(table(spark, bad, 100))
    compare(whitening.whiten(df).collect(), good, range(40))


def test_no_rows_without_a_direction(spark):
    for vectors in ([], [None], [[1, 2]], [[1, 2]] * 5, [[]]):
        df = table(spark, vectors) if vectors else table(spark, [[1]]).limit(0)
        assert whitening.whiten(df).collect() == []
    # A direction in which nothing varies is no component.
    got = whitening.whiten(table(spark, [[i, 2 * i, 5] for i in range(9)])).collect()
    assert {r.component for r in got} == {1} and len(got) == 9
    assert abs(sum(r.whitened**2 for r in got) / 9 - 1) < 1e-9


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, [1.0, 2.0]), (1, [3.0, -1.0]), (1, [3.0, -1.0]), (2, [0.5, 0.25])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 8 and sum(r.vec_id is None for r in got) == 2
    assert len({(r.component, r.whitened) for r in got if r.vec_id == 1}) == 2


def test_deviation_is_exact_where_sums_are_large():
    x = np.array([[2.0**30, 5.0], [-(2.0**30), 1.0]])
    sums = [2_000_000, 6 + 2_000_000]
    want = [(2 * 2**30) ** 2 + (2 * 5 - 6) ** 2, (2 * 2**30) ** 2 + (2 - 6) ** 2]
    assert whitening.deviations(x, 2, sums) == want
    huge = np.array([[2.0**40, 0.0]])
    assert whitening.deviations(huge, 10**6, [10**12, 10**12]) == [None]


def test_query_on_a_whole_table(spark):
    from marginflow.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    given = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    got = QUERIES["op13_whitening"](spark, folder).collect()
    compare(got, [r.embedding for r in given], [r.vec_id for r in given])
