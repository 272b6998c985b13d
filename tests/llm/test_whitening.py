import math

import numpy as np
import pytest

from corpusloom.llm import whitening as wh
from corpusloom.llm.queries import queries

RULES = wh.Rules()


def reference(vectors):
    """n, S, covariance and its eigenvalues by definition, from the distinct vectors."""
    fit = sorted({tuple(math.floor(64 * float(c)) + 1_000_000 for c in v) for v in vectors})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    gaps = np.array([[n * c - s for c, s in zip(x, sums)] for x in fit], dtype=float) / n
    return n, sums, gaps.T @ gaps / n


def check(rows, data, size):
    n, sums, v = reference(data.values())
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert {(r.vec_id, r.component) for r in rows} == {(i, c) for i in data for c in range(1, size + 1)} and len(rows) == size * len(data)
    assert {r.n for r in rows} == {n} and len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9
    table = np.zeros((size, len(data)))
    order = {i: k for k, i in enumerate(sorted(data))}
    for r in rows:
        table[r.component - 1, order[r.vec_id]] = r.whitened
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(v), rel=1e-10)
    for i, vector in data.items():
        x = [math.floor(64 * float(c)) + 1_000_000 for c in vector]
        assert {r.deviation for r in rows if r.vec_id == i} == {sum((n * c - s) ** 2 for c, s in zip(x, sums))}
    moved = np.array([[math.floor(64 * float(c)) + 1_000_000 - s / n for c, s in zip(data[i], sums)] for i in sorted(data)])
    for k in range(size):
        want = moved @ vectors[:, k] / math.sqrt(values[k])
        assert min(np.abs(table[k] - want).max(), np.abs(table[k] + want).max()) < 1e-7


def test_query_equals_brute_force(spark, small):
    data = {r.vec_id: r.embedding for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()}
    check(queries()["op11_whitening"](spark, small).collect(), data, 16)


@pytest.mark.parametrize("size", [1, 2, 7, 40])
def test_inertia_counts_eigenvalues(size):
    rng = np.random.default_rng(size)
    for trial in range(20):
        a = rng.standard_normal((size, size))
        a = a + a.T if trial % 2 else a @ a.T
        if trial % 3 == 0:
            a[:, 0] = a[0] = 0  # singular
        values = np.linalg.eigvalsh(a)
        for s in [*rng.uniform(values[0] - 1, values[-1] + 1, 5), values[-1] + 1, values[0] - 1]:
            if np.abs(values - s).min() > 1e-8:
                assert wh.count_below(a, s) == (values < s).sum()


def test_clusters_and_equal_eigenvalues_are_all_found(spark):
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.standard_normal((50, 50)))
    for values in (
        np.r_[[5.0] * 12, [3.0, 3.0 + 1e-9, 3.0 - 1e-9], np.linspace(1, 2, 20), [1e-3] * 15],
        np.ones(50),
        np.r_[1e6, 1.0, np.zeros(48)],
        np.r_[np.geomspace(1, 1e-8, 30), np.zeros(20)],
    ):
        v = (q * values) @ q.T
        v = (v + v.T) / 2
        want = np.sort(values)[::-1]
        want = want[: min(16, (want > 1e-10 * want[0]).sum())]
        got, vectors = wh.components(spark, v, RULES)
        assert len(got) == len(want) and np.abs(got - want).max() < 1e-11 * want[0]
        assert np.abs(vectors.T @ vectors - np.eye(len(got))).max() < 1e-12
        assert np.linalg.norm(v @ vectors - vectors * got) < 1e-11 * want[0]


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = {i: (rng.standard_normal(6) * [5, 4, 3, 2, 1, 0]).tolist() for i in range(60)}
    good |= {i: good[0] for i in range(60, 100)}  # copies count once in the fit
    bad = [(300, None), (301, []), (302, [None] + [0.5] * 5), (303, [float("nan")] * 6), (304, [0.1, float("-inf")] + [0.0] * 4), (305, [0.5] * 5)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in [*good.items(), *bad]], "vec_id long, embedding array<double>, n int, x string")
    check(wh.whiten(df.repartition(4)).collect(), good, 5)  # the sixth dimension is constant
    # Repeated and null ids keep their rows; values beyond a long's reach do not break the exact sums.
    wide = [(1, [1e300, 1.0]), (1, [1e300, 1.0]), (None, [-1e300, 2.0]), (2, [0.0, 3.0])]
    got = wh.whiten(spark.createDataFrame(wide, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id or 0) for r in got if r.component == 1) == [0, 1, 1, 2] and {r.deviation for r in got} == {None, 36864}
    for empty in (df.where("false"), df.where("vec_id >= 300 AND vec_id < 305"), df.where("vec_id = 1 OR vec_id = 305").limit(1), df.where("vec_id >= 60 AND vec_id < 99")):
        assert wh.whiten(empty).collect() == []
        assert wh.whiten(empty).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviations_are_exact():
    rng = np.random.default_rng(2)
    for n, most in ((3, 10), (10**6, 10**7), (10**9, 10**6), (10**13, 10**6), (10, 1 << 60)):
        x = rng.integers(-most, most, (20, 5))
        sums = [int(s) for s in rng.integers(-most, most, 5)]
        want = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x]
        assert wh.Centre(n, sums).deviations(x) == [w if w < 1 << 63 else None for w in want]
