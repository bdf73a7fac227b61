from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from spindrift.llm import registry, whitening

SF = "/root/testdata/sf0.01"


def brute(vectors, components):
    """Whitening of lists of floats in plain numpy, centred before multiplying."""
    x = np.floor(np.array(vectors, np.float64) * 1024).astype(np.int64) + 100_000
    n = len(x)
    sums = [int(s) for s in x.sum(0)]
    away = np.array([[float(Fraction(int(v) * n - s, n)) for v, s in zip(row, sums, strict=True)] for row in x])
    cov = away.T @ away / n
    values, vecs = np.linalg.eigh(cov)
    values, vecs = values[::-1][:components], vecs[:, ::-1][:, :components]
    deviation = [sum((int(v) * n - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    return deviation, away @ vecs / np.sqrt(values), values / np.trace(cov)


def check(rows, vectors, components):
    """Rows of by_component against the brute form; keys are the vectors' places."""
    deviation, white, explained = brute(vectors, components)
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(rows) == len(got) == len(vectors) * white.shape[1]
    for c in range(white.shape[1]):
        col = np.array([got[i, c + 1].whitened for i in range(len(vectors))])
        sign = np.sign(col @ white[:, c])
        assert np.allclose(col * sign, white[:, c], rtol=1e-9, atol=1e-9)
        assert all(got[i, c + 1].deviation == deviation[i] and got[i, c + 1].n == len(vectors) for i in range(len(vectors)))
        assert abs(got[0, c + 1].explained / explained[c] - 1) < 1e-9
    assert {r.identity_error for r in rows} == {rows[0].identity_error} and rows[0].identity_error < 1e-9


def test_query_against_numpy(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    good = [r for r in table if r.embedding is not None and all(c is not None and np.isfinite(c) for c in r.embedding)]
    place = {r.vec_id: i for i, r in enumerate(good)}
    rows = registry.QUERIES["op11_whitening"](spark, SF)
    assert set(rows.columns) >= {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"}
    moved = rows.rdd.map(lambda r: r.asDict()).collect()
    from types import SimpleNamespace as S

    check([S(**{**r, "vec_id": place[r["vec_id"]]}) for r in moved], [r.embedding for r in good], 8)


def test_a_large_common_offset_does_not_cancel(spark):
    """Entries of spread 1/1024 on an offset of 3e6: the covariance of x without centring first would lose every digit."""
    rng = np.random.default_rng(5)
    vectors = [[3e6 + int(v) / 1024 for v in row] for row in rng.integers(0, 3, (300, 5))]
    rows = whitening.by_component(spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>"), 8).collect()
    check(rows, vectors, 5)


def test_rows_that_are_left_out(spark):
    rows = [(i, [float(i % 7), float(i * i % 11)]) for i in range(40)] + [(None, [1.0, 2.0]), (3, [3.0, 9.0]), (3, [3.0, 9.0]), (50, None), (51, [1.0, None]), (52, [1.0, float("nan")]), (53, [float("-inf"), 1.0]), (54, []), (55, [1.0])]
    df = spark.createDataFrame([(*r, "x", 1.5) for r in rows], "vec_id long, embedding array<float>, key string, x double")
    got = whitening.by_component(df, 8).collect()
    assert len(got) == 2 * 43 and {r.n for r in got} == {43}
    assert sorted({r.vec_id for r in got if r.vec_id is not None}) == list(range(40)) and sum(r.vec_id is None for r in got) == 2
    threes = {(r.component, r.whitened, r.deviation) for r in got if r.vec_id == 3}
    assert sum(r.vec_id == 3 for r in got) == 6 and len(threes) >= 2


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None)], [(i, [2.0, 5.0]) for i in range(6)], [(1, [2.0, 3.0])], [(1, [])]):
        df = whitening.by_component(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
        assert df.collect() == [] and df.columns[0] == "vec_id"
    flat = whitening.by_component(spark.createDataFrame([(i, [float(i), 7.0, 2.0 * i]) for i in range(20)], "vec_id long, embedding array<float>")).collect()
    assert len(flat) == 20 and abs(flat[0].explained - 1) < 1e-9


def test_sizes_beyond_a_long(spark):
    big = [[1e30, 0.0], [-1e30, 1.0], [5e9, 2.0], [0.5, 3.0]]
    got = whitening.by_component(spark.createDataFrame([(i, v) for i, v in enumerate(big)], "vec_id long, embedding array<double>"), 2).collect()
    assert len(got) == 4 and all(r.deviation is None for r in got if r.vec_id < 2)  # the second variance is none beside the first
    x = np.array([[10, -3], [4, 5]])
    assert whitening.deviations(x, 3, (7, 8)) == [23 * 23 + 17 * 17, 5 * 5 + 7 * 7]
    assert whitening.deviations(np.array([[1 << 40, 0]]), 1 << 30, (0, 0)) == [None]
