import numpy as np
import pytest

from scholia.llm.whitening import Centre, whiten

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(ids, c, k=32, fit=None):
    x = np.floor(64 * np.asarray(c, np.float32).astype(float)).astype(np.int64) + 1000000
    fit = x if fit is None else fit
    n, s = len(fit), fit.sum(axis=0)
    centred = lambda y: (n * y - s) / n
    v = centred(fit).T @ centred(fit) / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return n, centred(x) @ u / np.sqrt(e), ((n * x - s).astype(object) ** 2).sum(axis=1), e / np.trace(v)


def table(df, **how):
    rows = sorted(whiten(df, **how).collect(), key=lambda r: (r["vec_id"], r["component"]))
    k = max(r["component"] for r in rows)
    return rows, np.array([r["whitened"] for r in rows]).reshape(-1, k)


def agrees(rows, z, n, want, deviation, explained):
    k = z.shape[1]
    z = z * np.sign((z * want).sum(axis=0))
    assert np.allclose(z, want, atol=1e-9) and [r["deviation"] for r in rows[::k]] == list(deviation)
    assert np.allclose([r["explained"] for r in rows[:k]], explained[:k], rtol=1e-9) and {r["n"] for r in rows} == {n}
    assert len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-9


def test_equals_brute_force_with_hot_vectors(spark):
    r = np.random.default_rng(1)
    c = r.normal(size=(600, 40)).astype(np.float32)
    c[200:400] = c[0]
    df = spark.createDataFrame([(i, [float(x) for x in v], None) for i, v in enumerate(c)], SCHEMA).repartition(6)
    rows, z = table(df)
    assert z.shape == (600, 32)
    agrees(rows, z, *brute(range(600), c))
    cov = np.cov(z.T, bias=True)
    assert np.abs(cov - np.eye(32)).max() < 1e-9


def test_weight_one_fits_different_vectors(spark):
    r = np.random.default_rng(2)
    c = r.normal(size=(80, 5)).astype(np.float32)
    c[40:] = c[0]
    df = spark.createDataFrame([(i, [float(x) for x in v], 1) for i, v in enumerate(c)], SCHEMA)
    rows, z = table(df, weights="one")
    fit = np.unique(np.floor(64 * c.astype(float)).astype(np.int64) + 1000000, axis=0)
    agrees(rows, z, *brute(range(80), c, fit=fit))
    with pytest.raises(ValueError):
        whiten(df, weights="none")


def test_nulls_clashes_repeated_rows_and_short_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [1.0, 2.0, 0.5]), (1, [1.0, 2.0, 0.5]), (None, [0.0, 1.0, -3.0]), (2, None), (3, [1.0, None, 2.0]), (4, [nan, 1.0, 1.0]), (5, [1.0, -inf, 1.0]), (6, [2.0, -1.0]), (7, [])]
    df = spark.createDataFrame([(i, v, "x", 3) for i, v in data], "vec_id long, embedding array<double>, x string, rows int")
    got = whiten(df).collect()
    assert sorted({str(r["vec_id"]) for r in got}) == ["1", "6", "7", "None"] and {r["n"] for r in got} == {5}
    whole = [v + [0.0] * (3 - len(v)) for v in ([1.0, 2.0, 0.5], [1.0, 2.0, 0.5], [0.0, 1.0, -3.0], [2.0, -1.0], [])]
    n, want, deviation, explained = brute(None, whole)
    assert len(got) == 5 * 3 and sorted(r["deviation"] for r in got if r["component"] == 1) == sorted(deviation)
    assert np.allclose(sorted(abs(r["whitened"]) for r in got), sorted(np.abs(want).ravel()), atol=1e-9)


def test_no_spread_and_empty(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(5)], SCHEMA)
    assert whiten(same).collect() == [] and whiten(same.where("false")).collect() == []
    assert whiten(spark.createDataFrame([(1, [], 0), (2, None, 0)], SCHEMA)).collect() == []
    flat = spark.createDataFrame([(i, [float(i), 2.0, float(2 * i)], 0) for i in range(9)], SCHEMA)  # one direction only
    rows, z = table(flat)
    assert z.shape == (9, 1) and rows[0]["explained"] == pytest.approx(1.0)


def test_large_values_are_exact(spark):
    c = [[1e12, 3.0], [-1e12, 1.0], [5.0, 2.5], [1e30, 0.0]]
    got = sorted(whiten(spark.createDataFrame([(i, v, 0) for i, v in enumerate(c)], "vec_id long, embedding array<double>, label int")).where("component = 1").collect(), key=lambda r: r["vec_id"])
    x = [[min(int(64 * a // 1), 1 << 52) + 1000000 for a in v] for v in c]
    s = [sum(col) for col in zip(*x, strict=True)]
    want = [sum((4 * a - b) ** 2 for a, b in zip(v, s, strict=True)) for v in x]
    assert [int(r["deviation_exact"]) for r in got] == want and all(r["deviation"] is None for r in got)
    m = Centre(3, [6, 9])
    assert m.deviations(np.array([[1, 2], [3, 4]])) == [(3 - 6) ** 2 + (6 - 9) ** 2, (9 - 6) ** 2 + (12 - 9) ** 2]
