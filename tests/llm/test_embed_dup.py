import math

import numpy as np

from scholia.llm.embed_dup import near_duplicate_vectors, quantised, tile_links, unit


def data():
    r = np.random.default_rng(3)
    rows, i = [], 0
    for label in (0, 1, 2):
        for _ in range(12):
            c = r.normal(size=16)
            for _ in range(r.integers(1, 9)):
                v = c + r.normal(size=16) * r.choice([0.0, 0.1, 0.25, 0.33])
                rows.append((i, label, (v * r.choice([1.0, 3.0])).astype("float32").tolist()))
                i += 1
    odd = [None, [0.0] * 16, [1.0] * 15 + [None], [1.0] * 15 + [math.nan], [math.inf] + [1.0] * 15, [], [1.0] * 8]
    return rows + [(1000 + k, 0, v) for k, v in enumerate(odd)] + [(2000, None, rows[0][2]), (2001, 0, [1.0] * 8), (2002, 5, rows[0][2])]


def brute(rows):
    ok = lambda v: bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    n, parent = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, la, va) in enumerate(rows):
        for b, lb, vb in rows[:k]:
            if la is not None and la == lb and ok(va) and ok(vb) and len(va) == len(vb):
                x, y = np.array(va), np.array(vb)
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.93:
                    n[a] += 1
                    n[b] += 1
                    p, q = find(a), find(b)
                    parent[max(p, q)] = min(p, q)
    return {i: (n[i], find(i), find(i) == i) for i in n}


def test_equals_brute_force_over_many_tiles(spark):
    rows = data()
    df = spark.createDataFrame([(i, label, v, 1) for i, label, v in rows], "vec_id long, label int, embedding array<float>, v int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_duplicate_vectors(df, tile_rows=7).collect()}
    assert got == brute(rows)


def test_copies_and_empty(spark):
    df = spark.createDataFrame([(3, 0, [1.0, 2.0]), (1, 0, [1.0, 2.0]), (2, 0, [1.0, 2.0]), (None, 0, [1.0, 2.0])], "vec_id long, label int, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_duplicate_vectors(df).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False), None: (0, None, True)}
    assert near_duplicate_vectors(df.where("vec_id = 9")).collect() == []


def test_bounds_hold():
    u = unit(np.random.default_rng(1).normal(size=(60, 24)))
    q, s, n, e = quantised(u)
    err = np.abs(u @ u.T - (q.astype(float) * s[:, None]) @ (q.astype(float) * s[:, None]).T)
    assert (err <= n[:, None] * e + e[:, None] * (n + e) + 1e-12).all()
    pairs = {(int(i), int(j)) for p, r in tile_links(u, None, 0.3) for i, j in zip(p, r, strict=True)}
    assert pairs == {(i, j) for i in range(60) for j in range(i + 1, 60) if u[i] @ u[j] >= 0.3}
