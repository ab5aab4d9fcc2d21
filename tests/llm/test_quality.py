import os
import random

import numpy as np
import pytest

from scholia.llm.quality import fit, grams, hinge, quality


def test_hinge_separates_and_fit_handles_one_label():
    x = [np.array([0, 2]), np.array([0, 3]), np.array([1, 2]), np.array([1, 3])] * 5
    w, b = hinge(x, np.ones(4), np.array([1.0, 1, -1, -1] * 5))
    assert all((w[s].sum() + b > 0) == (i % 4 < 2) for i, s in enumerate(x))
    assert 0 < fit(x, np.ones(20)).scores(x)[0] < 1 and fit([], np.array([])).scores([np.array([], int)])[0] == pytest.approx(0.5)


def test_grams_see_shape_words_and_repeats():
    a, b, c, d = grams([b"good words here", b"good words HERE", b"tara tara tara", None])
    assert len(set(a) ^ set(b)) > 0 and len(d) == 0 and len(c) > 0


def rows(n):
    r = random.Random(1)
    word = lambda: "".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 8)))
    out = []
    for i in range(n):
        q = i % 3 > 0
        w = [word() + ("" if q else r.choice(["###", "&&&"])) for _ in range(r.randint(5, 60))]
        out.append((i, " ".join(w), int(q)))
    return out


def test_rows(spark):
    data = rows(400)
    docs = spark.createDataFrame([(i, t, 3.0) for i, t, _ in data] + [(9000, None, 1.0), (9001, "", 1.0), (None, "a b", 1.0), (9002, "w### " * 30_000, 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in data] + [(9000, 1, 0), (1, None, 0), (None, 1, 0), (5, 7, 0)], "doc_id long, quality int, toxic int")
    got = quality(docs, labels).collect()
    assert len(got) == 404 and all(0 <= g["score"] <= 1 and g["predicted"] == int(g["score"] >= 0.3) for g in got)
    score = {g["doc_id"]: g["score"] for g in got}
    assert np.mean([(score[i] >= 0.5) == bool(q) for i, _, q in data]) > 0.97 and score[9002] < score[1]
    assert len(quality(docs, labels.where("false")).collect()) == 404
    assert quality(docs.where("false"), labels).collect() == []


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="needs the given tables")
def test_held_out_accuracy(spark):
    d, k = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality(d, k).where("held_out").join(k, "doc_id").selectExpr("avg(int(predicted = quality)) a").first()["a"]
    assert got > 0.93


def test_hinge_is_a_minimum_of_its_loss():
    r = np.random.default_rng(2)
    ratio = r.normal(size=30)
    x = [np.sort(r.choice(30, r.integers(2, 9), replace=False)) for _ in range(60)]
    y = np.where([ratio[s].sum() + r.normal() > 0 for s in x], 1.0, -1.0)
    w, bias = hinge(x, ratio, y, cost=1.0, rounds=3000)
    most = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))

    def loss(w, bias):
        margin = np.array([w[s] @ ratio[s] / np.linalg.norm(ratio[s]) + bias for s in x])
        return (w @ w + bias * bias) / 2 + (most * np.maximum(0, 1 - y * margin)).sum()

    assert all(loss(w, bias) <= loss(w + s * r.normal(size=30), bias + s * r.normal()) + 1e-6 for s in (0.001, 0.01, 0.1) for _ in range(100))
