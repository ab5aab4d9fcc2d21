import os
import random
import zlib

import numpy as np
import pytest

from scholia.llm.toxicity import class_prior, counted, fit, gram_codes, risk, toxicity


def test_gram_codes_count_words_and_their_beginnings():
    doc, code, count = counted(*gram_codes(["Abcdé abcdé xy", "xy\txy", "", None]))
    a, b = dict(zip(code[doc == 0], count[doc == 0], strict=True)), dict(zip(code[doc == 1], count[doc == 1], strict=True))
    assert sorted(a.values()) == [1, 2, 2, 2, 2, 2] and list(b.values()) == [2] and set(b) < set(a)  # abc, abcd, abcd + one byte, abcdé and the word
    assert set(doc) == {0, 1}


def test_risk_is_that_of_labelled_data_and_its_gradient_is_right():
    r = np.random.default_rng(1)
    f = r.normal(size=40)
    positive = np.arange(40) < 10
    toxic, other, g_toxic, g_other = risk(f, positive, 0.3)
    log = lambda z: np.log1p(np.exp(-z))
    assert toxic == pytest.approx(0.3 * log(f[:10]).mean()) and other == pytest.approx(log(-f[10:]).mean() - 0.3 * log(-f[:10]).mean())
    for i in (0, 12):
        e = np.eye(40)[i] * 1e-6
        a, b = risk(f + e, positive, 0.3)[:2]
        assert (a - toxic) / 1e-6 == pytest.approx(g_toxic[i], abs=1e-5) and (b - other) / 1e-6 == pytest.approx(g_other[i], abs=1e-5)


def test_fit_tells_toxic_from_unlabelled_that_holds_toxic():
    """A third of the unlabelled examples is toxic too; a classifier of positive against unlabelled would give these at most 1/2."""
    r = np.random.default_rng(3)
    rows, toxic = [], []
    for i in range(900):
        t = i < 200 or i % 3 == 0
        toxic.append(t)
        rows.append(np.unique(np.concatenate((r.integers(20, 400, 12), r.integers(0, 10, 3) if t else r.integers(10, 20, 2)))))
    row, code = np.repeat(np.arange(900), [len(x) for x in rows]), np.concatenate(rows)
    w, bias = fit(row, code, np.ones(len(code)), np.arange(900) < 200, 1 / 3, bits=9)
    f = np.bincount(row, weights=w[code] * np.log(2), minlength=900) + bias
    assert np.mean((f[200:] > np.log(0.7 / 0.3)) == np.array(toxic[200:])) > 0.97


def corpus(n=900, seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 8)))
    out = []
    for i in range(n):
        toxic = i % 6 == 0
        w = [word() for _ in range(r.randint(5, 60))]
        for _ in range(3 * toxic):
            w.insert(r.randrange(len(w)), r.choice(["Zork", "zorked,", "quib###", "zorkish"]))
        out.append((i, " ".join(w), int(toxic)))
    return out


def test_rows(spark):
    data = corpus()
    more = [(9000, None, 1.0), (9001, "", 1.0), (None, "a b", 1.0), (9002, "zork " * 30_000, 1.0), (0, "a second text of 0", 1.0), (0, "a second text of 0", 1.0)]
    docs = spark.createDataFrame([(i, t, 3.0) for i, t, _ in data] + more, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in data if i % 2 == 0] + [(9000, 1, 1), (1, 0, None), (None, 0, 1), (5, 0, 7), (6, 0, 0)], "doc_id long, quality int, toxic int")
    got = toxicity(docs, labels).collect()
    assert len(got) == 906 and all(0 <= g["score"] <= 1 and g["predicted"] == int(g["score"] >= 0.7) for g in got)
    assert all(g["held_out"] == (g["doc_id"] is not None and zlib.crc32(str(g["doc_id"]).encode()) % 3 == 1) for g in got)
    by = {g["doc_id"]: g for g in got}
    assert np.mean([by[i]["predicted"] == t for i, _, t in data if i]) > 0.97 and by[9002]["predicted"] == 1
    assert by[9000]["score"] == by[9001]["score"] < 0.5
    again = {(g["doc_id"], round(g["score"], 6)) for g in toxicity(docs.repartition(7), labels.repartition(3)).collect()}
    assert again == {(g["doc_id"], round(g["score"], 6)) for g in got}


def test_labels_of_held_out_rows_and_of_one_kind(spark):
    data = corpus(300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    true = spark.createDataFrame([(i, t) for i, _, t in data], "doc_id long, toxic int")
    lies = spark.createDataFrame([(i, 1 - t if held(i) else t) for i, _, t in data], "doc_id long, toxic int")
    scores = lambda k: sorted((r["doc_id"], round(r["score"], 9)) for r in toxicity(docs, k).collect())
    assert scores(true) == scores(lies)  # labels of held-out rows are never read
    only = true.where("toxic = 1")
    n = sum(not held(i) for i, _, _ in data)
    assert class_prior(docs, only) == pytest.approx(sum(t for i, _, t in data if not held(i)) / n)
    hit = {r["doc_id"]: r["predicted"] for r in toxicity(docs, only).collect()}
    assert np.mean([hit[i] == t for i, _, t in data]) > 0.95
    assert {r["score"] for r in toxicity(docs, true.where("toxic = 0")).collect()} == {0.0} == {r["score"] for r in toxicity(docs, true.where("false")).collect()}
    assert toxicity(docs.where("false"), true).collect() == []


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1"), reason="needs the given tables")
def test_held_out_accuracy(spark):
    d, k = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity(d, k).where("held_out").join(k, "doc_id").selectExpr("avg(if(toxic = 1, predicted, null)) recall", "avg(if(predicted = 1, toxic, null)) precision").first()
    assert got["recall"] > 0.9 and got["precision"] > 0.97  # a few labels name texts without any mark
