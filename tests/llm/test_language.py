import os
import random
import zlib

import numpy as np
import pytest

from scholia.llm.language import _collapse, _points, fit, identify_languages, language_id, phrases

SYLLABLES = {"xx": "ka mo ti ru ne", "yy": "sch ein ung lich ver", "zz": "čo ñu ía ção ré"}


def text(lang, r, n):
    return " ".join("".join(r.choice(SYLLABLES[lang].split()) for _ in range(r.randint(1, 4))) for _ in range(n))


def cross_parse(sample, codes):
    """Phrases of the greedy parse, by searching the sample itself."""
    n, i = 0, 0
    while i < len(codes):
        k = 1
        while i + k <= len(codes) and codes[i : i + k] in sample:
            k += 1
        i += max(1, k - 1)
        n += 1
    return n


def test_phrases_equal_a_search_of_the_sample():
    r = random.Random(2)
    samples = {k: [text(k, r, 60)] for k in SYLLABLES}
    m = fit(samples, 100_000)
    seqs = {k: bytes(_collapse(np.concatenate([np.append(m.classes[_points(t)], 0) for t in v])).astype(np.uint8)) for k, v in samples.items()}
    texts = [text(k, r, 30) for k in SYLLABLES] + ["Ω unseen καὶ", "KA mo! ti", "", None, "123 ,,"]
    count, letters = phrases(m, texts)
    assert letters.tolist() == [True] * 5 + [False] * 3
    for t, row in zip(texts[:5], count, strict=False):
        codes = bytes(_collapse(m.classes[_points(t)]))
        assert row.tolist() == [cross_parse(seqs[k], codes) for k in m.languages]


def test_long_texts_are_parsed_as_wholes():
    r = random.Random(4)
    m = fit({k: [text(k, r, 300)] for k in SYLLABLES}, 100_000)

    def plain(t):
        n, at = [0] * len(m.languages), m.roots.tolist()
        for c in _collapse(m.classes[_points(t)]).tolist():
            for k in range(len(at)):
                v = int(m.table[(at[k] >> 1) + c])
                n[k], at[k] = n[k] + (v & 1), v
        return n

    periodic = text("xx", random.Random(1), 3)
    texts = ["short ka", text("yy", r, 2000), "ka " * 3000, f"{periodic} " * 900, "q" * 5000, "kamoti" * 1500 + "sch" * 900, text("xx", r, 900) + text("zz", r, 900), text("zz", r, 341)]
    assert phrases(m, texts)[0].tolist() == [plain(t) for t in texts]


def test_rows(spark):
    r = random.Random(9)
    rows = [(i, text(k, r, 40), k) for i, k in enumerate(r.choice(list(SYLLABLES)) for _ in range(300))]
    odd = [(1000, None, "xx"), (1001, "", "xx"), (1002, "12 .,", "yy"), (1003, rows[0][1], None), (None, rows[1][1], "zz"), (1004, text("yy", r, 30_000), "xx"), (0, *rows[0][1:])]
    df = spark.createDataFrame([(*x, 5.0) for x in rows + odd], "doc_id long, text string, lang string, score double")
    got = language_id(df).collect()
    assert len(got) == 307
    for g in got:
        if g["doc_id"] is not None:
            assert g["held_out"] == (zlib.crc32(str(g["doc_id"]).encode()) % 4 == 2)
        assert 0 <= g["score"] <= 1
    pred = {g["doc_id"]: g["lang_pred"] for g in got}
    assert [pred[i] for i in (1000, 1001, 1002)] == ["und"] * 3 and pred[1004] == "yy"
    assert np.mean([pred[i] == k for i, _, k in rows]) > 0.98
    assert language_id(df.where("false")).collect() == []
    assert {x["lang_pred"] for x in identify_languages(df.limit(2), None).collect()} == {"und"}


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="needs the given tables")
def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id(d).where("held_out").join(d.select("doc_id", "lang"), "doc_id").selectExpr("avg(int(lang_pred = lang)) a").first()["a"]
    assert got > 0.97
