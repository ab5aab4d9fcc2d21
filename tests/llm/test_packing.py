import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from scholia.llm.packing import pack, reduce_and_fit, same_ids
from scholia.llm.queries import queries

TEXTS = ["", None, "Hello world", "  two  spaces\t", "é" * 30, "a<|endoftext|>b", "word " * 3000, "x" * 4000, "It's 12,345.", "Hello world"]


def test_pieces_and_places(spark):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(TEXTS)] + [(0, "", 1, 2), (None, "z", 1, 2)], "doc_id long, text string, piece int, rank int")
    rows = pack(df).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    for i, text in enumerate(TEXTS):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])[:: 2 if i == 0 else 1]
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert [r["start"] for r in own] == np.cumsum([0] + [r["length"] for r in own])[:-1].tolist()
        assert all(r["length"] == 1024 for r in own[1:]) and sum(r["length"] for r in own) == len(ids)
        assert [r["ids_crc32"] for r in own] == [zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in own]
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by) == -(-sum(r["length"] for r in rows) // 1024)
    assert pack(df.where("false")).collect() == []


@pytest.mark.parametrize("seed", range(40))
def test_plan_holds_everything_and_is_near_the_bound(seed):
    r = random.Random(seed)
    cap = r.choice([10, 30, 100])
    counts = Counter(r.randint(1, cap) for _ in range(r.randint(0, 400)))
    plan = reduce_and_fit(dict(counts), cap)
    held = Counter()
    for n, items in plan:
        assert n > 0 and sum(items) <= cap
        for x in items:
            held[x] += n
    assert held == counts
    best = max(-(-sum(x * n for x, n in counts.items()) // cap), sum(n for x, n in counts.items() if 2 * x > cap))
    assert sum(n for n, _ in plan) <= best * 11 / 9 + 1


def exact(items, cap):
    """The least number of bins, by trying everything."""
    items, best = sorted(items, reverse=True), [len(items)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= cap and bins[k] not in bins[:k]:
                bins[k] += items[i]
                place(i + 1, bins)
                bins[k] -= items[i]
        bins.append(items[i])
        place(i + 1, bins)
        bins.pop()

    place(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(25))
def test_plan_against_all_ways(seed):
    r = random.Random(seed)
    items = [r.randint(1, 20) for _ in range(r.randint(1, 11))]
    assert sum(n for n, _ in reduce_and_fit(dict(Counter(items)), 20)) <= exact(items, 20) + 1


def test_ranks_give_the_ids_of_the_vocabulary():
    assert same_ids("byte_bpe_50k.json", [t or "" for t in TEXTS] + ["\n\n a b　c", "don't WON'T 'll", "日本語のテキスト"])


def test_registered_packing_has_the_ids_of_the_tokenizer_with_its_defaults(spark, tmp_path):
    texts = ["a<|endoftext|>b", "<|endoftext|><|endoftext|>", "x " * 1500 + "<|endoftext|>", "<|endoftext|", " <|endoftext|> \n", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for rows in (queries()["op3_best_fit_packing"](spark, str(tmp_path)).collect(), corpus_pipeline.packing(spark, d, str(tmp_path)).collect()):
        for i, text in enumerate(texts):
            ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
            own = [r for r in rows if r["doc_id"] == i]
            assert sum(r["length"] for r in own) == len(ids)
            assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in own)
