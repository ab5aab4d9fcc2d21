import corpus_pipeline
from scholia.llm.packing import pack


def test_stages_one_by_one(spark, tmp_path):
    long = " ".join(f"wort{i % 97} gehen{i % 89}" for i in range(300))
    rows = [(i, f"{long} Nummer {i} mail a{i}@b.de", "de" if i % 2 else "en", "s1") for i in range(6)] + [(20, "1 2 3", "de", "s2"), (21, None, "de", "s2"), (22, "Ganz anderer Text, kurz und gut.", "de", None)]
    rows += [(23, rows[0][1], "en", "s2"), (22, "Ganz anderer Text, kurz und gut.", "de", None), (None, "Noch ein Text ohne Nummer.", "de", "s2")]
    docs = spark.createDataFrame([(i, t, lang, s, len(t or ""), "e") for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long, size string")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = stage(spark, docs, "").cache()
        if name != "packing":
            assert out[name].columns == docs.columns
            docs = out[name]
    ids = lambda n: sorted(r["doc_id"] for r in out[n].where("doc_id is not null").select("doc_id").collect())
    assert ids("language") == [0, 1, 2, 3, 4, 5, 22, 22, 23]
    assert ids("near_dedup") == [0, 22] and out["near_dedup"].count() == 3
    assert "<EMAIL>" in out["pii"].where("doc_id = 0").first()["text"] and out["pii"].where("doc_id = 0").first()["n_chars"] == len(out["pii"].where("doc_id = 0").first()["text"])
    assert 1 <= out["mixing"].count() <= 9
    assert out["packing"].select("doc_id", "piece", "length").exceptAll(pack(docs).select("doc_id", "piece", "length")).count() == 0


def test_empty_tables_and_clashing_columns(spark):
    names = "_predicted string, _score double, _row_a long, _row_b long, _times long, _copy long, _pii_suspect string, _pii_text string"
    ddl = f"doc_id long, text string, lang string, source string, n_chars long, {names}"
    extra = ("p", 0.5, 1, 2, 3, 4, "s", "t")
    docs = spark.createDataFrame([(i, f"Ein kurzer Text, Nummer {'abcdef'[i]} von sechs, an {i}@x.de", "de", "s", 40, *extra) for i in range(6)], ddl)
    for some in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, some, "").cache()
            if name != "packing":
                assert out.columns == docs.columns and all(tuple(r)[5:] == extra for r in out.collect())
                some = out
            assert name == "mixing" or name == "packing" or out.count() == some.count()
        assert (out.count() > 0) == (some.count() > 0)


def test_run_is_the_stages_one_after_the_other(spark, tmp_path):
    rows = [(i, f"Der Text mit der Nummer {i} handelt von {'Wasser Feuer Erde Luft Holz Eisen'.split()[i % 6]} und Dingen {i * 7}", "de", f"s{i % 2}", 60) for i in range(30)]
    spark.createDataFrame(rows + [(40, rows[0][1], "de", "s0", 60), (41, "", "de", "s0", 0)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path)).cache()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = corpus_pipeline.run(spark, str(tmp_path)).select(*key)
    assert got.exceptAll(docs.select(*key)).count() == docs.select(*key).exceptAll(got).count() == 0 and got.where("doc_id in (40, 41)").count() == 0


def test_near_dedup_keeps_the_same_row_of_a_repeated_doc_id(spark):
    rows = [(1, f"Text Nummer {i} mit eigenen Worten {i * 31} und {i * 17} dazu", "de", "s", i) for i in range(8)] + [(2, "Noch ein anderer Text, der allein steht.", "de", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = lambda df: sorted(map(tuple, corpus_pipeline.near_dedup(spark, df, "").collect()))
    assert kept(docs) == kept(docs.orderBy("n_chars", ascending=False).repartition(5)) and [r[0] for r in kept(docs)] == [1, 2]
